"""Queries of the streaming, model, ingest and search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import critic as C
from ..operators import models as M
from ..operators import neighbours as B
from ..operators import outcomes as O
from ..sources import ingest as I
from ..sources.shared import shared_path as shared
from ..sources.views import events, matches, table
from ..streaming import streams as K
from .register import Registry

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*t").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream writes until its input is used up; in complete mode the last state."""
    spark = df.sparkSession
    out, mark = shared(spark, "stream"), shared(spark, "mark")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'batch={number}'}")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(out)


add("k2_ingest_filter", lambda s, d: drained(K.ingest_filter(event_stream(s, d), ["click", "view"], 20, "event_type", "value").select("event_id", "value")), "select event_id, value from events where event_type in ('click', 'view') and (value is null or value <= 0 or value >= 20)")
add("k3_dedup", lambda s, d: drained(K.dedup_stream(event_stream(s, d).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")), ["event_id"], "ts", "1 hour").select("event_id")), "select distinct event_id from events")
add("k4_hourly_counts", lambda s, d: drained(K.hourly_counts(event_stream(s, d), "ts"), "complete"), "select hour(ts)::int as hour, count(*) as n from events group by 1")
add("k5_windowed_rate", lambda s, d: drained(K.windowed_rate(event_stream(s, d), "ts", "event_type = 'error'", "2 hours", "1 hour", "1 hour"), "complete"),
    "select w as start, count(*) as n, avg((event_type = 'error')::int::double) as ratio from (select event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as w from events) group by 1")
add("k9_sessions", lambda s, d: drained(K.stream_sessions(event_stream(s, d), "ts", "user_id", "6 hours", "1 day"), "complete"),
    """with f as (select user_id, ts, case when ts - lag(ts) over w <= interval 6 hours then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from f) select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as n from g group by user_id, k""")
add("k10_tilt", lambda s, d: drained(K.stream_tilt(event_stream(s, d).select("user_id", "event_id", (F.col("event_type") == "error").cast("int").alias("lost")), "user_id", "event_id", "lost", 10, 4)),
    "select user_id, event_id, k as losses, k >= 4 as alarm from (select user_id, event_id, sum((event_type = 'error')::int) over (partition by user_id order by event_id rows between 9 preceding and current row)::int as k from events)")


def _maintained(s, d):
    path, mark = shared(s, "state"), shared(s, "mark")

    def fold(batch, state):
        new = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        return new if state is None else state.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))

    q = K.maintain(event_stream(s, d), path, fold, mark)
    q.awaitTermination()
    return s.read.parquet(f"{path}/{q.lastProgress['batchId']}")


add("k7_maintain", _maintained, "select user_id, count(*) as n, min(ts) as first, max(ts) as last from events group by 1")
add("k6_silence", lambda s, d: (lambda e: e.withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where(F.col("next") > F.col("ts") + F.expr("interval 12 hours")).select("user_id", "event_id"))(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))),
    "select user_id, event_id from (select *, lead(ts) over (partition by user_id order by ts, event_id) as nx from events) where nx > ts + interval 12 hours")
add("k8_score_late", lambda s, d: drained(K.score_late(event_stream(s, d), "ts", "2 hours", ["event_id"], table(s, d, "events").where("event_id % 3 = 0")).select("event_id")), "select event_id from events where event_id % 3 != 0")
add("k11_enrich", lambda s, d: drained(K.enrich(event_stream(s, d).select("event_id", F.col("event_type").alias("kind")), s.createDataFrame([("click", 1), ("error", 4)], "kind string, weight int"), "kind", {"weight": 0})),
    "select event_id, event_type as kind, case event_type when 'click' then 1 when 'error' then 4 else 0 end as weight from events")

# --- vectors and models ------------------------------------------------------------------------------------------------

_every_50th = lambda s, d: table(s, d, "embeddings").where("vec_id % 50 = 0")  # the stated queries, against all rows
_DISTANCES = "p as (select x.vec_id as query, e.vec_id, e.label, list_distance(e.embedding::double[], x.embedding::double[]) as dist from embeddings x, embeddings e where x.vec_id % 50 = 0 and e.vec_id != x.vec_id)"
add("j1_knn", lambda s, d: B.nearest(table(s, d, "embeddings"), _every_50th(s, d), 10).select("query", "rank", "vec_id", F.round("distance", 9).alias("distance")),
    f"with {_DISTANCES} select query, row_number() over (partition by query order by dist, vec_id)::int as rank, vec_id, round(dist, 9) as distance from p qualify rank <= 10")
add("g8_knn_gap", lambda s, d: B.nearest(table(s, d, "embeddings"), _every_50th(s, d), 10).groupBy("query").agg((F.percentile("vec_id", F.lit(0.5)) - F.col("query")).alias("gap")),
    f"""with {_DISTANCES} select query, quantile_cont(vec_id, 0.5) - query as gap from (select * from p qualify row_number() over (partition by query order by dist, vec_id) <= 10) group by query""")


def similar(s: SparkSession, d: str) -> DataFrame:
    """The 5 nearest rows of each label, their similarity by a Gaussian as wide as the median distance of all found, and whether the label is the query's own."""
    e = table(s, d, "embeddings")
    near = B.nearest(e, e.where("vec_id % 50 = 0"), 5, group="label").withColumn("label", F.col("grp").cast("int"))
    sigma = near.groupBy("query").agg(F.percentile("distance", F.lit(0.5)).alias("sigma"))
    own = e.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    out = near.join(sigma, "query").join(own, "query")
    return out.select("query", "label", "rank", "vec_id", F.round(X.gauss_similarity("distance", "sigma"), 6).alias("similarity"), (F.col("label") == F.col("own")).alias("same"))


add("j2_similar", similar,
    f"""with {_DISTANCES}, t as (select *, row_number() over (partition by query, label order by dist, vec_id)::int as rank from p qualify rank <= 5), g as (select query, quantile_cont(dist, 0.5) as sigma from t group by query)
select query, t.label, rank, t.vec_id, round(exp(-dist * dist / (2 * sigma * sigma)), 6) as similarity, t.label = o.label as same from t join g using (query) join embeddings o on o.vec_id = query""")
_v = lambda s, d: M.with_vector(table(s, d, "embeddings"))
add("j3_reduce", lambda s, d: M.reduce_dimensions(_v(s, d), 3)[1].select("vec_id", M.vector_to_array("reduced").alias("reduced")))
add("j4_cluster", lambda s, d: M.cluster(_v(s, d), 8, 0.05).select("vec_id", "cluster", F.round("distance", 6).alias("distance")))
add("j32_sweep", lambda s, d: M.sweep(_v(s, d), [4, 8], 0.05))


def _scored(s, d):
    """A model fitted on the earlier four fifths of the events, and all events with `validation` for the later ones."""
    e = C.time_split(events(s, d), ["ts", "event_id"]).withColumn("won", (F.col("match_id") % 2).cast("double"))
    return M.fit_classifier(e.where("not validation"), ["tick", "x", "y", "cost"], "won", 5), e


add("j6_score_events", lambda s, d: (lambda me: M.score_rows(*me).select("event_id", "validation", F.round("p", 6).alias("p")))(_scored(s, d)))
add("j26_swap", lambda s, d: (lambda me: M.swap_and_score(*me, "cost", 9, 1).select("event_id", F.round("delta", 6).alias("delta")))(_scored(s, d)))
def platt(s, d):
    """Fitted on the later events, which the model has not seen."""
    model, e = _scored(s, d)
    p = M.score_rows(model, e.where("validation")).withColumn("z", F.log(F.col("p") / (1 - F.col("p"))))
    return s.createDataFrame([M.fit_platt(p, "z", "won")], "a double, b double")


add("j7_platt", platt)
add("j10_bootstrap", lambda s, d: M.bootstrap_mean(events(s, d).withColumn("v", F.col("cost").cast("double")), "v", "event_id", 50, 5))
add("j27_cost_gradient", lambda s, d: M.swap_gradient(events(s, d).select("side", "item", (F.col("cost") - 5).cast("double").alias("delta")), ["side", "item"]).select("side", "item", "n", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high")),
    "select side, item, count(*) as n, round(avg(v), 6) as mean, round(avg(v) - 1.96 * stddev_pop(v) / sqrt(count(*)), 6) as low, round(avg(v) + 1.96 * stddev_pop(v) / sqrt(count(*)), 6) as high from (select side, item, (cost - 5)::double as v from e) group by all", "e")
add("a8_parse_pages", lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<(p|li|h1|h2|td)\b"), F.lit(1))).alias("n", "tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n")),
    r"select page_id, tag, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<(p|li|h1|h2|td)\b', 1)) as tag from pages) group by all")


def _history(s, d):
    path = shared(s, "history")
    m = O.win_rate(matches(s, d), ["kind"]).select("kind", "n", "wins")
    I.append_history(m, path)
    I.append_history(m, path)
    return I.read_source(s, path, "kind string, n long, wins long", "json").groupBy("kind").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("n"))


add("a22_history", _history, "select kind, 2::bigint as runs, count(*) as n from m group by kind", "m")
