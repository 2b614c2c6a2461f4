"""Queries of versioned rescoring and of streams over a landing folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rescoring import ScoreStore, rescoring_progress
from ..sources import ingest as I
from ..sources.shared import shared_path, written
from ..sources.views import events, matches, table
from ..streaming import streams as K
from .register import Registry
from .streams import drained

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add

TARGET, BUCKETS = 3, 4


def scored(s: SparkSession, d: str) -> DataFrame:
    """Events with a score under their match's version: none, 1, 2, or the target already."""
    return events(s, d).select("match_id", "event_id", ((F.col("k") + 1) / 102).alias("p"), F.when(F.col("match_id") % 4 > 0, F.col("match_id") % 4).alias("version"))


def summarise(rows: DataFrame) -> DataFrame:
    return rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"))


def anew(rows: DataFrame) -> DataFrame:
    """A newer model's scores; matches whose number 7 divides cannot be scored any more."""
    return rows.where("match_id % 7 != 0").withColumn("p", F.col("p") / 2 + 0.25)


def rescored(s: SparkSession, d: str, report) -> DataFrame:
    """report(store) after a run that died between its writes and one that finished."""
    store = ScoreStore(s, f"scores_{uuid.uuid4().hex}", buckets=BUCKETS)
    try:
        rows = scored(s, d)
        store.create(rows, summarise(rows).join(rows.select("match_id", "version").distinct(), "match_id"))
        try:
            store.rescore(TARGET, anew, summarise, fail="rows")
        except RuntimeError:
            store.rescore(TARGET, anew, summarise)
        return written(report(store), "rescored")
    finally:
        store.drop()


_VERSIONS = """s as (select match_id, event_id, (k + 1) / 102 as p, match_id % 4 as version from e),
n as (select match_id, event_id, 3 as version, case when version = 3 then p else p / 2 + 0.25 end as p from s where version = 3 or match_id % 7 != 0)"""
add("j28_rescored", lambda s, d: rescored(s, d, lambda store: store.current()).select("match_id", "event_id", "version", F.round("p", 9).alias("p")),
    f"with {_VERSIONS} select match_id, event_id, version, round(p, 9)::double as p from n", "e")
add("j28_rescored_progress", lambda s, d: rescored(s, d, rescoring_progress), f"with {_VERSIONS} select version, count(distinct match_id) as matches, count(*) as rows from n group by 1", "e")

FILES = 4


def landed(df: DataFrame, name: str, ts: str, key: str, files: int = FILES) -> str:
    """df as files that come to a folder one after another in time, each beginning with a third of what the one before held, as overlapping polls do."""
    path = shared_path(df.sparkSession, name)
    low, high = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    width = ((high or 0) - (low or 0)) // files + 1
    df = written(df.withColumn("_part", F.floor((F.unix_micros(ts) - F.lit(low or 0)) / width)), "polls")
    for k in range(files):
        again = F.pmod(F.xxhash64(key), F.lit(3)) == 0
        df.where((F.col("_part") == k) | ((F.col("_part") == k - 1) & again)).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path


def raw_matches(s: SparkSession, d: str) -> DataFrame:
    """Matches as the nested records that a client would get, with the time and number they came under."""
    side = lambda tag, score, rating, change: F.array(F.struct(F.concat(F.lit(" "), tag.cast("string")).alias("tag"), score.alias("crowns"), rating.alias("startingTrophies"), change.alias("trophyChange")))
    c = F.col
    record = F.struct(
        c("kind").alias("type"), F.date_format("ts", "yyyyMMdd'T'HHmmss.SSS'Z'").alias("battleTime"), F.struct(F.lit(1).alias("id"), c("corpus").alias("name")).alias("arena"),
        side(c("entity"), c("own_score"), c("own_rating"), c("change")).alias("team"), side(c("opponent"), c("opp_score"), c("opp_rating"), -c("change")).alias("opponent"),
    )
    return matches(s, d).select(c("match_id").alias("number"), "ts", F.to_json(record).alias("raw"))


def _ingested(s: SparkSession, d: str) -> DataFrame:
    """The landing folder polled a file at a time: records flattened, each match kept once however often polls repeat it."""
    path = landed(raw_matches(s, d), "landing", "ts", "number")
    stream = K.stream_table(s, path, "number long, ts timestamp, raw string", per_batch=1)
    return drained(K.dedup_stream(I.flatten_matches(stream).select("match_id", "ts", "entity", "opponent"), ["match_id"], "ts", "1 day"))


_ID = """substr(sha256(strftime(ts, '%Y%m%dT%H%M%S.000Z') || '", "#' || entity || '", "#' || opponent), 1, 32)"""
add("k1_landing", _ingested, f"select distinct {_ID} as match_id, ts::timestamp as ts, '#' || entity as entity, '#' || opponent as opponent from m", "m")
add("a2_flatten_matches", lambda s, d: I.flatten_matches(raw_matches(s, d)).drop("raw", "leaked"),
    f"""select {_ID} as match_id, ts::timestamp as ts, kind, corpus as arena, '#' || entity as entity, '#' || opponent as opponent, result, own_score, opp_score, own_score - opp_score as differential, own_rating, opp_rating, change from m""", "m")

HOURS, DELAY = 12, "10 minutes"


def _silences(s: SparkSession, d: str) -> DataFrame:
    """Alerts of a stream over the landing folder: entities that fell silent between two events, or at the end for longer than the watermark saw."""
    e = table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    path = landed(e, "landing", "ts", "event_id")
    stream = K.stream_table(s, path, "user_id long, event_id long, ts timestamp", per_batch=1)
    return drained(K.silence(stream.select("user_id", "ts"), "ts", "user_id", HOURS * 60, DELAY)).select("user_id", F.col("last").alias("ts")).distinct()


add("k6_silence_stream", _silences,
    f"""with n as (select user_id, date_trunc('milliseconds', ts) as ts, lead(date_trunc('milliseconds', ts)) over (partition by user_id order by ts, event_id) as nx from events),
w as (select max(date_trunc('milliseconds', ts)) - interval {DELAY} as mark from events) select distinct user_id, ts from n, w where nx > ts + interval {HOURS} hours or (nx is null and mark > ts + interval {HOURS} hours)""")
