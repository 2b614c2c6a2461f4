"""Queries of activity profiles, their classifier, and the critic of a model's predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import critic as C
from ..operators import outcomes as O
from ..sources.views import events, matches
from .register import Registry

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add

NOW, TREES, SEED = "2024-02-05 00:00:00", 20, 42


def watched(s: SparkSession, d: str) -> DataFrame:
    """Events as activity: the entity is the user, every tenth k was a scrape, y is the rating."""
    e = events(s, d)
    return e.select(F.col("match_id").alias("entity"), "ts", F.when(F.col("k") % 10 == 0, F.col("ts")).alias("scraped"), F.col("y").alias("rating"))


_P = """c as (select match_id as entity, hour(ts)::int as hour, (isodow(ts) - 1)::int as day, count(*) as n, min(ts) as first, max(ts) as last, max(case when k % 10 = 0 then ts end) as scraped, min(y) as low, max(y) as high from e group by 1, 2, 3),
p as (select entity, sum(n)::bigint as total, min(first) as first, max(last) as last, max(scraped) as scraped, (min(low) + max(high)) / 2 as rating, (sum(day * n) // sum(n))::int as mean_day from c group by 1),
hc as (select entity, hour, sum(n)::bigint as n from c group by 1, 2), dc as (select entity, day, sum(n)::bigint as n from c group by 1, 2),
at_hours as (select p.*, h.hour, mean_day as day, coalesce(hc.n, 0) as n from p join (select unnest(range(24))::int as hour) h on true left join hc on hc.entity = p.entity and hc.hour = h.hour),
top as (select entity, hour, n from hc qualify row_number() over (partition by entity order by n desc, hour) <= 3),
rows_ as (select at_hours.*, 'hour' as kind, (n > 0)::int as label, unnest(range(1, 1 + case when n > 0 then least(greatest(n // 10, 1), 5) else 1 end))::int as copy from at_hours where total >= 5
 union all by name select p.*, top.hour, d.day, top.n, 'cross' as kind, (coalesce(dc.n, 0) > 0)::int as label, 1 as copy from p join top using (entity) join (select unnest(range(7))::int as day) d on true left join dc on dc.entity = p.entity and dc.day = d.day where total >= 5)"""
_HOURS = lambda c: f"coalesce(least((epoch_us(timestamp '{NOW}') - epoch_us({c})) / 3.6e9, 720), 720)"
_X = f"""round(sin(hour * 2 * pi() / 24), 6) as hour_sin, round(cos(hour * 2 * pi() / 24), 6) as hour_cos, round(sin(day * 2 * pi() / 7), 6) as day_sin, round(cos(day * 2 * pi() / 7), 6) as day_cos,
round(n / total, 6) as hour_share, round(ln(1 + total), 6) as log_total, round({_HOURS('last')}, 6) as since_last, round({_HOURS('scraped')}, 6) as since_scraped,
round(case when total > 1 then total / greatest((epoch_us(last) - epoch_us(first)) / 8.64e10, 1) else 0 end, 6) as per_day, round(case when rating > 0 then (rating - 7000) / 8000 else 0.5 end, 6) as rating"""
_six = lambda df, *keys: df.select(*keys, *(F.round(c, 6).alias(c) for c in A.FEATURES))
_training = lambda s, d: A.features(A.training_rows(A.profiles(watched(s, d))), NOW)

add("f13_activity_features", lambda s, d: _six(A.features(A.at_hours(A.profiles(watched(s, d))), NOW), "entity", "hour", "day"), f"with {_P} select entity, hour, day, {_X} from at_hours", "e")
add("f14_activity_training", lambda s, d: _six(_training(s, d), "entity", "hour", "day", "kind", "copy", "label"), f"with {_P} select entity, hour, day, kind, copy, label, {_X} from rows_", "e")


def _fitted(s: SparkSession, d: str):
    rows = A.held_out(_training(s, d)).select("entity", "hour", "day", "kind", "copy", "label", "validation", *A.FEATURES)
    return A.fit_activity(rows, TREES, seed=SEED), rows


def activity_report(s: SparkSession, d: str) -> DataFrame:
    model, rows = _fitted(s, d)
    return A.activity_report(s, model, rows).select("measure", F.round("value", 6).alias("value"))


def activity_scores(s: SparkSession, d: str) -> DataFrame:
    """Every entity's probability of activity at each hour of its mean day."""
    model, _ = _fitted(s, d)
    return A.score_activity(model, A.features(A.at_hours(A.profiles(watched(s, d))), NOW)).select("entity", "hour", F.round("p", 6).alias("p"))


add("j5_activity_report", activity_report)
add("j5_activity_scores", activity_scores)

# --- the critic: a match's summary as a model saw it, and what the opponent adds ------------------------------------------------------

BASE, EXTRA = ["high", "swing"], ["opp_rating", "gap"]


def judged(s: SparkSession, d: str) -> DataFrame:
    """Decided matches with the highest probability that a model gave, its swing, and the opponent's context."""
    m = matches(s, d).where("result != 'draw'")
    return m.select(
        "match_id", "ts", O.is_("win").cast("int").alias("won"), ((F.col("own_rating") % 997) / 997.0).alias("high"), ((F.col("match_id") % 101) / 101.0).alias("swing"),
        F.col("opp_rating").cast("double").alias("opp_rating"), (F.col("own_rating") - F.col("opp_rating")).cast("double").alias("gap"),
    )


def _split(s: SparkSession, d: str) -> DataFrame:
    return C.time_split(judged(s, d), ["ts", "match_id"]).withColumn("residual", F.col("high") - F.col("won"))


_J = """j as (select match_id, ts, (result = 'win')::int as won, (own_rating % 997) / 997.0::double as high, opp_rating::double as opp_rating, (own_rating - opp_rating)::double as gap from m where result != 'draw')"""
add("j14_time_split", lambda s, d: _split(s, d).select("match_id", "validation"),
    f"with {_J} select match_id, row_number() over (order by ts, match_id) - 1 >= floor(0.8::double * count(*) over ()) as validation from j", "m")
_lift = lambda s, d: C.outcome_lift(_split(s, d), "won", {"base": BASE, "augmented": BASE + EXTRA, "context": EXTRA}, TREES)
_nine = lambda df: df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes))
add("j14_outcome_lift", lambda s, d: _nine(_lift(s, d)))
add("j14_residual_regression", lambda s, d: _nine(C.residual_regression(_split(s, d), "residual", EXTRA, TREES)))
add("j14_residual_by_quartile", lambda s, d: _nine(C.residual_by_quartile(judged(s, d), "gap", "won", "high")),
    f"""with {_J}, q as (select quantile_cont(gap, [0.25, 0.5, 0.75]) as qs from j), g as (select 1 + (gap > qs[1])::int + (gap > qs[2])::int + (gap > qs[3])::int as quartile, won, high from j, q)
select quartile, count(*) as n, round(avg(won), 9) as actual, round(avg(high), 9) as predicted, round(avg(high - won), 9) as residual from g group by 1""", "m")
