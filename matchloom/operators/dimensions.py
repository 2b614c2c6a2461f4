"""Maintained dimensions and state tables: harvests, merges, upserts, discovery, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, by: Sequence[str], col: str, ps: Sequence[float]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.percentile(col, F.lit(p)).alias(f"p{round(100 * p)}") for p in ps))


def harvest(m: DataFrame) -> DataFrame:
    """Per group key: first and last seen, count, last name, whether ever a win, arrival watermark."""
    at = F.struct("ts", "match_id")
    return m.groupBy("entity").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(at).alias("last_at"), F.max_by("kind", at).alias("name"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("result") == "win").alias("ever_won"), F.max("match_id").alias("mark")
    )


def merge_harvest(state: DataFrame, delta: DataFrame) -> DataFrame:
    """State and a later delta folded together: what harvest of all rows would give."""
    return state.unionByName(delta).groupBy("entity").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("last_at").alias("last_at"), F.max_by("name", "last_at").alias("name"), F.sum("n").alias("n"), F.bool_or("ever_won").alias("ever_won"), F.max("mark").alias("mark")
    )


def upsert_range(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state(entity, low, high) widened by batch(entity, rating)."""
    seen = batch.groupBy("entity").agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"))
    return state.join(seen, "entity", "full_outer").select("entity", F.least("low", "lo").alias("low"), F.greatest("high", "hi").alias("high"))


def reseed(state: DataFrame, seed: DataFrame, protected: Sequence[str]) -> DataFrame:
    """Archive all but protected sources, activate the seed, add what is new."""
    s = seed.select("entity").distinct().withColumn("seeded", F.lit(True))
    return state.join(s, "entity", "full_outer").select("entity", F.coalesce("source", F.lit("seed")).alias("source"), (F.coalesce("seeded", F.lit(False)) | F.coalesce(F.col("source").isin(*protected), F.lit(False))).alias("active"))


def discover(state: DataFrame, m: DataFrame, floor: float, k: int) -> DataFrame:
    """The k most met opponents that state lacks, of rating `floor` or unknown (null or not over 0); k is the feature's own limit."""
    g = m.groupBy(F.col("opponent").alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.max("opp_rating").alias("rating"))
    fresh = g.join(state.select("entity"), "entity", "left_anti").where(F.col("rating").isNull() | (F.col("rating") <= 0) | (F.col("rating") >= floor))
    return fresh.orderBy(F.desc("n"), "entity").limit(k)


def next_batch(state: DataFrame, order: Sequence, k: int) -> DataFrame:
    return state.orderBy(*order).limit(k)


def snapshot_diff(s: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Differences between each key's last two snapshots; nulls count as 0, a single snapshot gives none."""
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    d = s.withColumn("_i", F.row_number().over(w))
    for f in fields:
        d = d.withColumn(f"d_{f}", F.coalesce(F.col(f), F.lit(0)) - F.coalesce(F.lead(f).over(w), F.lit(0)))
    return d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_i = 1 and _n > 1").select(key, *(f"d_{f}" for f in fields))


def touch(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state(entity, visits, last_ts) with a batch's counts and latest times added."""
    b = batch.groupBy("entity").agg(F.count(F.lit(1)).alias("k"), F.max("ts").alias("t"))
    return state.join(b, "entity", "left").select("entity", (F.col("visits") + F.coalesce("k", F.lit(0))).alias("visits"), F.greatest("last_ts", "t").alias("last_ts"))


def select_batch(state: DataFrame, n: int, floor_share: float = 0.2) -> DataFrame:
    """n rows of state(entity, priority, score, age): priority rows first, then the best scores, a share kept for the oldest."""
    kept = max(1, round(n * floor_share))
    first = state.where("priority").orderBy("entity").limit(n).withColumn("slot", F.lit("priority"))
    rest = state.where("not priority")
    oldest = rest.orderBy(F.desc("age"), "entity").limit(kept).withColumn("slot", F.lit("floor"))
    scored = rest.join(oldest.select("entity"), "entity", "left_anti").orderBy(F.desc_nulls_last("score"), "entity").limit(n).withColumn("slot", F.lit("scored"))
    rank = F.row_number().over(Window.orderBy(F.when(F.col("slot") == "priority", 0).when(F.col("slot") == "floor", 1).otherwise(2), F.desc_nulls_last("score"), "entity"))
    # at most 2 n + kept rows meet here
    return first.unionByName(oldest).unionByName(scored).withColumn("rank", rank).where(F.col("rank") <= n)
