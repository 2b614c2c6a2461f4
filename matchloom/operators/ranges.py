"""Positions in a global order without a task that sees all rows: quantiles, running sums and rank statistics over ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bits of a row's id for its place in its range. Rows are dealt to as many ranges as the session's shuffles have partitions, unless the caller names a number.
_SHIFT = 33


def _ranges(df: DataFrame, order: Sequence, parts: int | None) -> DataFrame:
    """df with `_id`: its upper bits are the range a row lies in, its lower ones the place there. Written, as ranges come from samples: read twice, they must be the same."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranges")


def numbered(df: DataFrame, order: Sequence, parts: int | None = None) -> DataFrame:
    """df with `_place`, its 0-based place in the global order, and `_rows`, their number: ranges are sorted apart and what lies before each is added."""
    r = _ranges(df, order, parts).withColumn("_p", F.shiftright("_id", _SHIFT))
    sizes = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_k"))  # one row a range
    w = Window.orderBy("_p")
    before = sizes.select("_p", (F.sum("_k").over(w) - F.col("_k")).alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_rows"))
    place = F.col("_before") + F.col("_id") - F.shiftleft(F.col("_p"), _SHIFT)
    return r.join(F.broadcast(before), "_p").select(*df.columns, place.alias("_place"), "_rows")


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], parts: int | None = None) -> DataFrame:
    """(by…, n, qs array<double>): exact quantiles of a column in each group, interpolated between the two ranks around q * (n - 1).

    Rows are ordered by group and value over ranges, so a group of a third of all rows spreads over a third of them; a group's counts in each
    range give the rows that hold its ranks, and only those are looked up. Nulls and NaNs take no part; groups without a value are absent.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    r = _ranges(rows, [*by, "_v"], parts)
    runs = r.groupBy(*by, F.shiftright("_id", _SHIFT).alias("_p")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*by).orderBy("_p")
    runs = runs.withColumn("_before", F.sum("_k").over(w) - F.col("_k")).withColumn("n", F.sum("_k").over(Window.partitionBy(*by)))
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)))
    want = runs.select(*by, "n", "_first", "_before", "_k", F.explode(places).alias("z")).select(*by, "n", "_first", "_before", "_k", "z.i", (F.col("z.q") * (F.col("n") - 1)).alias("_at"))
    ends = F.array(F.struct(F.floor("_at").alias("rank"), (1 - (F.col("_at") - F.floor("_at"))).alias("weight")), F.struct((F.floor("_at") + 1).alias("rank"), (F.col("_at") - F.floor("_at")).alias("weight")))
    want = want.select(*by, "n", "_first", "_before", "_k", "i", F.inline(ends)).where((F.col("weight") > 0) & (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_k")))
    want = want.select(*by, "n", "i", "weight", (F.col("_first") + F.col("rank") - F.col("_before")).alias("_id"))
    found = want.join(r.select("_id", "_v"), "_id").groupBy(*by, "n", "i").agg(F.sum(F.col("weight") * F.col("_v")).alias("x"))
    return found.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("qs"))


def sums_below(df: DataFrame, key: str, values: Sequence[str], parts: int | None = None) -> DataFrame:
    """df(key, values…), one row a key, with `below_<value>`: the sum over all smaller keys. Ranges are summed apart and what lies before each is added."""
    r = _ranges(df, [key], parts).withColumn("_p", F.shiftright("_id", _SHIFT))
    sums = r.groupBy("_p").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))  # one row a range
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_p", *(F.coalesce(F.sum(f"_s_{v}").over(w), F.lit(0)).alias(f"_b_{v}") for v in values))
    inside = Window.partitionBy("_p").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    out = r.join(F.broadcast(before), "_p")
    return out.select(*df.columns, *((F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_b_{v}")).alias(f"below_{v}") for v in values))


def auc(df: DataFrame, score: str | Column, positive: str | Column, parts: int | None = None) -> DataFrame:
    """One row (n_pos, n_neg, auc): the share of (positive, negative) pairs ordered right, ties a half; null without both. Rows are counted by score first."""
    counts = df.select(F.col(score).alias("s") if isinstance(score, str) else score.alias("s"), F.col(positive).alias("p") if isinstance(positive, str) else positive.alias("p"))
    counts = counts.where("s is not null and p is not null").groupBy("s").agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg"))
    ranked = sums_below(counts, "s", ["neg"], parts)
    out = ranked.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("_wins"))
    return out.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))
