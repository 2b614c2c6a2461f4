"""Evaluation operators: reliability, signatures, percentiles among controls, drift, normal scores, residuals, rescoring, grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

# Coefficients of Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
ACKLAM_LOW = 0.02425


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1, to about 1e-9."""
    tail = lambda q: _polynomial(ACKLAM_C, F.sqrt(-2 * F.log(q))) / _polynomial(ACKLAM_D, F.sqrt(-2 * F.log(q)))
    middle = (p - 0.5) * _polynomial(ACKLAM_A, (p - 0.5) * (p - 0.5)) / _polynomial(ACKLAM_B, (p - 0.5) * (p - 0.5))
    return F.when(p < ACKLAM_LOW, tail(p)).when(p > 1 - ACKLAM_LOW, -tail(1 - p)).otherwise(middle)


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; null where either side is constant, which `corr` takes for a division by zero."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.when(spread > 0, spread)


def normal_scores(df: DataFrame, cell: Sequence[str], value: str, tie: str) -> DataFrame:
    """df with `normal_score`: the normal quantile of (rank - 0.5) / n within each cell; nulls rank among themselves and get null."""
    w = Window.partitionBy(*cell, F.col(value).isNull())
    rank = F.row_number().over(w.orderBy(value, tie))
    score = inverse_normal((rank - 0.5) / F.count(F.lit(1)).over(w))
    return df.withColumn("normal_score", F.when(F.col(value).isNotNull(), score))


def studentized(df: DataFrame, cell: Sequence[str], y: str, x: str) -> DataFrame:
    """df with `residual`: y less its least-squares line on x within the cell, over the residuals' standard deviation (0 if they have none)."""
    line = df.groupBy(*cell).agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_intercept"))
    gap = F.col(y) - F.coalesce(F.col("_intercept") + F.col("_slope") * F.col(x), F.col(y))
    r = df.join(line, list(cell)).withColumn("_gap", gap)
    sd = F.stddev_pop("_gap").over(Window.partitionBy(*cell))
    return r.withColumn("residual", F.when(sd > 1e-9, F.col("_gap") / sd).otherwise(0.0)).drop("_slope", "_intercept", "_gap")


def icc(df: DataFrame, entity: str, value: str) -> DataFrame:
    """One row: groups, and the one-way intraclass correlation from the mean squares between and within entities of unequal sizes."""
    g = df.where(F.col(value).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("var"))
    total = g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("var")).alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("raw"))
    between = (F.col("raw") - F.col("rows") * F.col("grand") * F.col("grand")) / (F.col("groups") - 1)
    within = F.col("within") / (F.col("rows") - F.col("groups"))
    size = (F.col("rows") - F.col("squares") / F.col("rows")) / (F.col("groups") - 1)
    return total.select("groups", ((between - within) / (between + (size - 1) * within)).alias("icc"))


def split_half(df: DataFrame, entity: str, order: Sequence[str], value: str) -> DataFrame:
    """One row: entities with both halves, the correlation of the means of odd and even rows, and its Spearman-Brown step-up."""
    odd = F.row_number().over(Window.partitionBy(entity).orderBy(*order)) % 2 == 1
    h = df.withColumn("_odd", odd).groupBy(entity).agg(F.avg(F.when(F.col("_odd"), F.col(value))).alias("a"), F.avg(F.when(~F.col("_odd"), F.col(value))).alias("b")).where("a is not null and b is not null")
    return h.agg(F.count(F.lit(1)).alias("n"), correlation("a", "b").alias("r")).select("n", "r", (2 * F.col("r") / (1 + F.col("r"))).alias("reliability"))


def signatures(v: DataFrame, by: str, least: int) -> DataFrame:
    """(by, n, signature array<double>): centroids scaled to length 1 of the groups with at least `least` vectors; means are partial sums per dimension."""
    sizes = v.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    mean = v.select(by, F.posexplode("embedding").alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    c = mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return sizes.join(c, by).select(by, "n", F.when(norm > 0, F.transform("c", lambda x: x / norm)).otherwise(F.col("c")).alias("signature"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def percentile_among_controls(probes: DataFrame, sigs: DataFrame, key: str, band: str) -> DataFrame:
    """(id, key, similarity, controls, percentile): where a probe's similarity to its own key's signature stands among controls.

    Controls are the probes of the same band with another key, measured against the same signature. probes(id, key, band, embedding);
    sigs(key, signature) meets a band's probes once, so rows grow with probes times the keys of their band.
    """
    keys = probes.select(band, F.col(key).alias("_key")).distinct()
    met = probes.join(keys, band).join(sigs.select(F.col(key).alias("_key"), "signature"), "_key").select("id", key, band, "_key", cosine(F.col("embedding"), F.col("signature")).alias("similarity"))
    own = F.col(key) == F.col("_key")
    w = Window.partitionBy(band, "_key")
    below = F.sum(F.when(own, 0).otherwise(1)).over(w.orderBy("similarity").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    every = F.sum(F.when(own, 0).otherwise(1)).over(w)
    return met.withColumn("controls", every).withColumn("percentile", below / every).where(own & (F.col("controls") > 0)).select("id", key, "similarity", "controls", "percentile")


def drift(hits: DataFrame, order: Sequence[Column], block: int, threshold: float) -> DataFrame:
    """One row: mean hit of the newest `block` rows, the median of that of all earlier full blocks, and whether it fell by over `threshold`.

    hits(hit double). Blocks are counted from the newest row; rows are numbered within ranges, not in one task.
    """
    placed = ranges.numbered(hits.select("hit", F.struct(*order).alias("_o")), ["_o"])
    blocks = placed.groupBy(F.floor((F.col("_rows") - 1 - F.col("_place")) / block).alias("block")).agg(F.avg("hit").alias("rate"), F.count(F.lit(1)).alias("n"))
    out = blocks.agg(F.max(F.when(F.col("block") == 0, F.col("rate"))).alias("newest"), F.percentile(F.when((F.col("block") > 0) & (F.col("n") == block), F.col("rate")), F.lit(0.5)).alias("history"))
    return out.withColumn("drifted", F.col("newest") < F.col("history") - threshold)


def rescoring_queue(scores: DataFrame, version: int, batch: int, order: Sequence[Column]) -> DataFrame:
    """The next `batch` rows scored under an older version (or not at all), in order; the limit is the batch."""
    return scores.where(F.col("version").isNull() | (F.col("version") < version)).orderBy(*order).limit(batch)


def validate_grid(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """pairs(by…, pred, truth) -> per setting n, mean absolute error, bias and correlation, and `best` for the smallest error (ties: first setting)."""
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("mae"), F.avg(F.col("pred") - F.col("truth")).alias("bias"), correlation("pred", "truth").alias("corr"))
    best = g.agg(F.min_by(F.struct(*by), F.struct("mae", *by)).alias("_best"))
    return g.join(F.broadcast(best)).withColumn("best", F.struct(*by) == F.col("_best")).drop("_best")
