"""Residual signatures: features freed of their cell, weighted by how reliable they are, and a verdict whether they tell entities apart.

Features are rows (id, entity, basket, feature, value), so every statistic is one partial aggregate whatever the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import correlation

#: Rows a group needs, values a feature needs in it, and features a group needs.
LEAST, LEAST_VALUES, LEAST_FEATURES = 2, 2, 2
#: Rank statistic from which a signature passes, and the normal quantile of its lower bound.
PASS, Z = 0.55, 1.959963984540054


def residualize(df: DataFrame, cell: Sequence[str]) -> DataFrame:
    """df with `residual`: value less its feature's mean in the cell, over the standard deviation there (0 if it has none); null values stay null."""
    stats = df.groupBy(*cell, "feature").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    out = df.join(stats, [*cell, "feature"])
    gap = F.col("value") - F.col("_mean")
    return out.withColumn("residual", F.when(F.col("_sd") > 1e-9, gap / F.col("_sd")).when(F.col("value").isNotNull(), 0.0)).drop("_mean", "_sd")


def reliability_weights(df: DataFrame) -> DataFrame:
    """(feature, icc, split_half, weight) of residuals (id, entity, feature, residual): weight is the root of the two, each 0 at least.

    icc is the one-way intraclass correlation of a feature within entities of unequal sizes, split_half the correlation over entities of the means of
    their rows of odd and even place by id. A feature without one of them has weight 0.
    """
    r = df.where("residual is not null")
    g = r.groupBy("feature", "entity").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("residual").alias("mean"), F.coalesce(F.var_pop("residual"), F.lit(0.0)).alias("var"))
    t = g.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.col("n") * F.col("mean")).alias("total"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("raw"), F.sum(F.col("n") * F.col("var")).alias("within"),
    )
    safe = lambda a, b: a / F.when(b != 0, b)
    between = safe(F.col("raw") - F.col("total") * F.col("total") / F.col("rows"), F.col("k") - 1)
    within = safe(F.col("within"), F.col("rows") - F.col("k"))
    size = safe(F.col("rows") - F.col("squares") / F.col("rows"), F.col("k") - 1)
    icc = t.select("feature", safe(between - within, between + (size - 1) * within).alias("icc"))
    odd = F.row_number().over(Window.partitionBy("feature", "entity").orderBy("id")) % 2 == 1
    h = r.withColumn("_odd", odd).groupBy("feature", "entity").agg(F.avg(F.when(F.col("_odd"), F.col("residual"))).alias("a"), F.avg(F.when(~F.col("_odd"), F.col("residual"))).alias("b"))
    half = h.where("a is not null and b is not null").groupBy("feature").agg(correlation("a", "b").alias("split_half"))
    at_least = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    return icc.join(half, "feature", "left").withColumn("weight", F.sqrt(at_least("icc") * at_least("split_half")))


def residual_signatures(df: DataFrame, weights: DataFrame | None = None, least: int = LEAST, least_values: int = LEAST_VALUES, least_features: int = LEAST_FEATURES) -> DataFrame:
    """(entity, basket, n, signature array<double>): mean residuals of each group, standardised over groups, weighted, of length 1, in the order of features.

    A group needs `least` rows; a feature with fewer than `least_values` residuals in a group counts as the mean over groups, and a group needs
    `least_features` others. weights(feature, weight) multiply; a feature they lack has weight 0. A signature of zeros stays as it is.
    """
    g = df.where("entity is not null and basket is not null").groupBy("entity", "basket", "feature").agg(F.count(F.lit(1)).alias("rows"), F.count("residual").alias("values"), F.avg("residual").alias("m"))
    g = g.withColumn("m", F.when(F.col("values") >= least_values, F.col("m")))
    enough = g.groupBy("entity", "basket").agg(F.max("rows").alias("n"), F.count("m").alias("k")).where((F.col("n") >= least) & (F.col("k") >= least_features)).drop("k")
    g = g.join(enough, ["entity", "basket"])
    over = g.groupBy("feature").agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"))
    z = g.join(over, "feature").withColumn("z", F.coalesce((F.col("m") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), F.lit(0.0)))
    if weights is not None:
        z = z.join(weights.select("feature", "weight"), "feature", "left").withColumn("z", F.col("z") * F.coalesce("weight", F.lit(0.0)))
    out = z.groupBy("entity", "basket", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "z"))), lambda s: s["z"]).alias("s"))
    norm = F.greatest(F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    return out.select("entity", "basket", "n", F.transform("s", lambda x: x / norm).alias("signature"))


def with_bound(report: DataFrame, z: float = Z) -> DataFrame:
    """A report (…, n_pos, n_neg, auc) with `low`, the lower end of the rank statistic's confidence interval by the variance of Hanley and McNeil."""
    a = F.col("auc")
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    variance = (a * (1 - a) + (F.col("n_pos") - 1) * (q1 - a * a) + (F.col("n_neg") - 1) * (q2 - a * a)) / (F.col("n_pos") * F.col("n_neg"))
    return report.withColumn("low", a - z * F.sqrt(F.greatest(variance, F.lit(0.0))))


def verdict(report: DataFrame, bar: float = PASS) -> DataFrame:
    """One row (variant, auc, low, result) of report(variant, auc, low): the variant of the best statistic (ties: the first name).

    PASS if it reaches the bar and its lower bound lies over a half, PARTIAL if it is over a half with its bound, KILL else.
    """
    best = report.agg(F.min_by(F.struct("variant", "auc", "low"), F.struct(-F.coalesce("auc", F.lit(-1.0)), "variant")).alias("b")).select("b.*")
    sure = F.col("low") > 0.5
    return best.withColumn("result", F.when((F.col("auc") >= bar) & sure, "PASS").when((F.col("auc") >= 0.5) & sure, "PARTIAL").otherwise("KILL"))
