"""Does more context predict what a model missed? Nested models on a time split, a regression of the residual, and the residual by quartile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges

TREES, DEPTH, STEP, SEED, TRAIN = 300, 3, 0.05, 0, 0.8


def time_split(df: DataFrame, order: Sequence[str], train: float = TRAIN) -> DataFrame:
    """df with `validation`: the rows from place floor(train * n) of the global order on. `order` must be unique, or ties may fall on either side."""
    return ranges.numbered(df, order).withColumn("validation", F.col("_place") >= F.floor(F.col("_rows") * train)).drop("_place", "_rows")


def _assembled(model, features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="keep"), model])


def outcome_lift(df: DataFrame, label: str, variants: dict[str, Sequence[str]], trees: int = TREES) -> DataFrame:
    """(variant, features, n, auc, log_loss, brier) on the validation rows of df(validation) of a classifier for each named list of features, fitted on the others."""
    out = None
    for name, features in variants.items():
        boost = GBTClassifier(labelCol=label, featuresCol="_f", maxIter=trees, maxDepth=DEPTH, stepSize=STEP, seed=SEED)
        scored = _assembled(boost, features).fit(df.where("not validation")).transform(df.where("validation")).select(F.col(label).alias("y"), vector_to_array("probability")[1].alias("p"))
        q = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
        scores = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
        one = scores.join(ranges.auc(scored, "p", F.col("y") == 1).select("auc"))  # one row each
        one = one.select(F.lit(name).alias("variant"), F.lit(len(features)).alias("features"), "n", "auc", "log_loss", "brier")
        out = one if out is None else out.unionByName(one)
    return out


def lift(scores: DataFrame, base: str, more: str) -> DataFrame:
    """One row: auc, log-loss and Brier score of `more` less those of `base`."""
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    return scores.agg(*((of(more, c) - of(base, c)).alias(f"{c}_lift") for c in ("auc", "log_loss", "brier")))


def residual_regression(df: DataFrame, residual: str, features: Sequence[str], trees: int = TREES) -> DataFrame:
    """One row (n, r2, mae, base_mae) on the validation rows: trees that predict the residual from features, against its training mean."""
    boost = GBTRegressor(labelCol=residual, featuresCol="_f", maxIter=trees, maxDepth=DEPTH, stepSize=STEP, seed=SEED)
    train = df.where("not validation")
    mean = train.agg(F.avg(residual).alias("_mean"))  # one row
    scored = _assembled(boost, features).fit(train).transform(df.where("validation")).select(F.col(residual).alias("y"), F.col("prediction").alias("p")).join(F.broadcast(mean))
    r2 = 1 - F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))) / (F.var_pop("y") * F.count(F.lit(1)))
    return scored.agg(F.count(F.lit(1)).alias("n"), r2.alias("r2"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("_mean"))).alias("base_mae"))


def residual_by_quartile(df: DataFrame, column: str, label: str, predicted: str, groups: int = 4) -> DataFrame:
    """(quartile, n, actual, predicted, residual) by equal-frequency groups of a column, right-closed; equal edges merge, null values are left out.

    Edges are exact quantiles found over ranges and joined as one row.
    """
    rows = df.where(F.col(column).isNotNull())
    edges = ranges.quantiles(rows.withColumn("_all", F.lit(0)), ["_all"], column, [i / groups for i in range(1, groups)]).select("qs")
    group = 1 + F.size(F.filter(F.array_distinct("qs"), lambda e: F.col(column) > e))
    return rows.join(F.broadcast(edges)).groupBy(group.alias("quartile")).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("actual"), F.avg(predicted).alias("predicted"), F.avg(F.col(predicted) - F.col(label)).alias("residual"))
