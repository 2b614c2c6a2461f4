"""Model operators on MLlib: reduction, clustering, classifiers, calibration, swaps; bootstrap in DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_vector(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn("vector", array_to_vector(F.col(column).cast("array<double>")))


def reduce_dimensions(df: DataFrame, k: int):
    """(model, frame) of scaled principal components; the model transforms new rows alike."""
    model = Pipeline(stages=[StandardScaler(inputCol="vector", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="reduced")]).fit(df)
    return model, model.transform(df)


def cluster(df: DataFrame, k: int, noise: float = 0.0, vector: str = "vector", seed: int = 11) -> DataFrame:
    """k-means cluster and distance of each row; the farthest `noise` share of each cluster is labelled -1."""
    model = KMeans(k=k, seed=seed, featuresCol=vector, predictionCol="cluster").fit(df)
    centres = [c.tolist() for c in model.clusterCenters()]
    out = model.transform(df).withColumn("_c", F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in centres)), F.col("cluster") + 1))
    gap = F.aggregate(F.zip_with(vector_to_array(vector), F.col("_c"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("distance", F.sqrt(gap)).drop("_c")
    if not noise:
        return out
    edge = out.groupBy("cluster").agg(F.percentile("distance", F.lit(1 - noise)).alias("edge"))
    return out.join(F.broadcast(edge), "cluster").withColumn("cluster", F.when(F.col("distance") > F.col("edge"), -1).otherwise(F.col("cluster"))).drop("edge")


def sweep(df: DataFrame, ks: Sequence[int], noise: float) -> DataFrame:
    """Clusters, noise share and largest share of each setting."""
    out = None
    for k in ks:
        c = cluster(df, k, noise).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        row = c.agg(F.lit(k).alias("k"), F.count_if(F.col("cluster") >= 0).alias("clusters"), (F.sum(F.when(F.col("cluster") < 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("noise"), (F.max(F.when(F.col("cluster") >= 0, F.col("n"))) / F.sum("n")).alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out


def fit_classifier(df: DataFrame, features: Sequence[str], label: str, trees: int = 10, seed: int = 3):
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=3, seed=seed)]).fit(df)


def score_rows(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_platt(df: DataFrame, logit: str, label: str) -> tuple[float, float]:
    """(a, b) with P = 1 / (1 + exp(a * logit + b))."""
    d = VectorAssembler(inputCols=[logit], outputCol="_f").transform(df)
    m = LogisticRegression(featuresCol="_f", labelCol=label, regParam=0.0).fit(d)
    return -float(m.coefficients[0]), -float(m.intercept)


def swap_and_score(model, e: DataFrame, column: str, old, new) -> DataFrame:
    """Difference of the model's probability after `old` is replaced by `new` in a feature column."""
    before = score_rows(model, e).select("event_id", F.col("p").alias("p0"))
    after = score_rows(model, e.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))).select("event_id", F.col("p").alias("p1"))
    return before.join(after, "event_id").withColumn("delta", F.col("p1") - F.col("p0"))


def swap_gradient(deltas: DataFrame, by: Sequence[str]) -> DataFrame:
    half = 1.96 * F.stddev_pop("delta") / F.sqrt(F.count(F.lit(1)))
    return deltas.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), (F.avg("delta") - half).alias("low"), (F.avg("delta") + half).alias("high"))


def bootstrap_mean(df: DataFrame, value: str, key: str, n: int, seed: int) -> DataFrame:
    """n replicates of a mean with Poisson weights from a seeded hash, and their 95 % interval; one partial aggregate a replicate."""
    u = (F.pmod(F.xxhash64(key, "replicate", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):  # the inverse of the Poisson(1) distribution function
        total += term
        term /= k
        weight = weight + F.when(u > total, 1).otherwise(0)
    reps = df.select(key, value, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate")).withColumn("w", weight)
    means = reps.groupBy("replicate").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"))
    return means.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
