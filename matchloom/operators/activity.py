"""When is an entity active? Profiles, ten features of an entity and a time, training rows, and a classifier scored on held-out evidence."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranges

FEATURES = ["hour_sin", "hour_cos", "day_sin", "day_cos", "hour_share", "log_total", "since_last", "since_scraped", "per_day", "rating"]
#: Hours that count at most, ratings scaled to 0 and 1, the rating's value where it is unknown.
MOST_HOURS, RATING_LOW, RATING_SPAN, RATING_UNKNOWN = 720.0, 7000.0, 8000.0, 0.5
#: Events that an entity needs to be learnt from, hours an entity's week is crossed with, and most copies of an active hour (one a tenth event).
LEAST, TOP_HOURS, COPIES = 5, 3, 5


def profiles(e: DataFrame) -> DataFrame:
    """One row an entity of e(entity, ts, scraped timestamp, rating): total, first, last, scraped (latest), rating (middle of least and most), hours
    and days as maps of counts (days from Monday 0), mean_day rounded down. Rows without an entity or time take no part."""
    g = e.where("entity is not null and ts is not null").groupBy("entity", F.hour("ts").alias("hour"), F.weekday("ts").alias("day"))
    cells = g.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("scraped").alias("scraped"), F.min("rating").alias("low"), F.max("rating").alias("high"))
    # at most 168 cells an entity
    hours = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.struct(h, F.aggregate(F.filter("cells", lambda c: c["hour"] == h), F.lit(0).cast("long"), lambda a, c: a + c["n"]))))
    days = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.struct(d, F.aggregate(F.filter("cells", lambda c: c["day"] == d), F.lit(0).cast("long"), lambda a, c: a + c["n"]))))
    p = cells.groupBy("entity").agg(
        F.sum("n").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("scraped").alias("scraped"), ((F.min("low") + F.max("high")) / 2).alias("rating"),
        F.floor(F.sum(F.col("day") * F.col("n")) / F.sum("n")).cast("int").alias("mean_day"), F.collect_list(F.struct("hour", "day", "n")).alias("cells"),
    )
    return p.withColumn("hours", hours).withColumn("days", days).drop("cells")


def features(times: DataFrame, now: str) -> DataFrame:
    """times (profile columns, hour, day) with the ten FEATURES as seen at `now`: cycles of hour and day, the hour's share of all events, log of the
    total, hours since the last event and the last scrape (720 at most or if never), events a day over the active span (a day at least), the scaled rating."""
    turn = lambda c, n: F.col(c) * F.lit(2 * math.pi / n)
    hours = lambda c: F.coalesce(F.least((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(c)) / 3.6e9, F.lit(MOST_HOURS)), F.lit(MOST_HOURS))
    span = F.greatest((F.unix_micros("last") - F.unix_micros("first")) / 8.64e10, F.lit(1.0))
    return times.select(
        *(c for c in times.columns if c not in FEATURES),
        F.sin(turn("hour", 24)).alias("hour_sin"), F.cos(turn("hour", 24)).alias("hour_cos"), F.sin(turn("day", 7)).alias("day_sin"), F.cos(turn("day", 7)).alias("day_cos"),
        (F.element_at("hours", F.col("hour")) / F.col("total")).alias("hour_share"), F.log1p(F.col("total").cast("double")).alias("log_total"),
        hours("last").alias("since_last"), hours("scraped").alias("since_scraped"),
        F.when(F.col("total") > 1, F.col("total") / span).otherwise(0.0).alias("per_day"),
        F.when(F.col("_rating") > 0, (F.col("_rating") - RATING_LOW) / RATING_SPAN).otherwise(RATING_UNKNOWN).alias("rating"),
    ).drop("_rating")


def at_hours(p: DataFrame) -> DataFrame:
    """Every profile at each of the 24 hours of its mean day."""
    return p.withColumnRenamed("rating", "_rating").withColumn("day", F.col("mean_day")).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))


def training_rows(p: DataFrame, least: int = LEAST, top: int = TOP_HOURS, copies: int = COPIES) -> DataFrame:
    """(profile columns, hour, day, kind, copy, label) of profiles with `least` events: 24 hourly rows, active hours as often as a tenth of their
    events (1 to `copies`), and the `top` busiest hours (ties: the earlier) crossed with the seven days, active where the entity is on that day."""
    known = p.where(F.col("total") >= least)
    n = F.element_at("hours", F.col("hour"))
    times = F.when(n > 0, F.least(F.greatest(F.floor(n / 10), F.lit(1)), F.lit(copies))).otherwise(1).cast("int")
    hourly = at_hours(known).withColumn("kind", F.lit("hour")).withColumn("label", F.when(n > 0, 1).otherwise(0)).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    busiest = F.slice(F.array_sort(F.transform(F.filter(F.map_entries("hours"), lambda x: x["value"] > 0), lambda x: F.struct((-x["value"]).alias("n"), x["key"].alias("hour")))), 1, top)
    cross = known.withColumnRenamed("rating", "_rating").withColumn("hour", F.explode(F.transform(busiest, lambda x: x["hour"]))).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(6))))
    cross = cross.withColumn("kind", F.lit("cross")).withColumn("label", F.when(F.element_at("days", F.col("day")) > 0, 1).otherwise(0)).withColumn("copy", F.lit(1))
    return hourly.select(*cross.columns).unionByName(cross)


def held_out(rows: DataFrame, share: int = 5) -> DataFrame:
    """rows with `validation`: of each label one in `share`, by the hash of what the row is about, so copies stay on one side."""
    return rows.withColumn("validation", F.pmod(F.xxhash64("entity", "hour", "day", "kind"), F.lit(share)) == 0)


def fit_activity(rows: DataFrame, trees: int = 200, depth: int = 4, seed: int = 42):
    """Gradient-boosted trees on the training part of held_out rows with features; bounded by the sample the caller gives, fitted on executors."""
    boost = GBTClassifier(labelCol="label", featuresCol="_f", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=20, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_f"), boost]).fit(rows.where("not validation"))


def score_activity(model, times: DataFrame) -> DataFrame:
    """times with features and `p`, the probability of activity."""
    return model.transform(times).withColumn("p", vector_to_array("probability")[1]).drop("_f", "rawPrediction", "probability", "prediction")


def activity_report(spark: SparkSession, model, rows: DataFrame) -> DataFrame:
    """(measure, value): rows on both sides, share of positives, accuracy and rank statistic on the held-out side, and each feature's importance."""
    scored = score_activity(model, rows.where("validation"))
    hit = F.avg(F.when((F.col("p") >= 0.5) == (F.col("label") == 1), 1.0).otherwise(0.0))
    counts = rows.agg(F.count_if(~F.col("validation")).cast("double").alias("train_rows"), F.count_if("validation").cast("double").alias("validation_rows"), F.avg("label").alias("positive_share"))
    one = counts.join(scored.agg(hit.alias("accuracy"))).join(ranges.auc(scored, "p", F.col("label") == 1).select("auc"))  # rows of one each
    measures = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in one.columns))).alias("z")).select("z.*")
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return measures.unionByName(spark.createDataFrame([(f"importance_{f}", w) for f, w in zip(FEATURES, weights)], "measure string, value double"))


def busiest_cells(e: DataFrame, k: int) -> DataFrame:
    """The k busiest (hour, day) of each entity, ties to the earlier one."""
    g = e.groupBy("entity", F.hour("ts").alias("hour"), F.weekday("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("entity").orderBy(F.desc("n"), "hour", "day")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
