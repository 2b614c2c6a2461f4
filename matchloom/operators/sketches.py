"""Quantile sketches of distributions of vectors along random directions, and their distances: a sliced Wasserstein distance."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import ranges

#: Directions, quantiles of each, and the vectors that a group needs.
SLICES, QUANTILES, LEAST = 64, 16, 5


def directions(dims: int, slices: int, seed: int) -> list[list[float]]:
    """`slices` unit vectors of `dims` normal numbers, each number from the md5 of seed, slice and dimension: the same on every machine."""
    normal, out = NormalDist(), []
    for k in range(slices):
        x = [normal.inv_cdf((int(hashlib.md5(f"{seed}:{k}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12) for i in range(dims)]
        size = math.sqrt(sum(v * v for v in x))
        out.append([v / size for v in x])
    return out


def levels(n: int, low: float = 0.05, high: float = 0.95) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)] if n > 1 else [0.5]


def project(v: DataFrame, by: Sequence[str], theta: Sequence[Sequence[float]], vector: str = "embedding") -> DataFrame:
    """(by…, slice, x): every vector's products with the directions, in batches of matrix products where the rows lie.

    Vectors that are null, of another length, or hold null or non-finite numbers take no part, nor do rows with a null group.
    """
    t = np.array(theta).T
    kinds = dict(v.dtypes)

    def run(batches):
        for pdf in batches:
            x = np.array(pdf["_v"].tolist(), float).reshape(len(pdf), -1) @ t if len(pdf) else np.zeros((0, t.shape[1]))
            out = pdf[list(by)].loc[pdf.index.repeat(t.shape[1])].reset_index(drop=True)
            yield out.assign(slice=np.tile(np.arange(t.shape[1]), len(pdf)), x=x.ravel())

    rows = v.where(F.size(vector) == len(t)).select(*by, F.col(vector).cast("array<double>").alias("_v")).dropna(subset=list(by))
    rows = rows.where(~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", slice int, x double")


def sliced_sketch(v: DataFrame, by: Sequence[str], theta: Sequence[Sequence[float]], qs: Sequence[float], least: int = LEAST, centre: bool = False, vector: str = "embedding") -> DataFrame:
    """(by…, n, sketch array<double>) of the groups with at least `least` vectors: quantiles of the projections on every direction, end to end.

    Quantiles are exact and found over ranges, so a group of a third of all vectors is never in one task. With `centre` each projection is
    taken from its group's mean, which leaves the shape of the distribution and drops its place.
    """
    p = written(project(v, by, theta, vector), "projections")
    mean = p.groupBy(*by, "slice").agg(F.avg("x").alias("_mean"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    q = ranges.quantiles(p.join(mean.select(*by, "slice"), [*by, "slice"], "left_semi"), [*by, "slice"], "x", qs)
    if centre:
        q = q.join(mean, [*by, "slice"]).withColumn("qs", F.transform("qs", lambda x: x - F.col("_mean")))
    return q.groupBy(*by, "n").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slice", "qs"))), lambda s: s["qs"])).alias("sketch"))


def sketch_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two sketches: about the sliced 1-Wasserstein distance of what they sketch."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size(a)
