"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for every node that has a link.

    Large-star and small-star steps alternate until nothing changes; each round is written to the shared folder. Per node only minima
    are gathered, so a node with very many links is a partial aggregate, not a collected group. Self-links and nulls are ignored.
    """
    edges = written(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # large star: every neighbour larger than u links to the smallest of u and its neighbours
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: u and its smaller neighbours link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = written(small.where("u != v").distinct(), "edges")
        # nothing more to do when every node points at one node only and no target points on
        ends = after.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
        open_ = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into")).where("out > 1 or (out = 1 and into = 1)")
        edges = after
        if open_.isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
