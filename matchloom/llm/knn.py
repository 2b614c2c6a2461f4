"""Exact top-k inner products by a Voronoi join.

Vectors become integers and every row goes to the cell of its nearest pivot. From one summary a cell (size, radius,
largest norm) follow bounds on the score of a query with anything in the cell, q.p - |q|r <= q.x <= q.p + |q|r. The
lower bounds of enough rows give each query a score it can count on; it is sent only to cells whose upper bound reaches
it. Queries are grouped by their own pivots, so a cell's rows meet whole groups of queries in one matrix product. Cells
are split into blocks of bounded size, whatever their share of the rows, and each block returns its k best a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table, written

SCALE = 1024
PIVOTS, BLOCK_ROWS, QUERY_ROWS = 64, 16384, 4096


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, dim): floor(scale * x) of each component; null, empty and non-finite vectors are left out."""
    x = F.col("embedding").cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where("vec_id is not null").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size("embedding").alias("dim"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products, by floats where they are exact and by Python's integers beyond."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2**53:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object)
    return whole(a).dot(whole(b).T)


def _nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)[None, :], 0)
    near = d.argmin(1)
    return near, np.sqrt(((v - pivots[near]) ** 2).sum(1))


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, v, dim) its k highest scores over vectors, not counting its own id.

    Ties go to the smaller vec_id. A query meets rows of its own dimension only. Repeated rows are rows; a query id that occurs twice
    is asked once. Fewer than k candidates give as many rows as there are; empty tables give none.
    """
    spark = vectors.sparkSession
    # the first `pivots` rows in a fixed pseudo-random order, for each dimension: a bounded table
    first = vectors.withColumn("h", F.xxhash64("vec_id", F.lit(3))).withColumn("n", F.row_number().over(Window.partitionBy("dim", F.pmod("h", F.lit(97))).orderBy("h", "vec_id")))
    picked = first.where("n <= 4").orderBy("h", "vec_id").select("dim", "v").limit(4 * pivots).toPandas()
    by_dim = {int(d): np.stack([np.asarray(x) for x in g["v"]])[:pivots] for d, g in picked.groupby("dim")}
    sent = spark.sparkContext.broadcast(by_dim)

    def to_cells(batches):
        for pdf in batches:
            cell, radius = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            dims = pdf["dim"].to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                p = sent.value.get(int(d))
                v = np.stack([np.asarray(pdf["v"].iloc[i]) for i in at])
                # dimensions without a pivot of their own form one cell around the origin
                cell[at], radius[at] = _nearest(v, p) if p is not None else (0, np.sqrt((v * v).sum(1)))
            yield pdf.assign(cell=cell, radius=radius)

    schema = "vec_id long, v array<double>, dim int, cell long, radius double"
    data = written(vectors.mapInPandas(to_cells, schema), "cells")
    summary = data.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("radius").alias("radius"))
    # a few numbers a cell; the number of cells is bounded by pivots and dimensions
    cells = {(int(r.dim), int(r.cell)): (int(r.rows), float(r.radius)) for r in summary.toLocalIterator()}
    blocks = {c: max(1, -(-n // BLOCK_ROWS)) for c, (n, _) in cells.items()}
    plan = spark.sparkContext.broadcast((cells, blocks))

    def to_wanted(batches):
        """Each query once for every block of each cell that can hold one of its k best."""
        for pdf in batches:
            out = []
            for vec_id, v, dim, group in zip(pdf["vec_id"], pdf["v"], pdf["dim"], pdf["cell"]):
                cells, blocks = plan.value
                mine = [c for c in cells if c[0] == dim]
                q = np.asarray(v)
                p = sent.value.get(int(dim))
                centre = np.array([q @ p[c] if p is not None else 0.0 for _, c in mine])
                spread = np.array([cells[c][1] for c in mine]) * np.sqrt(q @ q)
                rows = np.array([cells[c][0] for c in mine])
                low = centre - spread
                order = np.argsort(-low)
                enough = np.cumsum(rows[order]) >= k + 1  # the query itself may be among them
                sure = low[order][np.argmax(enough)] if enough.any() else -np.inf
                for j in np.flatnonzero(centre + spread >= sure - 1e-6 * (1 + abs(sure)) if np.isfinite(sure) else np.ones(len(mine), bool)):
                    for b in range(blocks[mine[j]]):
                        out.append((vec_id, v, dim, mine[j][1], b, int(group)))
            yield pd.DataFrame(out, columns=["vec_id", "v", "dim", "cell", "block", "group"])

    asked = queries.dropDuplicates(["vec_id"]).mapInPandas(to_cells, schema)
    wanted = asked.mapInPandas(to_wanted, "vec_id long, v array<double>, dim int, cell long, block long, group long")
    sizes = spark.createDataFrame([(d, c, n) for (d, c), n in blocks.items()], "dim int, cell long, blocks int")
    dealt = data.join(F.broadcast(sizes), ["dim", "cell"]).select("vec_id", "v", "dim", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("long").alias("block"))

    def solve(key, q, x):
        cols = ["query_id", "vec_id", "score"]
        if not len(q) or not len(x):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})
        x = x.sort_values("vec_id", kind="stable")
        ids, m = x["vec_id"].to_numpy(), np.stack([np.asarray(a) for a in x["v"]])
        q = q.sort_values("group", kind="stable")
        out = []
        for a in range(0, len(q), 256):
            part = q.iloc[a : a + 256]
            scores = _product(np.stack([np.asarray(v) for v in part["v"]]), m)
            for own, s in zip(part["vec_id"], scores):
                at = np.flatnonzero(ids != own)
                if len(at) > k:
                    least = np.partition(s[at], len(at) - k)[len(at) - k]
                    at = at[s[at] >= least]
                    at = at[np.argsort(-s[at], kind="stable")][:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at], "score": s[at].astype(np.int64)}))
        return pd.concat(out)

    keys = ["dim", "cell", "block"]
    near = wanted.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_inner_products(vectors, vectors.where("vec_id % 100 = 0"), 10)


QUERIES = {"op8_exact_top_k": op8_exact_top_k}
ORACLE = {
    "op8_exact_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), pairs as (
  select q.vec_id as query_id, x.vec_id as vec_id,
         list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v x on q.vec_id % 100 = 0 and x.vec_id != q.vec_id and len(q.v) = len(x.v)
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
"""
}
