"""Exact nearest neighbours of a stated query set against all rows, in blocks of both sides.

Queries and points are gathered into blocks of vectors. Every block of points meets every block of queries under that block's number, an
equi-join of few large rows, and keeps its own k best a query. No pair of rows is ever a row, and what is shuffled after is k rows a query
and block of points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a block of queries and of points, and of a block's queries that are measured at once.
QUERY_ROWS, POINT_ROWS, SLICE = 4096, 4096, 256


def usable(df: DataFrame, key: str, vector: str, group: str | None = None) -> DataFrame:
    """(id, grp, v) of the rows with a key and a vector of finite numbers; grp is the group's text, empty without one."""
    v = F.col(vector).cast("array<double>")
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.col(group).isNotNull() if group else F.lit(True)))
    rows = rows.select(F.col(key).cast("long").alias("id"), (F.col(group).cast("string") if group else F.lit("")).alias("grp"), v.alias("v"))
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def vector_blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """(<prefix>_block, _dim, _grp, _ids, _v): up to `size` vectors of one length and group each, made where the rows lie."""

    def run(batches):
        part, k = TaskContext.get().partitionId() << 24, 0
        held: dict[tuple[int, str], tuple[list, list]] = {}

        def row(at):
            nonlocal k
            ids, vs = held.pop(at)
            k += 1
            return pd.DataFrame({"block": [part + k], "dim": [at[0]], "grp": [at[1]], "ids": [np.array(ids, np.int64)], "v": [np.concatenate(vs).astype("<f8").tobytes()]}).add_prefix(f"{prefix}_")

        for pdf in batches:
            for i, g, v in zip(pdf["id"], pdf["grp"], pdf["v"]):
                at = (len(v), g)
                ids, vs = held.setdefault(at, ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) >= size:
                    yield row(at)
        for at in list(held):
            yield row(at)

    return rows.mapInPandas(run, f"{prefix}_block long, {prefix}_dim int, {prefix}_grp string, {prefix}_ids array<long>, {prefix}_v binary")


def meet(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Every block of points beside every block of queries of its vectors' length; both are written, so their numbers stay."""
    q, p = written(queries, "query-blocks"), written(points, "point-blocks")
    numbers = q.groupBy(F.col("q_dim").alias("p_dim")).agg(F.collect_list("q_block").alias("q_block"))  # a number a block of queries
    return p.join(numbers, "p_dim").withColumn("q_block", F.explode("q_block")).join(q, "q_block")


def matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, dim)


def _measured(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one vector to others, differences added in the order of the dimensions."""
    gap = np.abs(p - q) if metric == "l1" else (p - q) ** 2
    total = np.add.accumulate(gap, axis=1)[:, -1]
    return total if metric == "l1" else np.sqrt(total)


def _best(q_ids, q, p_ids, p, k: int, metric: str) -> list[tuple[int, int, float]]:
    """(query, point, distance) of each query's k nearest of a block: candidates by a product (squares) or sums, which rounding cannot keep out, then measured."""
    out, norm = [], (p * p).sum(1)
    for a in range(0, len(q), SLICE):
        part = q[a : a + SLICE]
        if metric == "l1":
            d = np.zeros((len(part), len(p)))
            for i in range(q.shape[1]):
                d += np.abs(part[:, i, None] - p[None, :, i])
            slack = 1e-9 * (1 + d.max(1))
        else:
            own = (part * part).sum(1)
            d = own[:, None] + norm[None] - 2 * (part @ p.T)
            slack = 1e-9 * (own + norm.max())
        d[q_ids[a : a + SLICE, None] == p_ids[None]] = np.inf
        edge = np.partition(d, k - 1, axis=1)[:, k - 1] if k <= d.shape[1] else np.full(len(part), np.inf)
        for i in range(len(part)):
            c = np.flatnonzero((d[i] <= edge[i] + slack[i]) & (d[i] < np.inf))
            m = _measured(part[i], p[c], metric)
            for j in np.lexsort((p_ids[c], m))[:k]:
                out.append((int(q_ids[a + i]), int(p_ids[c[j]]), float(m[j])))
    return out


def nearest(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", key: str = "vec_id", vector: str = "embedding", group: str | None = None, query_rows: int = QUERY_ROWS, point_rows: int = POINT_ROWS) -> DataFrame:
    """(query, rank, vec_id, distance): each query's k nearest points by `metric` (l2 or l1), ties to the smaller id; a query is not its own neighbour.

    With `group`, a column of points, the k nearest of each of its values, named in a column grp. Vectors that are null, empty or hold null
    or non-finite numbers take no part, nor do rows without a key; vectors of another length are no neighbours. Repeated ids are points of
    their own; a repeated query gets the neighbours of all its rows together. Distances are double precision sums.
    """
    pairs = meet(vector_blocks(usable(queries, key, vector), query_rows, "q"), vector_blocks(usable(points, key, vector, group), point_rows, "p"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                found = _best(np.asarray(r.q_ids), matrix(r.q_v, r.q_dim), np.asarray(r.p_ids), matrix(r.p_v, r.p_dim), k, metric)
                yield pd.DataFrame(found, columns=["query", "vec_id", "distance"]).assign(grp=r.p_grp)[["query", "grp", "vec_id", "distance"]]

    best = pairs.mapInPandas(run, "query long, grp string, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query", "grp").orderBy("distance", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query", *(["grp"] if group else []), "rank", "vec_id", "distance")
