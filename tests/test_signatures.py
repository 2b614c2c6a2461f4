"""Neighbours, ranges, sketches, verification and residual signatures against literal computations; edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import neighbours as B
from matchloom.operators import ranges as G
from matchloom.operators import residuals as R
from matchloom.operators import sketches as K
from matchloom.operators import verification as W

RNG = np.random.default_rng(4)


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>" + extra)


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_nearest_equals_a_loop(spark, metric):
    x = RNG.integers(-2, 3, (90, 4)).astype(float)  # many equal distances
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)] + [(200, None, "a"), (201, [], "a"), (202, [1.0, None, 0.0, 0.0], "a"), (203, [float("nan")] * 4, "a"), (204, [1.0], "b"), (None, [0.0] * 4, "a"), (205, [0.0] * 4, None)]
    df = vectors(spark, rows, ", grp_ string").repartition(3)
    d = lambda a, b: float(np.abs(a - b).sum()) if metric == "l1" else math.sqrt(float(((a - b) ** 2).sum()))
    points = {**dict(enumerate(x)), 205: np.zeros(4)}
    got = {}
    for r in B.nearest(df, df.where("vec_id % 9 = 0"), 5, metric, query_rows=4, point_rows=7).collect():
        got.setdefault(r.query, []).append((r.rank, r.vec_id, round(r.distance, 9)))
    for q in range(0, 90, 9):
        want = sorted((d(x[q], v), i) for i, v in points.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, round(w, 9)) for k, (w, i) in enumerate(want)]
    assert set(got) == set(range(0, 90, 9))
    two = B.nearest(df, df.where("vec_id = 0"), 3, metric, group="grp_", point_rows=10).collect()
    for g in "ab":
        want = sorted((d(x[0], x[i]), i) for i in range(1, 90) if "ab"[i % 2] == g)[:3]
        assert [r.vec_id for r in sorted(two, key=lambda r: r.rank) if r.grp == g] == [i for _, i in want]


def test_nearest_plan_and_empty(spark):
    df = vectors(spark, [(i, [float(i), 1.0]) for i in range(10)])
    out = B.nearest(df, df.where("vec_id < 2"), 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not B.nearest(df.limit(0), df, 2).collect() and not B.nearest(df, df.limit(0), 2).collect()
    assert len(B.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), 9).collect()) == 2  # fewer points than asked for


def test_quantiles_over_ranges(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.choice([rng.gauss(0, 1), 1.0])) for i in range(2000)] + [("none", None), ("one", 2.5), ("nan", float("nan"))]
    qs = [0.0, 0.05, 0.5, 1 / 3, 1.0]
    got = {r.g: (r.n, r.qs) for r in G.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", qs, parts=7).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, qs))


def test_places_sums_and_rank_statistic(spark):
    rng = random.Random(2)
    rows = [(i, round(rng.random(), 2), rng.random() < 0.3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s double, p boolean").repartition(4)
    placed = {r.id: (r._place, r._rows) for r in G.numbered(df, ["s", "id"], parts=6).collect()}
    assert placed == {i: (k, 500) for k, (_, i) in enumerate(sorted((s, i) for i, s, _ in rows))}
    pos, neg = [s for _, s, p in rows if p], [s for _, s, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    r = G.auc(df, "s", "p", parts=5).first()
    assert (r.n_pos, r.n_neg) == (len(pos), len(neg)) and abs(r.auc - want) < 1e-12
    assert G.auc(df.where("p"), "s", "p").first().auc is None and G.auc(df.limit(0), "s", "p").first().n_pos == 0


def test_sketch(spark):
    theta, qs = K.directions(3, 4, 1), K.levels(5)
    assert all(abs(sum(x * x for x in t) - 1) < 1e-12 for t in theta) and theta == K.directions(3, 4, 1) != K.directions(3, 4, 2)
    a, b = RNG.normal(size=(60, 3)), RNG.normal(size=(60, 3)) * 3 + 5
    rows = [(i, v.tolist(), g) for g, x in ((1, a), (2, b), (3, b - 5)) for i, v in enumerate(x)] + [(0, [1.0, 2.0, 3.0], 4), (1, None, 1), (2, [1.0], 1), (3, [float("inf"), 0.0, 0.0], 1), (4, [0.0] * 3, None)]
    df = vectors(spark, rows, ", g int")
    for centre in (False, True):
        got = {r.g: (r.n, np.array(r.sketch)) for r in K.sliced_sketch(df, ["g"], theta, qs, centre=centre).collect()}
        assert set(got) == {1, 2, 3}
        for g, x in ((1, a), (2, b)):
            p = x @ np.array(theta).T
            want = np.quantile(p - p.mean(0) if centre else p, qs, axis=0).T.ravel()
            assert got[g][0] == 60 and np.allclose(got[g][1], want)
        moved = np.abs(got[2][1] - got[3][1]).mean()
        assert moved < 1e-9 if centre else moved > 0.5  # the same shape elsewhere
    assert not K.sliced_sketch(df.limit(0), ["g"], theta, qs).collect()


def keys(spark, n=40, entities=8, noise=0.05):
    """Signatures that lie near their entity's own direction."""
    own = RNG.normal(size=(entities, 6))
    items = {b: [f"i{(b * 3 + j) % 20}" for j in range(8)] for b in range(5)}
    rows = [(i, i % entities, i % 5, items[i % 5], (own[i % entities] + noise * RNG.normal(size=6)).tolist(), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "key long, entity long, basket long, items array<string>, signature array<double>, rating double"), rows


def test_verification_tells_entities_apart(spark):
    df, rows = keys(spark)
    pairs = W.verification_pairs(df, fan=50, bucket=1000)
    got = {(r.kind, min(r.a, r.b), max(r.a, r.b)): r.distance for r in pairs.collect()}
    far = lambda x, y: 8 - len(set(x[3]) & set(y[3]))
    want = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[1] == y[1] and x[2] != y[2]:
                want["positive", x[0], y[0]] = far(x, y)
            if x[1] != y[1] and x[2] == y[2]:
                want["hard", x[0], y[0]] = far(x, y)
            if x[1] != y[1] and far(x, y) >= 3:
                want["easy", x[0], y[0]] = far(x, y)
    assert got == want  # with room for all partners every pair is dealt once
    report = {r.measure: r for r in W.verification_report(pairs).collect()}
    assert report["far_vs_easy"].auc > 0.95 and report["far_vs_hard"].auc > 0.95
    few = W.verification_pairs(df, fan=2, bucket=1000)
    assert few.groupBy("kind", "a").count().agg(F.max("count")).first()[0] <= 2


def test_retrieval_ranks(spark):
    df, rows = keys(spark, noise=1.0)
    got = {r.query: r["rank"] for r in W.retrieval(df, df, rows=7).collect()}
    unit = {x[0]: np.array(x[4]) / np.linalg.norm(x[4]) for x in rows}
    for q in rows:
        far = [(float(unit[q[0]] @ unit[k[0]]), k[1] == q[1]) for k in rows if 8 - len(set(q[3]) & set(k[3])) >= 3]
        own = [s for s, mine in far if mine]
        if own:
            assert got[q[0]] == 1 + sum(s > max(own) + 1e-12 for s, _ in far)
        else:
            assert q[0] not in got
    report = W.retrieval_report(W.retrieval(df, df)).first()
    assert report.queries == len(got) and abs(report.mrr - np.mean([1 / r for r in got.values()])) < 1e-12
    assert W.retrieval_report(W.retrieval(df.limit(0), df.limit(0))).first().queries == 0


def test_controls_fall_back_to_the_band(spark):
    df, rows = keys(spark)
    targets = df.where("key in (0, 39)").withColumn("reference", F.col("signature"))
    got = {r.key: r for r in W.percentile_among_controls(targets, df, least=8, width=6.0).collect()}
    same = [x for x in rows if x[2] == 0 and x[1] != 0]
    assert got[0].pool == ("basket" if len(same) >= 8 else "band") and got[0].percentile == 1.0
    none = W.percentile_among_controls(targets, df, least=1000, width=6.0).where("key = 39").first()
    assert none.pool == "band" and none.controls == sum(abs(x[5] - 39) < 6 and x[1] != 39 % 8 for x in rows)


def test_residual_weights_favour_what_is_stable(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        e = i % 20
        rows += [(i, e, i % 4, 0, e / 10 + rng.gauss(0, 0.1)), (i, e, i % 4, 1, rng.gauss(0, 1)), (i, e, i % 4, 2, 1.0), (i, e, i % 4, 3, None)]
    r = R.residualize(spark.createDataFrame(rows, "id long, entity long, basket long, feature int, value double"), ["basket"])
    w = {x.feature: x.weight for x in R.reliability_weights(r).collect()}
    assert w[0] > 0.9 and w[1] < 0.3 and w[2] == 0 and 3 not in w
    for x in R.residual_signatures(r, R.reliability_weights(r)).collect():
        assert len(x.signature) == 4 and abs(np.linalg.norm(x.signature) - 1) < 1e-9 and x.signature[2] == x.signature[3] == 0
    assert not R.residual_signatures(r.limit(0)).collect()


def test_verdict(spark):
    report = lambda *rows: R.verdict(spark.createDataFrame(rows, "variant string, auc double, low double")).first()
    assert tuple(report(("a", 0.6, 0.52), ("b", 0.7, 0.6))) == ("b", 0.7, 0.6, "PASS")
    assert report(("a", 0.54, 0.51)).result == "PARTIAL" and report(("a", 0.6, 0.49)).result == "KILL" and report(("a", None, None)).result == "KILL"
    assert report(("b", 0.6, 0.55), ("a", 0.6, 0.55)).variant == "a"
    low = R.with_bound(spark.createDataFrame([(50, 80, 0.8)], "n_pos long, n_neg long, auc double")).first().low
    q1, q2 = 0.8 / 1.2, 2 * 0.64 / 1.8
    assert abs(low - (0.8 - R.Z * math.sqrt((0.16 + 49 * (q1 - 0.64) + 79 * (q2 - 0.64)) / 4000))) < 1e-12
