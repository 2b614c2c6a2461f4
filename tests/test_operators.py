"""Hand-computed values and invariants of operators that SQL cannot state."""

import random

import numpy as np
from pyspark.sql import functions as F

from matchloom.functions import expressions as X
from matchloom.operators import baskets as B
from matchloom.operators import impact as M
from matchloom.operators import sequences as S


def test_beta_quantiles():
    assert np.allclose(B.beta_quantile([0.025, 0.975], 1, 1), [0.025, 0.975], atol=1e-9)
    low, high = B.beta_quantile([0.1, 0.9], 7, 7)
    assert abs(low + high - 1) < 1e-9
    assert abs(B.beta_quantile(0.025, 12, 1) - 0.025 ** (1 / 12)) < 1e-9


def test_resource_trace(spark):
    e = spark.createDataFrame([(1, "team", 10, 1, 4), (1, "team", 50, 2, 3), (1, "team", 51, 3, 9)], "match_id long, side string, tick int, event_id long, cost int")
    r = S.resource_trace(e, F.lit(0.5), 10.0, 5.0).first()
    # 5 + 5 = 10, -4 = 6; + 20 capped at 10 (16 over), -3 = 7; + 0.5 = 7.5, -9 is 1.5 short
    assert (r.n, r.spent, r.left, r.overflow, r.short) == (3, 16, 0.0, 16.0, 1.5)


def test_basket_counts_gather_bits(spark):
    rng = random.Random(11)
    for names in ("abcdefgh", [f"i{k}" for k in range(62)], [f"i{k}" for k in range(70)]):
        rows = [(m, rng.choice(names), rng.randint(0, 1)) for m in range(300) for _ in range(rng.randint(0, 4))] + [(900, None, 1), (901, None, 1), (901, names[-1], 1), (902, names[0], 0)]
        want = {}
        for m in {m for m, _, p in rows if p}:
            basket = tuple(sorted({i for k, i, p in rows if k == m and p and i is not None}))
            want[basket] = want.get(basket, 0) + 1
        r = spark.createDataFrame(rows, "match_id long, item string, is_player int").repartition(3)
        out = B.basket_counts(r.distinct(), spark.createDataFrame([(x,) for x in names], "item string"))
        got = [(tuple(x["items"]), x["n"]) for x in out.collect()]
        assert len(got) == len(want) and dict(got) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("ObjectHashAggregate" in plan) == (len(names) > 62)


def test_greedy_clusters_by_hand(spark):
    c = spark.createDataFrame([("g", ["a", "b", "c"], 5), ("g", ["a", "b", "d"], 3), ("g", ["x", "y"], 4)], "g string, items array<string>, n int")
    got = {tuple(r.items_): r.cluster for r in B.greedy_clusters(c.withColumnRenamed("g", "anchor"), "anchor", 0.5).withColumnRenamed("items", "items_").collect()}
    assert got == {("a", "b", "c"): 0, ("x", "y"): 1, ("a", "b", "d"): 0}


def test_greedy_clusters_equal_the_loop(spark):
    rng = random.Random(3)
    rows = {(rng.choice("pq"), tuple(sorted(rng.sample("abcdefgh", rng.randint(1, 5))))): rng.randint(1, 4) for _ in range(150)}
    rows |= {("chain", tuple("abcdefghijklmnop"[k : k + 6])): 100 - k for k in range(10)}  # each is similar to its neighbours only
    got = {}
    for r in B.greedy_clusters(spark.createDataFrame([(g, list(i), n) for (g, i), n in rows.items()], "g string, items array<string>, n int").repartition(3), "g", 0.6).collect():
        got[r.g, tuple(r["items"])] = r.cluster
    for group in ("p", "q", "chain"):
        founders = []
        for items in sorted((i for g, i in rows if g == group), key=lambda i: (-rows[group, i], "\x1f".join(i))):
            hit = next((k for k, f in enumerate(founders) if len(set(items) & f) >= 0.6 * len(set(items) | f) - 1e-12), None)
            if hit is None:
                hit = len(founders)
                founders.append(set(items))
            assert got[group, items] == hit
    assert len(got) == len(rows)
    odd = spark.createDataFrame([("g", [], 1), ("g", None, 2), (None, ["a"], 1), ("g", ["a"], 1)], "g string, items array<string>, n int")
    assert B.greedy_clusters(odd, "g", 0.5).count() == 4 and not B.greedy_clusters(odd.limit(0), "g", 0.5).collect()


def test_greedy_clusters_read_their_input_once(spark, tmp_path):
    """What the result is built on is written tables; the input, which can be a whole table's joins, is not computed again."""
    path = str(tmp_path / "baskets")
    spark.createDataFrame([("g", ["a", "b", "c"], 5), ("g", ["a", "b", "d"], 3), ("h", ["x", "y"], 4)], "g string, items array<string>, n int").write.parquet(path)
    out = B.greedy_clusters(spark.read.parquet(path), "g", 0.5)
    assert out.inputFiles() and not [f for f in out.inputFiles() if path in f]
    assert sorted((r.g, r.n, r.cluster) for r in out.collect()) == [("g", 3, 0), ("g", 5, 0), ("h", 4, 0)]


def test_similar_sets_of_a_group_once_each(spark):
    rng = random.Random(8)
    for letters, t in (("abcdefghij", 0.3), ("abcdefghij", 0.55), ([f"i{k}" for k in range(80)], 0.2)):  # few items are bits of a mask, many are not
        sets = {i: (rng.choice("pq"), set(rng.sample(letters, rng.randint(1, 7)))) for i in range(120)}
        df = spark.createDataFrame([(i, g, list(s)) for i, (g, s) in sets.items()], "id long, g string, items array<string>")
        for within in (None, "g"):
            want = {(a, b) for a, (g, s) in sets.items() for b, (h, u) in sets.items() if a < b and (not within or g == h) and len(s & u) >= t * len(s | u) - 1e-12}
            got = [(r.a, r.b) for r in B.jaccard_join(df, t, within).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_asof_plan_builds_no_pairs(spark):
    a = spark.createDataFrame([(1, 5)], "k int, t int")
    b = spark.createDataFrame([(1, 3, 9)], "k int, u int, v int")
    out = S.asof_join(a, b, ["k"], "t", "u", ["v"])
    assert out.first().v == 9
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_range_join_has_equi_key(spark):
    a = spark.createDataFrame([(1, 5), (1, 9)], "k int, t int")
    b = spark.createDataFrame([(1, 7), (1, 30)], "k int, u int")
    out = S.range_join(a, b, ["k"], "t", "u", -2, 2)
    assert sorted((r.t, r.u) for r in out.collect()) == [(5, 7), (9, 7)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_first_match_wins(spark):
    rules = [("a", ["p", "q"], 2), ("b", ["p"], 1)]
    df = spark.createDataFrame([(["p", "q"],), (["p"],), (["z"],), (None,)], "i array<string>")
    assert [r[0] for r in df.select(X.classify_basket(F.col("i"), rules)).collect()] == ["a", "b", "other", "other"]


def test_sampling_is_deterministic(spark):
    c = spark.createDataFrame([("a", 3, 4), ("b", 0, 9)], "k string, wins long, losses long")
    one, two = (sorted(map(tuple, B.sample_beta(c.repartition(n), 20, 3).collect())) for n in (1, 3))
    assert one == two and all(0 < v < 1 for _, _, v in one)


def test_impact_sums_in_the_order_of_events(spark):
    """0.1 + 0.2 + 0.3 is over 0.6, 0.3 + 0.2 + 0.1 is not: who carries must not hang on how rows come."""
    rows = [(1, "a", "team", x, i) for i, x in enumerate((0.1, 0.2, 0.3))] + [(1, "b", "team", 0.6, 9)]
    want = [("a", 0.1 + 0.2 + 0.3, 1, 0), ("b", 0.6, 0, 1)]
    for given in (rows, rows[::-1], [rows[i] for i in (1, 3, 2, 0)]):
        wp = spark.createDataFrame(given, "match_id long, item string, side string, wpa double, tick int").repartition(3, "tick")
        got = M.impact_by_side(wp, ["tick"]).collect()
        assert sorted((r.item, r.impact, r.carry, r.liability) for r in got) == want
