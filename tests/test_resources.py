"""Capped resources: hand-computed values, a literal tick loop, small segments, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import resources as P

SCHEMA = "match_id long, side string, tick int, event_id long, cost int, y int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def by_event(df):
    return {r.event_id: r for r in df.collect()}


def test_hand_computed(spark):
    rows = [(1, "team", 56, 1, 4), (1, "opponent", 112, 2, 3), (1, "team", 2400, 3, 9), (1, "team", 2428, 4, 5), (1, "opponent", 2456, 5, None)]
    s = by_event(P.resource_states(frame(spark, rows)))
    near = lambda x: pytest.approx(x, abs=1e-9)
    # a unit a 56 ticks: 5 + 1 = 6, pays 4; 2344 ticks later the cap of 10 (2 + 41.857 overflows by 33.857), pays 9; a unit a 28 ticks from 2400 on: 2, pays 5
    assert (s[1].before, s[1].after, s[1].overflow) == (near(6), near(2), near(0))
    assert (s[3].before, s[3].after, s[3].overflow) == (near(10), near(1), near(2 + 2344 / 56 - 10))
    assert (s[4].before, s[4].after) == (near(2), near(0))  # what is missing is forgiven
    assert (s[2].before, s[5].before, s[5].after) == (near(7), near(10), near(10))
    at = by_event(P.resource_at_events(P.resource_states(frame(spark, rows))))
    assert (at[1].other, at[2].other, at[4].own, at[4].other) == (near(6), near(3), near(2), near(10))
    assert at[5].differential == near(10 - 1)
    total = {r.side: r for r in P.resource_overflow(P.resource_states(frame(spark, rows))).collect()}
    assert total["team"].spent == 18 and total["team"].overflow == near(2 + 2344 / 56 - 10)
    assert total["opponent"].overflow == near(4 + 2288 / 56 + 2 - 10)


def loop(rows, ahead):
    """The curve tick by tick: every tick regrows, then its plays are paid, and whole seconds are read off."""
    out = {}
    rate = lambda t: next(r for lo, hi, r in P.SCHEDULE if lo <= t < hi)
    for match in {r[0] for r in rows}:
        end = max(r[2] for r in rows if r[0] == match) + P.SECOND
        for side in ("team", "opponent"):
            plays = sorted((r[2], r[3], r[4] or 0) for r in rows if r[:2] == (match, side))
            x = P.START
            for t in range(end + 1):
                x = min(P.CAP, x + (rate(t) if ahead else rate(t - 1) if t else 0))
                for cost in [c for u, _, c in plays if u == t]:
                    x = max(0, x - cost)
                if t % P.SECOND == 0:
                    out[match, side, t] = x
    return out


@pytest.mark.parametrize("ahead,span,block", [(0, 600, 64), (1, 50, 2), (1, 10_000, 3)])
def test_curve_equals_the_tick_loop(spark, ahead, span, block):
    rng = random.Random(span)
    rows = [(m, rng.choice(["team", "opponent"]), rng.randrange(0, 4000), i, rng.choice([None, 1, 3, 5, 9, 12])) for m in range(3) for i in range(m * 100, m * 100 + 40)]
    rows += [(7, "team", 100, 900 + i, 1) for i in range(30)]  # one side alone, all at one tick
    want = loop(rows, ahead)
    states = P.resource_states(frame(spark, rows).repartition(3), ahead=ahead, span=span, block=block)
    got = {(r.match_id, r.side, r.at): r.level for r in P.resource_curve(states, ahead=ahead).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_average_keeps_times_of_enough_matches(spark):
    rows = [(m, "team", 40 * m, m, 5) for m in range(1, 8)]
    curve = P.resource_curve(P.resource_states(frame(spark, rows)))
    groups = spark.createDataFrame([(m, "g") for m in range(1, 8)], "match_id long, by string")
    got = {r.at: (r.mean, r.n) for r in P.average_differential(curve, groups, "by").collect()}
    assert max(got) == 40 * 6 + 20 and got[0] == (0.0, 7) and got[260][1] == 2  # two of seven matches last so long
    assert got[40][0] == pytest.approx(-5 / 7)


def test_empty_and_nulls(spark):
    states = P.resource_states(frame(spark, []))
    assert not states.collect() and not P.resource_curve(states).collect() and not P.resource_at_events(states).collect()
    assert P.resource_states(frame(spark, [(1, "team", None, 1, 2), (None, "team", 5, 2, 2)])).where(F.col("tick").isNull()).count() == 0
