"""Fingerprints: hand-computed values, gates, edge cases."""

import pytest
from pyspark.sql import functions as F

from matchloom.operators import pilots as P

SCHEMA = "match_id long, side string, tick int, event_id long, cost int, y int"


def games(n, y=10000, react=10, gap=100):
    rows = []
    for m in range(n):
        for k in range(5):
            rows += [(m, "opponent", 100 + gap * k - react, m * 100 + 2 * k, 3, 20000), (m, "team", 100 + gap * k, m * 100 + 2 * k + 1, 4, y)]
    return rows


def frames(spark, rows):
    e = spark.createDataFrame(rows, SCHEMA)
    return e, e.select("match_id").distinct().withColumn("entity", F.lit("p"))


def test_by_hand(spark):
    r = P.fingerprint(*frames(spark, games(10))).first()
    near = pytest.approx
    # a play of 4 units every 100 ticks, 10 after the other side's: 20 units in 400 ticks
    assert (r.games, r.pace, r.throughput, r.reaction, r.pace_consistency, r.defence_reaction, r.fast_share) == (10, near(25), near(50), near(10), near(0), near(10), near(1))
    slow = P.fingerprint(*frames(spark, games(10, y=20000, react=60))).first()
    assert (slow.reaction, slow.defence_reaction, slow.fast_share) == (near(60), near(60), near(0))  # no play in the own half


def test_gates_and_gaps(spark):
    assert not P.fingerprint(*frames(spark, games(7))).collect()
    assert P.fingerprint(*frames(spark, games(7)), gates=(7, 20, 10)).count() == 1
    assert not P.fingerprint(*frames(spark, games(10, gap=1300))).collect()  # gaps too long to be paced
    assert not P.fingerprint(*frames(spark, games(10, react=-5))).where("reaction <= 5").collect()
    lone = [(m, "team", 100, m, 4, 1) for m in range(20)]
    assert not P.fingerprint(*frames(spark, lone)).collect() and not P.fingerprint(*frames(spark, [])).collect()
    odd = games(10) + [(0, "team", None, 9999, 4, 1), (1, "team", 5000, 9998, None, None), (None, "team", 1, 9997, 1, 1)]
    assert P.fingerprint(*frames(spark, odd)).first().pace == pytest.approx(25)
