"""Activity profiles and classifier, the critic, event features: invariants, planted signals, edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import activity as A
from matchloom.operators import critic as C
from matchloom.operators import event_features as X9

NOW = "2024-02-05 00:00:00"


def watched(spark, rows):
    return spark.createDataFrame(rows, "entity long, ts timestamp, scraped timestamp, rating int")


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour, minutes=minute)


def test_profile_and_features_by_hand(spark):
    rows = [(1, at(0, 10), None, 8000), (1, at(1, 10, 30), at(1, 10, 30), 12000), (1, at(3, 22), None, None), (2, at(0, 0), None, None), (None, at(0, 0), None, 1), (3, None, None, 1)]
    p = {r.entity: r for r in A.profiles(watched(spark, rows)).collect()}
    assert set(p) == {1, 2}
    assert (p[1].total, p[1].rating, p[1].mean_day, p[1].hours[10], p[1].hours[22], p[1].hours[0], p[1].days[3]) == (3, 10000, 1, 2, 1, 0, 1)
    f = {(r.entity, r.hour): r for r in A.features(A.at_hours(A.profiles(watched(spark, rows))), NOW).collect()}
    assert len(f) == 48
    x = f[1, 10]
    assert x.hour_share == pytest.approx(2 / 3) and x.rating == pytest.approx(3 / 8) and x.per_day == pytest.approx(3 / 3.5)
    assert x.since_last == 720.0 and x.since_scraped == 720.0 and f[2, 5].per_day == 0 and f[2, 5].rating == 0.5
    early = A.features(A.at_hours(A.profiles(watched(spark, rows))), "2024-01-05 00:00:00").where("entity = 1 and hour = 0").first()
    assert early.since_last == pytest.approx(2.0) and early.since_scraped == pytest.approx(61.5)
    assert (f[1, 6].hour_sin, f[1, 12].hour_cos) == (pytest.approx(1), pytest.approx(-1))


def test_training_rows(spark):
    rows = [(1, at(0, 9, i), None, 1) for i in range(35)] + [(1, at(2, 9 + h), None, 1) for h in (3, 5, 6)] + [(2, at(0, 1), None, 1)] * 4
    t = A.training_rows(A.profiles(watched(spark, rows)))
    hourly = t.where("kind = 'hour'").groupBy("hour").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label")).collect()
    assert {r.hour: (r.n, r.label) for r in hourly} == {h: (3, 1) if h == 9 else (1, int(h in (12, 14, 15))) for h in range(24)}
    cross = {(r.hour, r.day): r.label for r in t.where("kind = 'cross'").collect()}
    assert cross == {(h, d): int(d in (0, 2)) for h in (9, 12, 14) for d in range(7)}
    assert t.where("entity = 2").count() == 0  # too few events
    assert not A.training_rows(A.profiles(watched(spark, []))).collect()


def test_classifier_finds_the_hours(spark):
    rng = random.Random(1)
    rows = [(e, at(rng.randrange(28), (8 + e % 3 + rng.randrange(5)) % 24), None, 9000) for e in range(40) for _ in range(60)]
    t = A.held_out(A.features(A.training_rows(A.profiles(watched(spark, rows))), NOW)).cache()
    assert t.groupBy("entity", "hour", "day", "kind").agg(F.count_distinct("validation").alias("n")).where("n > 1").count() == 0
    model = A.fit_activity(t, trees=8)
    r = {x.measure: x.value for x in A.activity_report(spark, model, t).collect()}
    assert r["auc"] > 0.9 and r["accuracy"] > 0.85 and sum(v for k, v in r.items() if k.startswith("importance_")) == pytest.approx(1)
    share = t.where("label = 1").agg(F.avg(F.col("validation").cast("int"))).first()[0]
    assert 0.1 < share < 0.3 and r["train_rows"] + r["validation_rows"] == t.count()
    p = A.score_activity(model, A.features(A.at_hours(A.profiles(watched(spark, rows))), NOW)).agg(F.min("p"), F.max("p"), F.count("p")).first()
    assert 0 <= p[0] < 0.3 and 0.7 < p[1] <= 1 and p[2] == 40 * 24


def test_critic_sees_a_planted_signal(spark):
    rng = random.Random(2)
    rows = []
    for i in range(800):
        skill, noise = rng.gauss(0, 1), rng.random()
        won = int(rng.random() < 1 / (1 + 2.718281828 ** (-2 * skill)))
        rows.append((i, noise, skill, won, noise - won))
    df = C.time_split(spark.createDataFrame(rows, "id long, base double, extra double, won int, residual double").repartition(5), ["id"])
    assert df.where("validation").agg(F.min("id"), F.count("id")).first() == (640, 160)
    scores = C.outcome_lift(df, "won", {"base": ["base"], "augmented": ["base", "extra"]}, trees=20)
    up = C.lift(scores, "base", "augmented").first()
    assert up.auc_lift > 0.1 and up.log_loss_lift < 0 and up.brier_lift < 0
    r = C.residual_regression(df, "residual", ["extra"], trees=20).first()
    assert r.n == 160 and r.r2 > 0.1 and r.mae < r.base_mae
    q = {x.quartile: x for x in C.residual_by_quartile(df, "extra", "won", "base").collect()}
    assert sorted(q) == [1, 2, 3, 4] and q[1].residual > q[4].residual and sum(x.n for x in q.values()) == 800
    same = spark.createDataFrame([(1.0, 1, 0.5)] * 5 + [(None, 1, 0.5)], "x double, y int, p double")
    assert [(x.quartile, x.n) for x in C.residual_by_quartile(same, "x", "y", "p").collect()] == [(1, 5)]


def test_event_features_by_hand_and_padding(spark):
    rows = [
        (1, 1, "team", "spell", 56, 8750, 15750, 4, False), (1, 2, "opponent", "a", 60, 8750, 15750, 6, True),
        (1, 3, "team", "a", 200, 0, 31500, None, False), (1, 4, "team", "zzz", 9600 * 2, 17500, 0, 2, False),
    ]
    e = spark.createDataFrame(rows, "match_id long, event_id long, side string, item string, tick int, x int, y int, cost int, ability boolean")
    context = spark.createDataFrame([(1, 0.5, 0.25)], "match_id long, gap double, ratio double")
    types = F.when(F.col("item") == "spell", "spell").when(F.col("item") == "a", "troop")
    f = X9.event_features(e, context, types, "spell", F.when(F.col("x") > 0, 7.0))
    got = {r.event_id: r for r in f.collect()}
    assert (got[1].side, got[1].x, got[1].y, got[1].lane_center, got[1].type_spell, got[1].cost, got[1].own, got[1].gap, got[1].ratio) == (1, 0, 0, 1, 1, 0.4, pytest.approx(0.6), 0.5, 0.25)
    # the spell of tick 56 lands at 146: what it did counts at the first event from then on, not at its own
    assert (got[1].connect, got[1].zone, got[3].connect, got[3].zone) == (0, 0, pytest.approx(0.6), pytest.approx(0.7))
    assert (got[4].tick, got[4].type_troop, got[4].lane_right, got[3].cost, got[2].ability, got[3].play) == (1, 0, 1, 0.4, 1, pytest.approx(2 / 60))
    index = spark.createDataFrame([("a", 2), ("spell", 3)], "item string, index int")
    p = X9.padded(f, X9.FEATURES, 6, index).first()
    assert (p.n, p["items"], p["mask"]) == (4, [3, 2, 2, 1, 0, 0], [1, 1, 1, 1, 0, 0]) and len(p.features) == 6 and p.features[5] == [0.0] * 24 and len(X9.FEATURES) == 24
    cut = X9.padded(f, X9.FEATURES, 2, index).first()
    assert (cut.n, cut["items"]) == (2, [3, 2])
    assert not X9.padded(f.limit(0), X9.FEATURES, 3, index).collect()
