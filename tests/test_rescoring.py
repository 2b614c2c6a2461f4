"""Versioned rescoring: batches that die between their writes leave no orphan and lose nothing."""

import uuid

import pytest
from pyspark.sql import functions as F

from matchloom.operators.rescoring import ScoreStore


@pytest.fixture
def store(spark):
    s = ScoreStore(spark, f"t_{uuid.uuid4().hex}", buckets=2)
    rows = spark.createDataFrame([(m, e, float(m), None if m == 1 else m % 3) for m in range(1, 13) for e in range(m % 4 + 1)], "match_id long, event_id int, p double, version int")
    s.create(rows, summary(rows).join(rows.select("match_id", "version").distinct(), "match_id"))
    yield s
    s.drop()


def summary(rows):
    return rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


def anew(rows):
    return rows.where("match_id != 7").withColumn("p", F.col("p") + 100)


def found(store):
    return sorted((r.match_id, r.event_id, r.version, r.p) for r in store.current().collect())


def all_rows(store):
    return sorted((r.match_id, r.event_id, r.version) for r in store.table("rows").collect())


WANT = sorted((m, e, 2, float(m if m % 3 == 2 else m + 100)) for m in range(1, 13) if m != 7 for e in range(m % 4 + 1))


@pytest.mark.parametrize("fail", [None, "rows", "summary"])
def test_a_dead_batch_leaves_no_orphan_and_loses_nothing(store, fail):
    before = {(m, e) for m, e, *_ in found(store)}
    if fail:
        with pytest.raises(RuntimeError):
            store.rescore(2, anew, summary, fail=fail)
        assert {(m, e) for m, e, *_ in found(store)} >= {x for x in before if x[0] != 7}  # readers miss nothing meanwhile
        versions = {}
        for m, e, v, _ in found(store):
            versions.setdefault(m, set()).add(v)
        assert all(len(v) == 1 for v in versions.values())
    store.rescore(2, anew, summary)
    assert found(store) == WANT
    assert all_rows(store) == [(m, e, 2) for m, e, _, _ in WANT]  # and nothing else lies in the table
    assert sorted((r.match_id, r.version) for r in store.table("summary").collect()) == sorted({(m, 2) for m, *_ in WANT})
    assert store.rescore(2, anew, summary) == 0


def test_batches_and_sweep(store):
    assert store.rescore(2, anew, summary, batches=1) == 1
    assert store.sweep() == 0
    mixed = {(r.version) for r in store.current().collect()}
    assert 2 in mixed and len(mixed) > 1
    store.rescore(2, anew, summary)
    assert found(store) == WANT


def test_sweep_spares_matches_that_wait(store):
    with pytest.raises(RuntimeError):
        store.rescore(2, anew, summary, fail="summary")
    old = [r for r in store.table("rows").collect() if r.version < 2]
    waiting = {r.match_id for r in store.newest().where("version < 2").collect()}
    gone = store.sweep()
    assert gone == len([r for r in old if r.match_id not in waiting]) > 0
    left = [r for r in store.table("rows").collect() if r.version < 2]
    assert {r.match_id for r in left} <= waiting
