"""Every registered query of the library against its SQL in DuckDB; those without SQL against what must hold of their rows."""

import numpy as np
import pandas as pd
import pytest

from matchloom import registry

from .compare import rows
from .conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def events(duck) -> pd.DataFrame:
    from matchloom.sources.views import E_SQL

    return duck.execute(f"with {E_SQL} select * from e order by match_id, tick, event_id").df()


def trace(got, duck):
    """A unit every four ticks, ten at most: play by play."""
    want = {}
    for (m, side), g in events(duck).groupby(["match_id", "side"]):
        v, t, over, short = 5.0, 0, 0.0, 0.0
        for tick, cost in zip(g["tick"], g["cost"]):
            grown = v + (tick - t) * 0.25
            over += max(0, grown - 10)
            left = min(grown, 10) - cost
            short += max(0, -left)
            v, t = max(0, left), tick
        want[m, side] = (len(g), g["cost"].sum(), v, over, short)
    assert {(r.match_id, r.side) for r in got.itertuples()} == set(want)
    for r in got.itertuples():
        assert np.allclose((r.n, r.spent, r.left, r.overflow, r.short), want[r.match_id, r.side])


def distant(got, duck):
    want = {}
    for m, g in events(duck).groupby("match_id"):
        kept = []
        for t in g["tick"]:
            if all(abs(t - k) >= 500 for k in kept):
                kept.append(t)
        want[m] = ",".join(map(str, kept))
    assert dict(zip(got["match_id"], got["kept"])) == want


def masked(got, duck):
    share = got.groupby("match_id")["cost"].apply(lambda c: c.isna().mean())
    assert set(share) == {0.0, 1.0} and 0.1 < share.mean() < 0.2  # whole matches, about 15 %


def bootstrap(got, duck):
    r, c = got.iloc[0], events(duck)["cost"]
    assert r["low"] < r["mean"] < r["high"] and abs(r["mean"] - c.mean()) < 2 * c.std() / len(c) ** 0.5 and r["high"] - r["low"] < 8 * c.std() / len(c) ** 0.5


def draws(got, duck):
    m = duck.execute("select o_orderpriority as kind, count(*) filter (o_orderstatus = 'F') as w, count(*) filter (o_orderstatus = 'O') as l from orders group by 1").df().set_index("kind")
    for kind, g in got.groupby("kind"):
        w, l = m.loc[kind, "w"], m.loc[kind, "l"]
        assert len(g) == 50 and g["value"].between(0, 1).all() and abs(g["value"].mean() - (w + 1) / (w + l + 2)) < 0.05


def clusters(got, duck):
    assert got["vec_id"].is_unique and len(got) == 500 and set(got["cluster"]) <= {-1, *range(8)} and 0.02 < (got["cluster"] == -1).mean() < 0.09 and (got["distance"] >= 0).all()
    edge = got[got["cluster"] >= 0]["distance"].max()
    assert got[got["cluster"] == -1]["distance"].max() >= edge  # the farthest row is noise


def reduced(got, duck):
    x = np.array(got["reduced"].tolist())
    assert x.shape == (500, 3) and np.allclose(x.mean(0), 0, atol=1e-6)
    c = np.cov(x.T)
    assert np.allclose(c - np.diag(np.diag(c)), 0, atol=1e-6) and (np.diff(np.diag(c)) <= 1e-9).all()  # uncorrelated, the widest first


def scored(got, duck):
    assert len(got) == 1000 and got["p"].between(0, 1).all() and 0.15 < got["validation"].mean() < 0.25


def swapped(got, duck):
    e = events(duck).set_index("event_id")
    other = got[got["event_id"].map(e["cost"]) != 9]
    assert len(got) == 1000 and (other["delta"] == 0).all() and got["delta"].between(-1, 1).all()


def batch(got, duck):
    assert len(got) == 30 and got["entity"].is_unique


def intervals(got, duck):
    assert ((got["low"] < got["mean"]) & (got["mean"] < got["high"])).all() and got[["low", "high"]].stack().between(0, 1).all()


def report(got, duck):
    v = dict(zip(got["measure"], got["value"]))
    assert abs(sum(x for k, x in v.items() if k.startswith("importance_")) - 1) < 1e-4 and 0 <= v["auc"] <= 1 and 0 <= v["accuracy"] <= 1
    assert v["train_rows"] + v["validation_rows"] == len(duck.execute(registry.ORACLE["f14_activity_training"]).df())


def hours(got, duck):
    assert len(got) == 24 * 15 and got["p"].between(0, 1).all() and not got.duplicated(["entity", "hour"]).any()


def lift(got, duck):
    assert set(got["variant"]) == {"base", "augmented", "context"} and set(got["n"]) == {int(duck.execute(registry.ORACLE["j14_time_split"]).df()["validation"].sum())}
    assert got["auc"].between(0, 1).all() and (got["log_loss"] > 0).all() and got["brier"].between(0, 1).all()


def regression(got, duck):
    r = got.iloc[0]
    assert r["n"] == duck.execute(registry.ORACLE["j14_time_split"]).df()["validation"].sum() and r["r2"] < 1 and r["mae"] > 0 and r["base_mae"] > 0


def sweep(got, duck):
    assert sorted(got["k"]) == [4, 8] and (got["clusters"] <= got["k"]).all() and got["noise"].between(0.01, 0.1).all() and (got["largest"] >= (1 - got["noise"]) / got["k"] - 1e-9).all()


def finite(got, duck):
    assert len(got) == 1 and np.isfinite(got.to_numpy()).all()


CHECKS = {
    "c13_resource_trace": trace, "f18_mask_rows": masked, "f1_beta_interval": intervals, "f3_sample_beta": draws, "g15_select_batch": batch, "j10_bootstrap": bootstrap,
    "j14_outcome_lift": lift, "j14_residual_regression": regression, "j20_distant_subset": distant, "j26_swap": swapped, "j32_sweep": sweep, "j3_reduce": reduced,
    "j4_cluster": clusters, "j5_activity_report": report, "j5_activity_scores": hours, "j6_score_events": scored, "j7_platt": finite,
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_holds(spark, duck, name):
    CHECKS[name](registry.QUERIES[name](spark, DATA).toPandas(), duck)
