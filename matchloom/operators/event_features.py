"""Every event of a match as 24 numbers, and matches as padded sequences of them with masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import resources as P
from . import sequences as S

#: Ticks, plays and units that count as one, the middle of the field, how far from it the centre lane reaches, the cost of an item without one.
TICKS, PLAYS, UNITS, MIDDLE_X, MIDDLE_Y, LANE, COST = 9600, 60, 10.0, 8750, 15750, 2000, 4
TYPES = ("troop", "spell", "building")
#: Ticks from a spell's play to its impact, after the play in which a target may stand, and its radius.
IMPACT, TICKS_AROUND, RADIUS = 90, 200, 6000
BASE = [
    "side", "tick", *(f"phase_{p}" for p in X.PHASES), "x", "y", "lane_left", "lane_right", "lane_center", "play", "ability", "cost", *(f"type_{t}" for t in TYPES),
]
FEATURES = [*BASE, "own", "other", "differential", "gap", "ratio", "connect", "zone"]


def deliver(values: DataFrame, e: DataFrame) -> DataFrame:
    """(match_id, event_id, value): values(match_id, impact, value) credited to the first event at or after the impact, or to the match's last one."""
    hit = S.asof_join(values, e.groupBy("match_id", F.col("tick").alias("t")).agg(F.min("event_id").alias("to")), ["match_id"], "impact", "t", ["to"], backward=False)
    last = e.groupBy("match_id").agg(F.max_by("event_id", F.struct("tick", "event_id")).alias("last"))
    return hit.join(last, "match_id").groupBy("match_id", F.coalesce("to", "last").alias("event_id")).agg(F.sum("value").alias("value"))


def event_features(e: DataFrame, context: DataFrame, types: Column, spell: str, zone: Column) -> DataFrame:
    """(match_id, event_id, tick, item, FEATURES…) of events e(match_id, event_id, side, item, tick, x, y, cost, ability).

    types gives an item's type, `spell` the item whose plays of the own side hit an area, zone the value of a place they hit. context(match_id, gap,
    ratio) holds what is known before the match, 0 where it is not. Places are turned to one orientation first; what a side holds comes from the capped
    trace; what a spell did counts at its impact, never before. Unknown types give zeros, a null cost counts as 4.
    """
    played = e.withColumn("cost", F.coalesce("cost", F.lit(COST)))
    o = S.orient(played)
    order = Window.partitionBy("match_id", "side").orderBy("tick", "event_id")
    held = P.resource_at_events(P.resource_states(played)).select("event_id", "own", "other", "differential")
    own_spells = played.where((F.col("side") == "team") & (F.col("item") == spell))
    reach = S.area_connect(played, spell, TICKS_AROUND, RADIUS).where("value is not null")
    connect = deliver(own_spells.join(reach, "event_id").select("match_id", (F.col("tick") + IMPACT).alias("impact"), F.col("value").cast("double").alias("value")), played)
    chip = deliver(own_spells.withColumn("value", zone.cast("double")).where("value is not null").select("match_id", (F.col("tick") + IMPACT).alias("impact"), "value"), played)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    phase = X.phase("tick")
    base = o.select(
        "match_id", "event_id", F.col("tick").alias("_tick"), "item",
        flag(F.col("side") == "team").alias("side"), F.least(F.col("tick") / TICKS, F.lit(1.0)).alias("tick"),
        *(flag(phase == p).alias(f"phase_{p}") for p in X.PHASES),
        ((F.col("x") - MIDDLE_X) / MIDDLE_X).alias("x"), ((F.col("y") - MIDDLE_Y) / MIDDLE_Y).alias("y"),
        flag(F.col("x") < MIDDLE_X - LANE).alias("lane_left"), flag(F.col("x") > MIDDLE_X + LANE).alias("lane_right"), flag(F.col("x").between(MIDDLE_X - LANE, MIDDLE_X + LANE)).alias("lane_center"),
        (F.least(F.row_number().over(order), F.lit(PLAYS)) / PLAYS).alias("play"), flag(F.col("ability")).alias("ability"), (F.col("cost") / UNITS).alias("cost"),
        *(flag(types == t).alias(f"type_{t}") for t in TYPES),
    )
    out = base.join(held, "event_id", "left").join(context.select("match_id", "gap", "ratio"), "match_id", "left")
    out = out.join(connect.select("event_id", F.col("value").alias("connect")), "event_id", "left").join(chip.select("event_id", F.col("value").alias("zone")), "event_id", "left")
    scaled = [(F.coalesce(c, F.lit(0.0)) / UNITS).alias(c) for c in ("own", "other", "differential")]
    rest = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("gap", "ratio")] + [(F.coalesce(c, F.lit(0.0)) / UNITS).alias(c) for c in ("connect", "zone")]
    return out.select("match_id", "event_id", F.col("_tick"), "item", *BASE, *scaled, *rest).withColumnRenamed("_tick", "at")


def padded(f: DataFrame, features: Sequence[str], length: int, index: DataFrame, unknown: int = 1) -> DataFrame:
    """(match_id, n, items array<int>, features array<array<double>>, mask array<int>): the first `length` events of each match in order of (at, event_id),
    items as numbers of index(item, index) (`unknown` elsewhere), filled up with 0 to `length`; n is how many are real. Later events are cut where the window
    numbers them, before anything is gathered, so a row never holds more than `length`."""
    w = Window.partitionBy("match_id").orderBy("at", "event_id")
    first = f.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= length).join(index, "item", "left")
    row = F.struct("_i", F.coalesce("index", F.lit(unknown)).cast("int").alias("item"), F.array(*features).alias("f"))
    g = first.groupBy("match_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(row)).alias("z"))
    gap = F.lit(length) - F.col("n")
    zeros = F.array_repeat(F.array(*(F.lit(0.0) for _ in features)), gap)
    return g.select(
        "match_id", "n", F.concat(F.transform("z", lambda s: s["item"]), F.array_repeat(F.lit(0), gap)).alias("items"),
        F.concat(F.transform("z", lambda s: s["f"]), zeros).alias("features"), F.concat(F.array_repeat(F.lit(1), F.col("n")), F.array_repeat(F.lit(0), gap)).alias("mask"),
    )
