"""Capped resources that regrow over time: what each side holds at every play, each second and on average.

With G(t) regrown by tick t, a side that holds x has the potential y = x - G(t), which only plays and the cap change. A play of cost c at t
maps y to min(hi, max(lo, y - c)) with lo = -G(t) and hi = max(0, cap - c) - G(t). Such clamp functions are closed under
composition, so a side's plays are folded in small segments, each to one function; the segments are folded to the potential each begins
with, and the plays of a segment follow from that. A match of n plays puts n / BLOCK segments into one row, and no task sees more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import regenerated

#: Ticks a second, most and first units held, and the units regrown a tick in each phase (from, to, rate).
SECOND, CAP, START = 20, 10.0, 5.0
SCHEDULE = ((0.0, 2400.0, 1 / 56), (2400.0, 3600.0, 1 / 28), (3600.0, 1e18, 1 / 18.66))
#: Ticks of a segment, and plays of one: plays of one side in SPAN ticks beyond BLOCK are cut into several segments.
SPAN, BLOCK = 600, 64
_FAR = 1e18


def _apply(f: Column, x: Column) -> Column:
    return F.least(f["hi"], F.greatest(f["lo"], x + f["s"]))


def _then(f: Column, g: Column) -> Column:
    """f and then g as one clamp function."""
    return F.struct((f["s"] + g["s"]).alias("s"), _apply(g, f["lo"]).alias("lo"), _apply(g, f["hi"]).alias("hi"))


def _grown(tick: Column, schedule: Sequence[tuple[float, float, float]]) -> Column:
    return regenerated(F.lit(0.0), tick.cast("double"), schedule)


def resource_states(e: DataFrame, schedule=SCHEDULE, cap: float = CAP, start: float = START, ahead: int = 0, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """(match_id, side, tick, event_id, cost, grown, before, after, overflow) of every play of e.

    before and after are the units held before and after the play is paid (what is missing is forgiven: after is 0 at least), overflow what was
    regrown beyond the cap since the side's play before. Plays of one tick follow by event_id. `ahead` is the number of ticks whose
    growth a play already sees beyond its own: 1 if every tick regrows before it is played. A null cost pays nothing; plays without a tick go.
    """
    w = Window.partitionBy("match_id", "side", "_span").orderBy("tick", "event_id")
    p = e.where("tick is not null").select("match_id", "side", "tick", "event_id", F.coalesce("cost", F.lit(0)).cast("double").alias("cost"), F.floor(F.col("tick") / span).alias("_span"))
    p = p.withColumn("_block", F.floor((F.row_number().over(w) - 1) / block)).withColumn("grown", _grown(F.col("tick") + ahead, schedule))
    plays = F.array_sort(F.collect_list(F.struct("tick", "event_id", "cost", "grown")))
    seg = p.groupBy("match_id", "side", "_span", "_block").agg(plays.alias("plays"))
    clamp = lambda x: F.struct((-x["cost"]).alias("s"), (-x["grown"]).alias("lo"), (F.greatest(F.lit(0.0), F.lit(cap) - x["cost"]) - x["grown"]).alias("hi"))
    identity = F.struct(F.lit(0.0).alias("s"), F.lit(-_FAR).alias("lo"), F.lit(_FAR).alias("hi"))
    seg = seg.withColumn("f", F.aggregate("plays", identity, lambda acc, x: _then(acc, clamp(x))))
    order = F.array_sort(F.collect_list(F.struct("_span", "_block", "f")))
    y0 = F.lit(float(start)) - _grown(F.lit(0), schedule)
    none = F.array().cast("array<struct<_span:bigint,_block:bigint,y:double>>")
    begins = F.aggregate(
        order, F.struct(y0.alias("y"), none.alias("out")),
        lambda acc, x: F.struct(_apply(x["f"], acc["y"]).alias("y"), F.concat(acc["out"], F.array(F.struct(x["_span"].alias("_span"), x["_block"].alias("_block"), acc["y"].alias("y")))).alias("out")),
        lambda acc: acc["out"],
    )
    heads = seg.groupBy("match_id", "side").agg(begins.alias("b")).select("match_id", "side", F.inline("b"))
    row = "array<struct<tick:bigint,event_id:bigint,cost:double,grown:double,before:double,after:double,overflow:double>>"

    def step(acc, x):
        held = acc["y"] + x["grown"]
        before = F.least(F.lit(cap), held)
        after = F.greatest(F.lit(0.0), before - x["cost"])
        out = F.struct(x["tick"].cast("long").alias("tick"), x["event_id"].cast("long").alias("event_id"), x["cost"].alias("cost"), x["grown"].alias("grown"), before.alias("before"), after.alias("after"), (held - before).alias("overflow"))
        return F.struct((after - x["grown"]).alias("y"), F.concat(acc["out"], F.array(out)).alias("out"))

    states = F.aggregate("plays", F.struct(F.col("y").alias("y"), F.array().cast(row).alias("out")), step, lambda acc: acc["out"])
    return seg.join(heads, ["match_id", "side", "_span", "_block"]).select("match_id", "side", F.inline(states))


def resource_at_events(states: DataFrame, cap: float = CAP, start: float = START) -> DataFrame:
    """(match_id, event_id, side, own, other, differential) at each play: what its side held before it and the other side at the same tick.

    Of plays of one tick the ones with smaller event_id count for the other side. One window a match carries the other side's potential along.
    """
    w = Window.partitionBy("match_id").orderBy("tick", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    y = F.col("after") - F.col("grown")
    last = lambda side: F.coalesce(F.last(F.when(F.col("side") == side, y), ignorenulls=True).over(w), F.lit(float(start)))
    other = F.when(F.col("side") == "team", last("opponent")).otherwise(last("team"))
    out = states.select("match_id", "event_id", "side", F.col("before").alias("own"), F.least(F.lit(cap), other + F.col("grown")).alias("other"))
    return out.withColumn("differential", F.col("own") - F.col("other"))


def resource_curve(states: DataFrame, schedule=SCHEDULE, cap: float = CAP, start: float = START, ahead: int = 0, step: int = SECOND) -> DataFrame:
    """(match_id, side, at, level): what both sides of a match hold every `step` ticks, from 0 to one step after the match's last play.

    A play at the same tick is paid already. Each play covers the grid up to its side's next one, so no grid is joined.
    """
    y = F.col("after") - F.col("grown")
    ends = states.groupBy("match_id").agg(F.max("tick").alias("end"))
    first = ends.select("match_id", F.explode(F.array(F.lit("team"), F.lit("opponent"))).alias("side"), F.lit(-1).cast("long").alias("tick"), F.lit(-1).cast("long").alias("event_id"), F.lit(float(start)).alias("y"))
    rows = states.where(F.col("side").isin("team", "opponent")).select("match_id", "side", "tick", "event_id", y.alias("y")).unionByName(first)
    w = Window.partitionBy("match_id", "side").orderBy("tick", "event_id")
    k = lambda c: F.ceil(c / F.lit(step))
    grid = rows.withColumn("_next", F.lead("tick").over(w)).join(ends, "match_id")
    grid = grid.withColumn("_from", F.greatest(k(F.col("tick")), F.lit(0))).withColumn("_to", F.when(F.col("_next").isNotNull(), k(F.col("_next")) - 1).otherwise(F.floor((F.col("end") + step) / step)))
    out = grid.where("_to >= _from").select("match_id", "side", "y", F.explode(F.sequence(F.col("_from") * step, F.col("_to") * step, F.lit(step).cast("long"))).alias("at"))
    return out.select("match_id", "side", "at", F.least(F.lit(cap), F.col("y") + _grown(F.col("at") + ahead, schedule)).alias("level"))


def average_differential(curve: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """(by, at, mean, n): the mean of own less other level at each time over the matches of a group, from times that max(2, a third) of its matches reach.

    groups(match_id, by) deals matches to groups. Sides need not meet: their sums do, in one partial aggregate.
    """
    met = curve.join(groups.select("match_id", by), "match_id")
    sizes = met.where((F.col("side") == "team") & (F.col("at") == 0)).groupBy(by).agg(F.count(F.lit(1)).alias("_matches"))
    own = F.col("side") == "team"
    g = met.groupBy(by, "at").agg(F.sum(F.when(own, F.col("level")).otherwise(-F.col("level"))).alias("_sum"), F.count_if(own).alias("n"))
    return g.join(sizes, by).where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("_matches") / 3))).select(by, "at", (F.col("_sum") / F.col("n")).alias("mean"), "n")


def resource_overflow(states: DataFrame, schedule=SCHEDULE, cap: float = CAP, ahead: int = 0, to_end: bool = True) -> DataFrame:
    """(match_id, side, n, spent, overflow): plays, units paid, and all that was regrown beyond the cap, with to_end up to the match's last play of either side."""
    ends = states.groupBy("match_id").agg(F.max("tick").alias("end"))
    g = states.groupBy("match_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("spent"), F.sum("overflow").alias("_over"), F.max_by(F.col("after") - F.col("grown"), F.struct("tick", "event_id")).alias("_y"))
    rest = F.greatest(F.lit(0.0), F.col("_y") + _grown(F.col("end") + ahead, schedule) - cap) if to_end else F.lit(0.0)
    return g.join(ends, "match_id").select("match_id", "side", "n", "spent", (F.col("_over") + rest).alias("overflow"))
