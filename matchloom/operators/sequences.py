"""Event-sequence operators: orientation, sessions, interval and as-of joins, traces, timing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 17325, 31500


def orient(e: DataFrame, least: int = 3) -> DataFrame:
    """Turns sequences whose own side plays lower than the other by 180 degrees; both need `least` events."""
    w = Window.partitionBy("match_id")
    of = lambda side, f, c: f(F.when(F.col("side") == side, F.col(c))).over(w)
    rotated = (of("team", F.count, "y") >= least) & (of("opponent", F.count, "y") >= least) & (of("team", F.avg, "y") <= of("opponent", F.avg, "y"))
    return e.withColumn("rotated", rotated).withColumn("x", F.when(F.col("rotated"), WIDTH - F.col("x")).otherwise(F.col("x"))).withColumn("y", F.when(F.col("rotated"), HEIGHT - F.col("y")).otherwise(F.col("y")))


def sessionize(e: DataFrame, by: Sequence[str], gap: int, least: int) -> DataFrame:
    """Runs of events no more than `gap` ticks apart with at least `least` events: session, start, end, n, cost."""
    w = Window.partitionBy(*by).orderBy("tick", "event_id")
    s = e.withColumn("new", F.when(F.col("tick") - F.lag("tick").over(w) <= gap, 0).otherwise(1))
    s = s.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*by, "session").agg(F.min("tick").alias("start"), F.max("tick").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).where(F.col("n") >= least)


def range_join(a: DataFrame, b: DataFrame, by: Sequence[str], ta: str, tb: str, low: int, high: int) -> DataFrame:
    """Pairs of rows with equal `by` and tb - ta in [low, high]. Time is cut into buckets as wide as the range, so a hot key is
    spread over them; a row of a meets at most two or three buckets of b. Columns of a and b must differ but for `by`."""
    width = max(1, high - low)
    at = lambda c: F.floor(c / F.lit(width)).cast("long")
    left = a.withColumn("_bucket", F.explode(F.sequence(at(F.col(ta) + low), at(F.col(ta) + high))))
    right = b.withColumn("_bucket", at(F.col(tb)))
    return left.join(right, [*by, "_bucket"]).where((F.col(tb) - F.col(ta)).between(low, high)).drop("_bucket")


def asof_join(a: DataFrame, b: DataFrame, by: Sequence[str], ta: str, tb: str, values: Sequence[str], backward: bool = True, strict: bool = False) -> DataFrame:
    """Each row of a with the values of the nearest row of b at or before (after) it: a union and one window, no pair is built.

    Of rows of b at one time the one with the largest (smallest) values counts. strict leaves out equal times.
    """
    pack = F.struct(F.col(tb).alias("_t"), *(F.col(v).alias(v) for v in values))
    kind = b.select(pack.alias("p")).schema["p"].dataType
    left = a.select(*by, F.col(ta).alias("_at"), F.lit(None).cast(kind).alias("_b"), F.struct(*a.columns).alias("_a"))
    right = b.select(*by, F.col(tb).alias("_at"), pack.alias("_b"), F.lit(None).cast(left.schema["_a"].dataType).alias("_a"))
    first = F.when(F.col("_b").isNull(), 0 if strict else 1).otherwise(1 if strict else 0)
    order = [F.col("_at"), first, F.col("_b")] if backward else [F.desc("_at"), first, F.desc("_b")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = left.union(right).withColumn("_hit", F.last("_b", ignorenulls=True).over(w)).where("_a is not null")
    return both.select("_a.*", F.col("_hit._t").alias(f"{tb}_hit"), *(F.col(f"_hit.{v}").alias(v) for v in values))


def exchanges(e: DataFrame, window: int) -> DataFrame:
    """Each own play with the number and cost of the other side's plays within `window` ticks after it; net = response - own cost."""
    own = e.where("side = 'team'").select("match_id", "event_id", "item", "tick", "cost")
    other = e.where("side = 'opponent'").select("match_id", F.col("tick").alias("t"), F.col("cost").alias("response"))
    hits = range_join(own, other, ["match_id"], "tick", "t", 0, window).groupBy("event_id").agg(F.count(F.lit(1)).alias("responses"), F.sum("response").alias("response"))
    out = own.join(hits, "event_id", "left")
    return out.select("event_id", "match_id", "item", "tick", F.coalesce("responses", F.lit(0)).alias("responses"), (F.coalesce("response", F.lit(0)) - F.col("cost")).alias("net"))


def pair_within(e: DataFrame, a: str, b: str, w: int) -> DataFrame:
    """Per match with an `a` play: whether some `b` play lies within w ticks of one."""
    x = e.where((F.col("side") == "team") & (F.col("item") == a)).select("match_id", "tick")
    y = e.where((F.col("side") == "team") & (F.col("item") == b)).select("match_id", F.col("tick").alias("t"))
    near = range_join(x, y, ["match_id"], "tick", "t", -w, w).select("match_id").distinct().withColumn("paired", F.lit(True))
    return x.select("match_id").distinct().join(near, "match_id", "left").withColumn("paired", F.coalesce("paired", F.lit(False)))


def area_connect(e: DataFrame, item: str, ticks: int, radius: float) -> DataFrame:
    """Each own `item` event with the best cost among other-side events within [0, ticks] and `radius`."""
    own = e.where((F.col("side") == "team") & (F.col("item") == item)).select("match_id", "event_id", "tick", "x", "y")
    other = e.where("side = 'opponent'").select("match_id", F.col("tick").alias("t"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("cost").alias("value"))
    hit = range_join(own, other, ["match_id"], "tick", "t", 0, ticks).where(F.hypot(F.col("u") - F.col("x"), F.col("v") - F.col("y")) <= radius)
    return own.select("event_id").join(hit.groupBy("event_id").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("hits")), "event_id", "left")


def resource_trace(e: DataFrame, rate: Column, cap: float, start: float) -> DataFrame:
    """Per (match_id, side): plays, spent, and what overflowed a capped resource that regrows at `rate` a tick between plays.

    The cap makes the recurrence depend on order, so it folds over each side's sorted events inside the JVM.
    """
    ordered = F.array_sort(F.collect_list(F.struct("tick", "event_id", "cost")))
    zero = F.struct(F.lit(0).cast("double").alias("t"), F.lit(start).alias("v"), F.lit(0.0).alias("over"), F.lit(0.0).alias("short"))

    def step(acc, ev):
        grown = acc["v"] + (ev["tick"] - acc["t"]) * rate
        capped = F.least(grown, F.lit(cap))
        left = capped - ev["cost"]
        return F.struct(ev["tick"].cast("double").alias("t"), F.greatest(left, F.lit(0.0)).alias("v"), (acc["over"] + grown - capped).alias("over"), (acc["short"] + F.greatest(-left, F.lit(0.0))).alias("short"))

    return e.groupBy("match_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("spent"), F.aggregate(ordered, zero, step).alias("z")).select("match_id", "side", "n", "spent", F.col("z.v").alias("left"), F.col("z.over").alias("overflow"), F.col("z.short").alias("short"))


def timing(e: DataFrame) -> DataFrame:
    """Per match: gaps between own plays and the time since the other side's last play."""
    w = Window.partitionBy("match_id", "side").orderBy("tick", "event_id")
    before = Window.partitionBy("match_id").orderBy("tick").rangeBetween(Window.unboundedPreceding, -1)
    t = e.withColumn("gap", F.col("tick") - F.lag("tick").over(w)).withColumn("latency", F.col("tick") - F.max(F.when(F.col("side") == "opponent", F.col("tick"))).over(before))
    return t.where("side = 'team'").groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("gap", F.lit(0.5)).alias("gap_median"),
        F.percentile("gap", F.lit(0.25)).alias("gap_p25"),
        F.min("gap").alias("gap_min"),
        F.avg(F.when(F.col("gap") <= 20, 1.0).when(F.col("gap").isNotNull(), 0.0)).alias("burst"),
        F.avg("latency").alias("latency"),
    )


def active_curve(e: DataFrame, life: int, step: int) -> DataFrame:
    """Units alive at each step of time: every play counts from its own step for `life` ticks."""
    first = F.floor(F.col("tick") / step) * step
    alive = e.select("match_id", "side", "x", F.explode(F.sequence(first, first + life, F.lit(step).cast("long"))).alias("at"))
    return alive.groupBy("match_id", "side", "at").agg(F.count(F.lit(1)).alias("alive"), F.avg("x").alias("x"))
