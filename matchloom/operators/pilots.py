"""How an entity plays: six features of pace and reaction over its matches, with gates of sufficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

FEATURES = ["pace", "throughput", "reaction", "pace_consistency", "defence_reaction", "fast_share"]
#: The middle of the field, ticks of a reaction, of a fast one, of a gap between plays at most.
MIDDLE_Y, REACTION, FAST, GAP = 15750, 300, 50, 1200
#: Matches of two own plays, paced gaps and reactions that an entity needs; defensive reactions from which their own median is taken.
GATES = (8, 20, 10)
LEAST_DEFENCE = 5


def fingerprint(e: DataFrame, entities: DataFrame, gates: tuple[int, int, int] = GATES, least_defence: int = LEAST_DEFENCE) -> DataFrame:
    """(entity, games, FEATURES…) over the matches that entities(match_id, entity) deals to an entity; events are e(match_id, side, tick, event_id, cost, y).

    pace is the median of ticks to the own next play a unit of cost (gaps of 1 to GAP ticks, costs over 0), pace_consistency its standard deviation over
    its mean; throughput the units paid per 1000 ticks between first and last own play; reaction the median of ticks since the other side's last
    earlier play (up to REACTION), fast_share the share of up to FAST; defence_reaction that median over plays in the own half, or over all if
    there are fewer than `least_defence`. Matches of fewer than two own plays do not count. Entities below a gate are absent. Medians are
    exact and found over ranges, so an entity of a third of all matches is no task's alone.
    """
    side = Window.partitionBy("match_id", "side")
    earlier = Window.partitionBy("match_id").orderBy("tick").rangeBetween(Window.unboundedPreceding, -1)
    t = e.where("tick is not null").withColumn("_since", F.col("tick") - F.max(F.when(F.col("side") == "opponent", F.col("tick"))).over(earlier))
    t = t.withColumn("_next", F.lead("tick").over(side.orderBy("tick", "event_id")) - F.col("tick")).withColumn("_plays", F.count(F.lit(1)).over(side))
    own = t.where((F.col("side") == "team") & (F.col("_plays") >= 2)).join(entities.select("match_id", "entity"), "match_id")
    quick = F.when(F.col("_since") <= REACTION, F.col("_since").cast("double"))
    p = own.select(
        "entity", "match_id", "tick", F.coalesce("cost", F.lit(0)).cast("double").alias("cost"),
        F.when((F.col("_next") > 0) & (F.col("_next") <= GAP) & (F.col("cost") > 0), F.col("_next") / F.col("cost")).alias("pace"),
        quick.alias("reaction"), F.when(F.col("y") < MIDDLE_Y, quick).alias("defence"),
    )
    games = p.groupBy("entity", "match_id").agg((F.max("tick") - F.min("tick")).alias("span"), F.sum("cost").alias("spent")).groupBy("entity").agg(F.count(F.lit(1)).alias("games"), F.sum("span").alias("_span"), F.sum("spent").alias("_spent"))
    spread = p.groupBy("entity").agg(
        F.count("pace").alias("_paces"), F.count("reaction").alias("_reactions"), F.count("defence").alias("_defences"),
        (F.stddev_pop("pace") / F.when(F.avg("pace") > 0, F.avg("pace"))).alias("pace_consistency"), F.avg(F.when(F.col("reaction") <= FAST, 1.0).when(F.col("reaction").isNotNull(), 0.0)).alias("fast_share"),
    )
    enough = games.join(spread, "entity").where((F.col("games") >= gates[0]) & (F.col("_paces") >= gates[1]) & (F.col("_reactions") >= gates[2]) & (F.col("_span") > 0))
    # one value a row, so one order finds the medians of all three
    values = p.select("entity", F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("value")) for c in ("pace", "reaction", "defence")))).alias("z")).select("entity", "z.*").where("value is not null")
    middle = ranges.quantiles(values, ["entity", "of"], "value", [0.5]).groupBy("entity").agg(*(F.max(F.when(F.col("of") == c, F.col("qs")[0])).alias(f"_{c}") for c in ("pace", "reaction", "defence")))
    out = enough.join(middle, "entity")
    return out.select(
        "entity", "games", F.col("_pace").alias("pace"), (F.col("_spent") / F.col("_span") * 1000).alias("throughput"), F.col("_reaction").alias("reaction"),
        F.coalesce("pace_consistency", F.lit(0.0)).alias("pace_consistency"), F.when(F.col("_defences") >= least_defence, F.col("_defence")).otherwise(F.col("_reaction")).alias("defence_reaction"), "fast_share",
    )
