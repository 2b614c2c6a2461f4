"""One category's matches in depth: outcomes, openings, pushes, phases as one frame of metrics, and the rules that metrics of wins and losses trigger."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import resources as P
from . import sequences as S

MIDDLE_Y = 15750


@dataclass(frozen=True)
class Rule:
    """Triggered if metric `a` (of matches won or lost) less metric `b` lies over the threshold either way. Both must be known; with `needs` of 1 one of
    them must be over 0, of 2 both."""

    name: str
    a: str
    a_won: int
    b: str
    b_won: int
    threshold: float
    needs: int = 0


#: What counts as notable.
RULES = (
    Rule("opens_faster_in_wins", "first_play", 0, "first_play", 1, 20, 2),
    Rule("more_aggressive_in_wins", "aggression", 1, "aggression", 0, 0.05, 1),
    Rule("first_push_earlier_in_wins", "first_push", 0, "first_push", 1, 100, 2),
    Rule("more_pushes_in_wins", "pushes", 1, "pushes", 0, 0.3, 1),
    Rule("opponent_spells_in_wins_double", "opponent_spell_double", 1, "opponent_spell_double", 0, 0.05, 2),
    Rule("opponent_spells_in_wins_overtime", "opponent_spell_overtime", 1, "opponent_spell_overtime", 0, 0.05, 2),
    Rule("left_lane_shift_in_wins", "lane_left_double", 1, "lane_left_single", 1, 0.1),
    Rule("right_lane_shift_in_wins", "lane_right_double", 1, "lane_right_single", 1, 0.1),
)


def _rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df's columns as rows (keys…, metric, value); unknown values give none."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns)))
    return df.select(*keys, each.alias("z")).select(*keys, "z.*").where("value is not null")


def metrics(e: DataFrame, outcomes: DataFrame, types: Column, gap: int = 300, least: int = 3) -> DataFrame:
    """(won, metric, value) over the matches of outcomes(match_id, won 0 or 1) that have events.

    games, duration (last tick), overflow (units regrown beyond the cap by the own side), first_play, plays, aggression (share of own plays beyond the
    middle), lane shares; pushes a match and first_push (runs of own plays at most `gap` ticks apart, `least` or more); and in each phase
    lane shares of the own side and the share of the other side's plays by type. All are partial aggregates of events and of one row a match.
    """
    own = F.col("side") == "team"
    ev = e.join(outcomes.select("match_id", "won"), "match_id").withColumn("_lane", X.lane("x")).withColumn("_phase", X.phase("tick")).withColumn("_type", types)
    game = ev.groupBy("won", "match_id").agg(F.max("tick").alias("duration"), F.min(F.when(own, F.col("tick"))).alias("first_play"), F.count_if(own).alias("plays"))
    pushes = S.sessionize(e.where(own), ["match_id"], gap, least).groupBy("match_id").agg(F.count(F.lit(1)).alias("pushes"), F.min("start").alias("first_push"))
    leak = P.resource_overflow(P.resource_states(e)).where(own).select("match_id", "overflow")
    game = game.join(pushes, "match_id", "left").join(leak, "match_id", "left").fillna(0, ["pushes"])
    means = ["duration", "overflow", "first_play", "plays", "pushes", "first_push"]
    per_game = game.groupBy("won").agg(F.count(F.lit(1)).alias("games"), *(F.avg(c).alias(c) for c in means))
    share = lambda c, of: F.count_if(c & of) / F.when(F.count_if(of) > 0, F.count_if(of))
    lanes = ["left", "right", "center"]
    whole = ev.groupBy("won").agg(share(F.col("y") > MIDDLE_Y, own).alias("aggression"), *(share(F.col("_lane") == x, own).alias(f"lane_{x}") for x in lanes))
    phases = ev.groupBy("won", "_phase").agg(*(share(F.col("_lane") == x, own).alias(f"lane_{x}") for x in lanes), *(share(F.col("_type") == t, ~own).alias(f"opponent_{t}") for t in ("troop", "spell", "building")))
    by_phase = _rows(phases, ["won", "_phase"], phases.columns[2:]).select("won", F.concat("metric", F.lit("_"), "_phase").alias("metric"), "value")
    return _rows(per_game, ["won"], per_game.columns[1:]).unionByName(_rows(whole, ["won"], whole.columns[1:])).unionByName(by_phase)


def deep_dive(m: DataFrame) -> DataFrame:
    """One row of metrics: games, wins, losses, win_rate, and duration, overflow of wins and of losses."""
    of = lambda name, won: F.max(F.when((F.col("metric") == name) & (F.col("won") == won), F.col("value")))
    wins, losses = F.coalesce(of("games", 1), F.lit(0.0)), F.coalesce(of("games", 0), F.lit(0.0))
    weighted = (F.coalesce(of("duration", 1), F.lit(0.0)) * wins + F.coalesce(of("duration", 0), F.lit(0.0)) * losses) / F.when(wins + losses > 0, wins + losses)
    return m.agg((wins + losses).cast("long").alias("games"), wins.cast("long").alias("wins"), losses.cast("long").alias("losses"), (wins / F.when(wins + losses > 0, wins + losses)).alias("win_rate"), weighted.alias("duration"), of("overflow", 1).alias("overflow_in_wins"), of("overflow", 0).alias("overflow_in_losses"))


def patterns(m: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(rule, a, b, difference) of the rules that the metrics trigger: the rules as a small table, joined to the metrics on either side."""
    rows = [(r.name, r.a, r.a_won, r.b, r.b_won, float(r.threshold), r.needs) for r in rules]
    table = m.sparkSession.createDataFrame(rows, "rule string, a_metric string, a_won int, b_metric string, b_won int, threshold double, needs int")
    a, b = (m.select(F.col("metric").alias(f"{s}_metric"), F.col("won").cast("int").alias(f"{s}_won"), F.col("value").alias(s)) for s in "ab")
    met = table.join(a, ["a_metric", "a_won"]).join(b, ["b_metric", "b_won"]).withColumn("difference", F.col("a") - F.col("b"))
    known = F.when(F.col("needs") == 0, F.lit(True)).when(F.col("needs") == 1, (F.col("a") > 0) | (F.col("b") > 0)).otherwise((F.col("a") > 0) & (F.col("b") > 0))
    return met.where(known & (F.abs("difference") > F.col("threshold"))).select("rule", "a", "b", "difference")
