"""Outcome analytics: grouped rates, streaks, rolling values, rankings. Column roles are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_(value: str, column: str = "result") -> Column:
    return F.when(F.col(column) == value, 1).otherwise(0)


def outcome_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(is_("win")).alias("wins"), F.sum(is_("loss")).alias("losses"), F.sum(is_("draw")).alias("draws")]


def scope(m: DataFrame, corpus: str | None = None, kinds: Sequence[str] | None = None, floor: float | None = None) -> DataFrame:
    """The rows of one corpus, of some kinds, at or over a rating; each bound is optional and reaches the scan."""
    if corpus is not None:
        m = m.where(F.col("corpus") == corpus)
    if kinds is not None:
        m = m.where(F.col("kind").isin(*kinds))
    return m if floor is None else m.where(F.col("own_rating") >= floor)


def overview(m: DataFrame) -> DataFrame:
    return m.agg(
        *outcome_sums(),
        F.sum("own_score").alias("score_for"),
        F.sum("opp_score").alias("score_against"),
        F.avg("own_score").alias("avg_for"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def win_rate(m: DataFrame, by: Sequence[str], denominator: str = "all") -> DataFrame:
    """n, wins, losses, draws and win_rate per group; the denominator is all matches or the decided ones."""
    base = F.col("n") if denominator == "all" else F.col("wins") + F.col("losses")
    return m.groupBy(*by).agg(*outcome_sums()).withColumn("win_rate", F.when(base > 0, F.col("wins") / base))


def crosstab(m: DataFrame, a: str, b: str) -> DataFrame:
    return m.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def baskets(r: DataFrame, side: int = 1) -> DataFrame:
    """(match_id, items): each match's sorted different items of one side."""
    return r.where(F.col("is_player") == side).groupBy("match_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def basket_stats(m: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """Per basket with at least `least` matches: counts, rate, smallest match as representative."""
    stats = m.join(b, "match_id").groupBy("items").agg(*outcome_sums(), F.min("match_id").alias("example")).where(F.col("n") >= least)
    return stats.select(F.array_join("items", "|").alias("basket"), "n", "wins", "losses", "draws", (F.col("wins") / F.col("n")).alias("win_rate"), "example")


def item_matchups(m: DataFrame, r: DataFrame, least: int) -> DataFrame:
    """Per opposing item: different matches and how many were won; rows of one item in a match count once."""
    once = r.where("is_player = 0").select("match_id", "item").distinct()
    return m.join(once, "match_id").groupBy("item").agg(*outcome_sums()).where(F.col("n") >= least).withColumn("win_rate", F.col("wins") / F.col("n"))


def traffic_index(hours: DataFrame, n: str = "n") -> DataFrame:
    """Counts scaled to 0..100 between their extremes. hours has one row an hour, so the extremes are one joined row."""
    ends = hours.agg(F.min(n).alias("low"), F.max(n).alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), 100.0 * (F.col(n) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return hours.join(F.broadcast(ends)).withColumn("traffic", scaled).drop("low", "high")


def observations(m: DataFrame) -> DataFrame:
    """Each match seen from both sides: (entity, rating, role, match_id, ts, result)."""
    flipped = F.when(F.col("result") == "win", "loss").when(F.col("result") == "loss", "win").otherwise("draw")
    own = m.select("entity", F.col("own_rating").alias("rating"), F.lit("player").alias("role"), "match_id", "ts", "result")
    return own.unionByName(m.select(F.col("opponent").alias("entity"), F.col("opp_rating").alias("rating"), F.lit("opponent").alias("role"), "match_id", "ts", flipped.alias("result")))


def top_opponents(m: DataFrame, k: int, least: int = 2) -> DataFrame:
    """Per entity its k most met opponents of at least `least` meetings, with the decided win rate and the last kind."""
    g = m.groupBy("entity", "opponent").agg(*outcome_sums(), F.max_by("kind", F.struct("ts", "match_id")).alias("last_kind")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "opponent"))
    decided = F.col("wins") + F.col("losses")
    return g.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("win_rate", F.when(decided > 0, F.col("wins") / decided))


# --- ordered -----------------------------------------------------------------------------------------------------


def streaks(m: DataFrame, by: Sequence[str], order: Sequence[str] = ("ts", "match_id")) -> DataFrame:
    """Runs of equal decided results in order: result, length, first and last match and rating."""
    w = Window.partitionBy(*by).orderBy(*order)
    runs = m.where(F.col("result") != "draw").withColumn("new", F.when(F.lag("result").over(w) == F.col("result"), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    return runs.groupBy(*by, "run").agg(
        F.first("result").alias("result"),
        F.count(F.lit(1)).alias("length"),
        F.min(at)[order[-1]].alias("first_match"),
        F.max(at)[order[-1]].alias("last_match"),
        F.min_by("own_rating", at).alias("start_rating"),
        F.max_by("own_rating", at).alias("end_rating"),
    )


def streak_summary(s: DataFrame, by: Sequence[str]) -> DataFrame:
    """Current streak and the longest of wins and of losses; of equal ones the earliest counts."""
    longest = lambda r: F.max(F.when(F.col("result") == r, F.col("length")))
    first = lambda r: F.max_by(F.when(F.col("result") == r, F.col("first_match")), F.when(F.col("result") == r, F.struct("length", F.negative("run").alias("run"))))
    return s.groupBy(*by).agg(
        F.max_by("result", "run").alias("current"),
        F.max_by("length", "run").alias("current_length"),
        longest("win").alias("longest_win"),
        first("win").alias("longest_win_first"),
        longest("loss").alias("longest_loss"),
    )


def current_run(m: DataFrame, by: Sequence[str]) -> DataFrame:
    """Length of the run of equal results at the latest end."""
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("match_id"))
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    d = m.withColumn("changed", F.sum(F.when(F.col("result") != F.first("result").over(whole), 1).otherwise(0)).over(whole))
    return d.where("changed = 0").groupBy(*by).agg(F.first("result").alias("result"), F.count(F.lit(1)).alias("run"))


def last_n_stats(m: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("match_id"))
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).groupBy(*by).agg(*outcome_sums(), F.sum("change").alias("change"), F.avg("own_score").alias("avg_score"))


def rolling(m: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Share of wins over the last n matches, at every match."""
    w = Window.partitionBy(*by).orderBy("ts", "match_id").rowsBetween(-n + 1, 0)
    return m.select(*by, "match_id", F.avg(is_("win")).over(w).alias("rate"), F.count(F.lit(1)).over(w).alias("n"))


def rating_history(m: DataFrame, by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("ts", "match_id").rowsBetween(Window.unboundedPreceding, 0)
    return m.select(*by, "match_id", (F.col("own_rating") + F.col("change")).alias("after"), F.sum("change").over(w).alias("running_change"))


def downsample(m: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """At most n + 1 rows of each ordered series: every ceil(size / n)-th, and the last."""
    w = Window.partitionBy(*by)
    d = m.withColumn("i", F.row_number().over(w.orderBy("ts", "match_id"))).withColumn("size", F.count(F.lit(1)).over(w))
    return d.where(((F.col("i") - 1) % F.ceil(F.col("size") / n) == 0) | (F.col("i") == F.col("size"))).select(*by, "match_id", "i")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def latest_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key, by a partial aggregate and not a sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of one page with the total and whether more follow."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(number * size).limit(size)
    return rows.join(F.broadcast(total)).withColumn("has_more", F.col("total") > (number + 1) * size)


def time_split(df: DataFrame, order: str, fraction: float) -> DataFrame:
    """Marks the rows after the (1 - fraction) quantile of an ordered column as validation, without a global sort."""
    edge = df.agg(F.percentile(F.col(order).cast("double"), F.lit(1 - fraction)).alias("edge"))
    return df.join(F.broadcast(edge)).withColumn("validation", F.col(order).cast("double") > F.col("edge")).drop("edge")
