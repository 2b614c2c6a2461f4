"""What items and swaps do to a probability: impact by side and by category, swaps scored by a model, their gradient, calibration by tier."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantile of a 95 % interval, and the probabilities beyond which a prediction counts as confident.
Z, SURE = 1.96, (0.1, 0.9)


def impact_by_side(wp: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """(item, side, matches, impact, carry, liability, critical, net) of wp(match_id, item, side, wpa).

    An item's impact in a match is the sum of its deltas. In every match the (item, side) with the largest sum carries, the one with the least is
    the liability, the one with the single largest absolute delta is critical (ties: the first in order of item and side); net is carry less
    liability. Null deltas count as 0, rows without an item take no part.

    Sums that are equal but for the last bits of a double go to one or the other by the order they are added in. With `order`, columns that
    tell a match's events apart, they are added one after another in that order, whatever the partitions, partial sums and spills.
    """
    key, w = ["match_id", "item", "side"], F.coalesce("wpa", F.lit(0.0))
    rows = wp.where("item is not null").select(*key, w.alias("_w"), *order)
    if order:
        whole = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        g = rows.withColumn("_total", F.sum("_w").over(whole)).groupBy(*key).agg(F.max("_total").alias("total"), F.max(F.abs("_w")).alias("peak"))
    else:
        g = rows.groupBy(*key).agg(F.sum("_w").alias("total"), F.max(F.abs("_w")).alias("peak"))
    who = F.struct("item", "side")
    picks = g.groupBy("match_id").agg(F.min_by(who, F.struct(-F.col("total"), who)).alias("carry"), F.min_by(who, F.struct(F.col("total"), who)).alias("liability"), F.min_by(who, F.struct(-F.col("peak"), who)).alias("critical"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("as"), F.col(c).alias("who")) for c in ("carry", "liability", "critical"))))
    counts = picks.select(each.alias("z")).groupBy(F.col("z.who.item").alias("item"), F.col("z.who.side").alias("side")).agg(*(F.count_if(F.col("z.as") == c).alias(c) for c in ("carry", "liability", "critical")))
    totals = g.groupBy("item", "side").agg(F.count(F.lit(1)).alias("matches"), F.sum("total").alias("impact"))
    out = totals.join(counts, ["item", "side"], "left").fillna(0, ["carry", "liability", "critical"])
    return out.withColumn("net", F.col("carry") - F.col("liability"))


def impact_by_category(wp: DataFrame, categories: DataFrame, item: str) -> DataFrame:
    """(category, side, matches, plays, impact, mean) of one item's deltas by the category of the match's opponent, categories(match_id, category)."""
    g = wp.where(F.col("item") == item).join(categories, "match_id").groupBy("category", "side")
    return g.agg(F.count_distinct("match_id").alias("matches"), F.count(F.lit(1)).alias("plays"), F.sum("wpa").alias("impact"), F.avg("wpa").alias("mean"))


def logistic(coefficients: dict[str, float], intercept: float) -> Callable[[DataFrame], DataFrame]:
    """A scorer: rows with `p` by a logistic function of their columns. A fitted model's scorer has the same form."""

    def score(df: DataFrame) -> DataFrame:
        z = F.lit(intercept)
        for c, w in coefficients.items():
            z = z + F.col(c).cast("double") * w
        return df.withColumn("p", 1 / (1 + F.exp(-z)))

    return score


def swaps(score: Callable[[DataFrame], DataFrame], e: DataFrame, column: str, pairs: Sequence[tuple], side: str = "team") -> DataFrame:
    """(old, new, match_id, n, delta): for each pair the mean change of the probability over a match's events of a side whose column is `old`, were it `new`.

    All pairs are scored in two passes over the events concerned, before and after.
    """
    kind = dict(e.dtypes)[column]
    table = F.array(*(F.struct(F.lit(a).cast(kind).alias("old"), F.lit(b).cast(kind).alias("new")) for a, b in pairs))
    some = e.where(F.col("side") == side).withColumn("_z", F.explode(F.filter(table, lambda z: z["old"] == F.col(column)))).select("*", F.col("_z.old").alias("old"), F.col("_z.new").alias("new")).drop("_z")
    before = score(some).select("event_id", "match_id", "old", "new", F.col("p").alias("p0"))
    after = score(some.withColumn(column, F.col("new"))).select("event_id", "new", F.col("p").alias("p1"))
    both = before.join(after, ["event_id", "new"])
    return both.groupBy("old", "new", "match_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p1") - F.col("p0")).alias("delta"))


def swap_gradient(deltas: DataFrame, least: int = 1) -> DataFrame:
    """(rank, old, new, matches, mean, low, high): the mean over matches of each swap with its 95 % normal interval, the best first; swaps of fewer than `least` matches go."""
    half = Z * F.stddev_pop("delta") / F.sqrt(F.count(F.lit(1)))
    g = deltas.groupBy("old", "new").agg(F.count(F.lit(1)).alias("matches"), F.avg("delta").alias("mean"), (F.avg("delta") - half).alias("low"), (F.avg("delta") + half).alias("high")).where(F.col("matches") >= least)
    return g.select(F.row_number().over(Window.orderBy(F.desc("mean"), "old", "new")).alias("rank"), "*")  # one row a swap


def tier_calibration(scores: DataFrame, tier: Column, sure: tuple[float, float] = SURE) -> DataFrame:
    """(tier, n, score, rate, gap, confident, coverage, accuracy) of scores(p, label): means, score less rate, how many are below or over `sure`, their
    share, and how often those are right; null accuracy where none is."""
    confident = (F.col("p") < sure[0]) | (F.col("p") > sure[1])
    right = (F.col("p") >= 0.5) == (F.col("label") == 1)
    g = scores.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("score"), F.avg("label").alias("rate"), F.count_if(confident).alias("confident"), F.count_if(confident & right).alias("_right"))
    return g.select("tier", "n", "score", "rate", (F.col("score") - F.col("rate")).alias("gap"), "confident", (F.col("confident") / F.col("n")).alias("coverage"), (F.col("_right") / F.when(F.col("confident") > 0, F.col("confident"))).alias("accuracy"))


def threats(m: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """(keys…, label, n, wins, losses, mean, rank) of matches(keys…, label, result): the posterior mean of the win rate under an even prior, the
    least first within the keys (ties: by label); labels of fewer than `least` decided matches go."""
    won, lost = F.count_if(F.col("result") == "win"), F.count_if(F.col("result") == "loss")
    g = m.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), won.alias("wins"), lost.alias("losses")).where(F.col("wins") + F.col("losses") >= least)
    g = g.withColumn("mean", (F.col("wins") + 1) / (F.col("wins") + F.col("losses") + 2))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("mean", "label")))
