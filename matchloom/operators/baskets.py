"""Basket operators: posteriors, co-occurrence, similarity joins, greedy clusters, combinations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .outcomes import baskets
from .ranges import numbered

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole numbers, as counts mostly are, are looked up in one table; the result of a row does not depend on the others."""
    whole = (a == np.rint(a)) & (b == np.rint(b)) & (a >= 1) & (b >= 1) & (a + b <= 1_000_000)
    out = np.empty(a.shape)
    out[~whole] = _lgamma(a[~whole]) + _lgamma(b[~whole]) - _lgamma(a[~whole] + b[~whole]) if not whole.all() else 0
    x, y = a[whole].astype(np.int64), b[whole].astype(np.int64)
    if x.size:
        g = np.concatenate(([0.0, 0.0], np.cumsum(np.log(np.arange(1, int((x + y).max()), dtype=float)))))  # of 0 (unused), 1, 2, ...
        out[whole] = g[x] + g[y] - g[x + y]
    return out


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray, log_beta: np.ndarray | None = None) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz), until it stands still."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.where(np.abs(t := 1 - (p + q) * z / (p + 1)) < tiny, tiny, t)
    h, done = d.copy(), np.zeros(z.shape, bool)
    for m in range(1, 1000):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = np.where(done, h, h * d * c)
        done |= np.abs(d * c - 1) < 1e-15
        if done.all():
            break
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - (_log_beta(p, q) if log_beta is None else log_beta)) / p
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def beta_quantile(q, a, b) -> np.ndarray:
    """Quantiles of beta distributions, by bisection on the incomplete beta function; equal rows are solved once."""
    q, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (q, a, b)))
    if not q.size:
        return np.zeros(q.shape)
    (q, a, b), back = np.unique(np.stack([q.ravel(), a.ravel(), b.ravel()]), axis=1, return_inverse=True)
    low, high, known = np.zeros(q.shape), np.ones(q.shape), _log_beta(a, b)
    for _ in range(52):
        middle = (low + high) / 2
        under = incomplete_beta(middle, a, b, known) < q
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return ((low + high) / 2)[back.ravel()]


def beta_interval(wins: Column, losses: Column, prior: tuple[float, float] = (1.0, 1.0), level: float = 0.95) -> Column:
    """struct(low, high): the central credible interval of a win rate."""

    @F.pandas_udf("low double, high double")
    def interval(w: pd.Series, l: pd.Series) -> pd.DataFrame:
        a, b = w.to_numpy(float) + prior[0], l.to_numpy(float) + prior[1]
        return pd.DataFrame({"low": beta_quantile((1 - level) / 2, a, b), "high": beta_quantile((1 + level) / 2, a, b)})

    return interval(wins, losses)


def beta_posterior(counts: DataFrame, least: int, prior: tuple[float, float] = (1.0, 1.0), intervals: bool = True) -> DataFrame:
    """counts(…, wins, losses) with the posterior mean and, if asked, its interval; groups under `least` decided matches go."""
    out = counts.where(F.col("wins") + F.col("losses") >= least).withColumn("mean", (F.col("wins") + prior[0]) / (F.col("wins") + F.col("losses") + sum(prior)))
    return out.withColumn("ci", beta_interval(F.col("wins"), F.col("losses"), prior)).select(*out.columns, "ci.low", "ci.high") if intervals else out


def sample_beta(counts: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws from each row's posterior, (…, draw, value); the same seed gives the same draws, whatever the partitions."""
    key = [c for c in counts.columns if c not in ("wins", "losses")]
    u = (F.pmod(F.xxhash64(*key, "draw", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    @F.pandas_udf("double")
    def inverse(u: pd.Series, w: pd.Series, l: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(u.to_numpy(), w.to_numpy(float) + 1, l.to_numpy(float) + 1))

    rows = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select(*key, "draw", inverse(u, F.col("wins"), F.col("losses")).alias("value"))


def cooccurrence(r: DataFrame, least: int) -> DataFrame:
    """(a, b, n): in how many matches two items of one side are together, a < b; a basket's pairs are built from its own array."""
    items = r.groupBy("match_id", "is_player").agg(F.array_sort(F.collect_set("item")).alias("items"))
    pairs = items.select(F.posexplode("items").alias("i", "a"), "items").select("a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def compositions(m: DataFrame, b: DataFrame) -> DataFrame:
    """Each different basket with its counts."""
    return m.join(b, "match_id").groupBy(F.array_join("items", "|").alias("basket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("result = 'win'")).alias("wins"), F.count_if(F.expr("result = 'loss'")).alias("losses"))


#: Items of a vocabulary that fits the bits of a long.
MASK_ITEMS = 62


def basket_counts(r: DataFrame, names: DataFrame, side: int = 1) -> DataFrame:
    """(items, n): each different basket of one side and in how many matches it is; names(item) holds every item of r.

    Over a small vocabulary a match's items are gathered as the bits of a long: sets of texts take more of the disk when they
    are dealt by match, and are sorted there where they are many.
    """
    known = sorted(x["item"] for x in names.where("item is not null").distinct().limit(MASK_ITEMS + 1).collect())  # a few names
    n = F.count(F.lit(1)).alias("n")
    if not 0 < len(known) <= MASK_ITEMS:
        return baskets(r, side).groupBy("items").agg(n)
    flag = F.create_map(*(F.lit(v) for i, x in enumerate(known) for v in (x, 1 << i))).cast("map<string,bigint>")
    masks = r.where(F.col("is_player") == side).select("match_id", flag[F.col("item")].alias("flag")).groupBy("match_id").agg(F.coalesce(F.bit_or("flag"), F.lit(0)).alias("mask"))
    items = F.array_compact(F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(known))))
    return masks.groupBy("mask").agg(n).select(items.alias("items"), "n")


def jaccard_join(sets: DataFrame, threshold: float, within: str | None = None) -> DataFrame:
    """(a, b, jaccard) of sets(id, items) with a < b and similarity >= threshold > 0; with `within`, a column of sets, only sets equal there are paired.

    Sets that must share two items meet under pairs of their rarest ones (of k shared items two are among the first
    size - k + 2 of either), so a frequent item builds no pairs; sets so small that they need share one only meet under it.
    Over a small vocabulary sets travel as bit masks, which also tell the one key a pair is taken under; else items are joined to the candidates.
    """
    g = [within] if within else []
    rows = sets.select("id", *g, F.explode(F.array_distinct("items")).alias("item"))
    df = rows.groupBy(*g, "item").agg(F.count(F.lit(1)).alias("df"))
    names = df.select("item").distinct()
    small = names.limit(MASK_ITEMS + 1).count() <= MASK_ITEMS
    if small:
        flags = F.broadcast(names.withColumn("bit", F.row_number().over(Window.orderBy("item")) - 1).select("item", F.expr("shiftleft(1L, bit)").alias("flag")))  # at most MASK_ITEMS rows
        df = df.join(flags, "item")
    ordered = rows.join(df if g or not small else F.broadcast(df), [*g, "item"]).groupBy("id", *g).agg(F.array_sort(F.collect_list(F.struct("df", "item", *(["flag"] if small else [])))).alias("z"))
    size = F.size("z")
    need = F.ceil(size * F.lit(threshold) - 1e-9).cast("int")
    x_ = lambda x: x["flag"] if small else x["item"]
    mask = lambda z: F.aggregate(z, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x))
    head = F.transform(F.slice("z", 1, size - need + 2), x_)
    pair = (lambda x, y: x.bitwiseOR(y)) if small else (lambda x, y: F.concat_ws("\x1f", x, y))
    pairs = F.flatten(F.transform(head, lambda x, i: F.transform(F.slice(head, i + 2, F.size(head)), lambda y: pair(x, y))))
    single = F.when(size * threshold <= 1 + 1e-9, F.transform("z", x_)).otherwise(F.array().cast("array<bigint>" if small else "array<string>"))
    more = {"mask": mask(F.transform("z", x_)), "head": mask(head)} if small else {}
    keys = ordered.select("id", *g, size.alias("size"), *(v.alias(k) for k, v in more.items()), F.explode(F.concat(pairs, single)).alias("key"))
    a, b = (keys.select(F.col("id").alias(n), *g, *(F.col(c).alias(f"{c}_{n}") for c in ("size", *more)), "key") for n in "ab")
    # keys are many more than the file of sets lets Spark expect: never broadcast
    met = a.join(b.hint("merge"), [*g, "key"]).where("a < b").where((F.col("size_a") >= F.col("size_b") * threshold - 1e-9) & (F.col("size_b") >= F.col("size_a") * threshold - 1e-9))
    if small:
        least = lambda m: m.bitwiseAND(-m)
        common, shared = F.col("head_a").bitwiseAND(F.col("head_b")), F.col("mask_a").bitwiseAND(F.col("mask_b"))
        rest = common.bitwiseXOR(least(common))
        met = met.where(F.col("key") == F.when(rest != 0, least(common).bitwiseOR(least(rest))).otherwise(least(shared)))
        both = F.bit_count(shared)
    else:
        of = lambda n: sets.select(F.col("id").alias(n), F.array_distinct("items").alias(f"items_{n}"))
        met = met.select("a", "b", "size_a", "size_b").distinct().join(of("a"), "a").join(of("b"), "b")
        both = F.size(F.array_intersect("items_a", "items_b"))
    return met.select("a", "b", (both / (F.col("size_a") + F.col("size_b") - both)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def greedy_clusters(comp: DataFrame, group: str, threshold: float) -> DataFrame:
    """comp(group, items, n) with `cluster`: within a group baskets by falling n (ties: by their text) join the first cluster whose founder is similar
    enough (Jaccard >= threshold > 0), or found the next one; clusters are numbered from 0 in that order.

    Who founds is settled in rounds over the similarity join's links: a basket with a similar earlier founder is a member, one whose similar
    earlier baskets are all members is a founder, the others wait. Every round settles at least each group's first waiting basket, most settle many;
    links to members and of the settled go. Baskets and groups of any size are joined, none is gathered. Empty or null baskets and null
    groups are founders of their own. The order inside items makes no difference; equal rows of a group are one basket with one cluster.
    """
    key = F.concat_ws("\x1d", F.coalesce(F.col(group).cast("string"), F.lit("\x00")), F.array_join(F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))), "\x1f"))
    keyed = written(comp.withColumn("_key", key), "basket-rows")  # read twice, and what it is made of can be far larger
    one = keyed.groupBy("_key").agg(F.first(group).cast("string").alias("_group"), F.first("items").alias("items"), F.max("n").alias("n"))
    # baskets are known by their place in the order, so the earlier of two is the one with the smaller number
    nodes = written(numbered(one, [F.desc("n"), F.col("_key")]).select(F.col("_place").alias("_id"), "_key", "_group", "items"), "baskets")
    pairs = jaccard_join(nodes.where(F.col("_group").isNotNull() & (F.size("items") > 0)).select(F.col("_id").alias("id"), "_group", "items"), threshold, "_group")
    links = written(pairs.select(F.col("a").alias("early"), F.col("b").alias("late")), "basket-links")
    waiting, open_links, settled, done = nodes.select("_id"), links, None, None
    while True:
        # a link's earlier end waits or was settled in the last round, else its later end would not wait; ends that are members are gone
        if done is not None:
            open_links = open_links.join(done.select(F.col("_id").alias("early"), "founds"), "early", "left").where("founds is null or founds").withColumn("founds", F.coalesce("founds", F.lit(False)))
        else:
            open_links = open_links.withColumn("founds", F.lit(False))
        seen = open_links.groupBy(F.col("late").alias("_id")).agg(F.max("founds").alias("_member"))
        state = waiting.join(seen, "_id", "left").select("_id", F.when(F.col("_member").isNull(), True).when(F.col("_member"), False).alias("founds"))
        state = written(state, "basket-round")
        done = state.where("founds is not null")
        settled = done if settled is None else settled.unionByName(done)
        waiting = state.where("founds is null").select("_id")
        if waiting.isEmpty():
            break
        open_links = written(open_links.drop("founds").join(waiting.select(F.col("_id").alias("late")), "late", "left_semi"), "basket-links")
    founders = settled.where("founds").join(nodes.select("_id", "_group"), "_id").withColumn("cluster", F.row_number().over(Window.partitionBy("_group").orderBy("_id")) - 1).select("_id", "cluster")
    joined = links.join(founders.select(F.col("_id").alias("early"), "cluster"), "early").groupBy(F.col("late").alias("_id")).agg(F.min("cluster").alias("_joined"))
    members = settled.where("not founds").join(joined, "_id").select("_id", F.col("_joined").alias("cluster"))
    clusters = founders.unionByName(members).join(nodes.select("_id", "_key"), "_id").drop("_id")
    return keyed.join(clusters, "_key").drop("_key")


def combinations(sets: DataFrame, k: int) -> DataFrame:
    """(id, combo) of all k different items of each set, built from positions inside the row."""
    out = sets.select("id", "items", F.array().cast("array<string>").alias("combo"), F.lit(-1).alias("last"))
    for _ in range(k):
        out = out.select("id", "items", "combo", "last", F.posexplode("items").alias("pos", "item")).where("pos > last").select("id", "items", F.concat("combo", F.array("item")).alias("combo"), F.col("pos").alias("last"))
    return out.select("id", F.array_join("combo", "|").alias("combo"))
