"""Do signatures tell entities apart? Pairs by stratum, rank statistics, retrieval, and where a target stands among controls.

A key is an entity with one basket (its items) and a signature. Same-entity pairs are positives, by how far their baskets lie apart; pairs of
different entities are hard negatives if they share the basket, easy ones if the baskets lie far apart. Pairs are dealt in a hashed order: each
key meets the next `fan` of its group, all of a group of up to fan + 1 keys, so pairs grow with keys and no group is paired with itself whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import basket_distance
from ..sources.shared import written
from . import neighbours as B
from . import ranges
from .evaluation import cosine

#: Keys that each key meets in its group, keys of a bucket of easy negatives, least distance of far baskets, strata of distance.
FAN, BUCKET, FLOOR = 8, 256, 3
STRATA = ((1, 2), (3, 4), (5, 8))


def _neighbours(keys: DataFrame, by: Sequence[Column], fan: int) -> DataFrame:
    """(a, b): each key with the next `fan` of its group by the md5 of its number."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.col("key").cast("string").cast("binary")))
    whole = F.struct("key", "entity", "basket", "items", "signature")
    ahead = keys.select(whole.alias("a"), F.array(*(F.lead(whole, j).over(w) for j in range(1, fan + 1))).alias("_b"))
    return ahead.select("a", F.explode("_b").alias("b")).where("b is not null")


def verification_pairs(keys: DataFrame, fan: int = FAN, bucket: int = BUCKET, floor: int = FLOOR, size: int = 8) -> DataFrame:
    """(kind, a, b, distance, similarity) of keys(key, entity, basket, items, signature); kind is positive, hard or easy.

    Distances are those of baskets of `size` items, null where items are; positives without one are dropped, as are rows without an entity, basket or signature.
    """
    known = keys.where("entity is not null and basket is not null and signature is not null")
    digits = max(0, int(math.log(max(known.count(), 1) / bucket, 16)) if known.count() > bucket else 0)
    sides = lambda p: p.withColumn("distance", basket_distance(F.col("a.items"), F.col("b.items"), size))
    pos = sides(_neighbours(known, [F.col("entity")], fan)).where("a.basket != b.basket and distance is not null").withColumn("kind", F.lit("positive"))
    hard = sides(_neighbours(known, [F.col("basket")], fan)).where("a.entity != b.entity").withColumn("kind", F.lit("hard"))
    deal = F.substring(F.md5(F.concat(F.lit("easy:"), F.col("key").cast("string")).cast("binary")), 1, digits)
    easy = sides(_neighbours(known, [deal], fan)).where(f"a.entity != b.entity and distance >= {floor}").withColumn("kind", F.lit("easy"))
    every = pos.unionByName(hard).unionByName(easy)
    return every.select("kind", F.col("a.key").alias("a"), F.col("b.key").alias("b"), "distance", cosine(F.col("a.signature"), F.col("b.signature")).alias("similarity"))


def verification_report(pairs: DataFrame, strata: Sequence[tuple[int, int]] = STRATA, floor: int = FLOOR) -> DataFrame:
    """(measure, n_pos, n_neg, auc): far positives against easy and hard negatives, and each stratum of positives against the easy ones.

    Similarities are compared to 9 digits. A measure without positives or negatives has a null auc.
    """
    score = F.round("similarity", 9)
    cases = [("far_vs_easy", F.col("distance") >= floor, "easy"), ("far_vs_hard", F.col("distance") >= floor, "hard")]
    cases += [(f"d{lo}-{hi}_vs_easy", F.col("distance").between(lo, hi), "easy") for lo, hi in strata]
    out = None
    for name, of, negative in cases:
        some = pairs.where((F.col("kind") == negative) | ((F.col("kind") == "positive") & of))
        one = ranges.auc(some, score, F.col("kind") == "positive").select(F.lit(name).alias("measure"), "n_pos", "n_neg", "auc")
        out = one if out is None else out.unionByName(one)
    return out


def retrieval(keys: DataFrame, queries: DataFrame, floor: int = FLOOR, size: int = 8, rows: int = 2048) -> DataFrame:
    """(query, rank): where the best key of the query's own entity with a far basket stands among all keys with far baskets, by falling similarity.

    Queries without such a key are left out. Queries and keys meet in blocks of `rows`, each counting its keys that are more similar than the own
    one (by over 1e-12), so one number a query and block is shuffled. Keys without items, entity or signature take no part.
    """
    usable = "entity is not null and items is not null and signature is not null"
    k, q = written(keys.where(usable).select("key", "entity", "items", "signature"), "keys"), queries.where(usable)
    far = basket_distance(F.col("q.items"), F.col("k.items"), size) >= floor
    own = q.alias("q").join(k.alias("k"), F.col("q.entity") == F.col("k.entity")).where(far & (F.col("q.key") != F.col("k.key")))
    best = own.groupBy(F.col("q.key").alias("query")).agg(F.max(cosine(F.col("q.signature"), F.col("k.signature"))).alias("best"))
    asked = q.join(best, q["key"] == best["query"]).select("query", "items", "signature", "best")
    blocks = lambda df, cols, n: df.withColumn("_b", F.floor(F.monotonically_increasing_id() / rows)).groupBy("_b").agg(*(F.collect_list(c).alias(f"{n}_{c}") for c in cols))
    a = written(blocks(asked, ["query", "items", "signature", "best"], "q"), "query-blocks")
    numbers = a.groupBy(F.lit(0).alias("_all")).agg(F.collect_list("_b").alias("_bs"))  # one row, a number a block of queries
    p = blocks(k, ["items", "signature"], "k").drop("_b").withColumn("_all", F.lit(0))
    met = p.join(F.broadcast(numbers), "_all").withColumn("_b", F.explode("_bs")).drop("_bs", "_all").join(a, "_b")

    def run(batches):
        unit = lambda v: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))(np.stack([np.asarray(x, float) for x in v]))
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                number: dict[str, int] = {}
                hot = lambda lists: [np.array([number.setdefault(x, len(number)) for x in set(items)], np.int64) for items in lists]
                qi, ki = hot(r.q_items), hot(r.k_items)
                sets = np.zeros((len(qi) + len(ki), len(number)), np.float32)
                for i, at in enumerate((*qi, *ki)):
                    sets[i, at] = 1
                distance = size - sets[: len(qi)] @ sets[len(qi) :].T
                ahead = (unit(r.q_signature) @ unit(r.k_signature).T > np.asarray(r.q_best)[:, None] + 1e-12) & (distance >= floor)
                yield pd.DataFrame({"query": np.asarray(r.q_query), "ahead": ahead.sum(1)})

    return met.mapInPandas(run, "query long, ahead long").groupBy("query").agg((1 + F.sum("ahead")).alias("rank"))


def retrieval_report(ranks: DataFrame) -> DataFrame:
    """One row (queries, mrr, recall_1, recall_5)."""
    share = lambda n: F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0))
    return ranks.agg(F.count(F.lit(1)).alias("queries"), F.avg(1 / F.col("rank")).alias("mrr"), share(1).alias("recall_1"), share(5).alias("recall_5"))


def percentile_among_controls(targets: DataFrame, keys: DataFrame, least: int = 8, width: float = 1500.0) -> DataFrame:
    """(key, similarity, controls, pool, percentile): the share of controls less similar to a target's reference than the target's key.

    targets(key, entity, basket, rating, signature, reference) is the stated, bounded set of keys under test, each with the signature it is held against;
    keys(key, entity, basket, rating, signature) are all. Controls are other entities' keys of the same basket, or if there are fewer than `least`,
    all whose rating is nearer than `width`: both counts are taken in one pass of keys over targets bucketed by rating, and by basket.
    """
    t = targets.select(F.col("key").alias("t_key"), F.col("entity").alias("t_entity"), F.col("basket").alias("t_basket"), F.col("rating").alias("t_rating"), "reference", cosine(F.col("signature"), F.col("reference")).alias("similarity"))
    k = keys.select("entity", "basket", "rating", "signature")
    counts = lambda met, n: met.where("entity != t_entity").withColumn("_s", cosine(F.col("signature"), F.col("reference"))).groupBy("t_key").agg(F.count(F.lit(1)).alias(f"{n}_n"), F.count_if(F.col("_s") < F.col("similarity")).alias(f"{n}_below"))
    same = counts(k.join(t, k["basket"] == t["t_basket"]), "same")
    at = lambda c: F.floor(c / width).cast("long")
    near = t.withColumn("_bucket", F.explode(F.sequence(at(F.col("t_rating")) - 1, at(F.col("t_rating")) + 1)))
    band = counts(k.withColumn("_bucket", at(F.col("rating"))).join(near, "_bucket").where(F.abs(F.col("rating") - F.col("t_rating")) < width), "band")
    out = t.select("t_key", "similarity").join(same, "t_key", "left").join(band, "t_key", "left")
    own = F.coalesce("same_n", F.lit(0)) >= least
    n, below = (F.when(own, F.col(f"same_{c}")).otherwise(F.coalesce(f"band_{c}", F.lit(0))) for c in ("n", "below"))
    return out.select(F.col("t_key").alias("key"), "similarity", n.alias("controls"), F.when(own, "basket").otherwise("band").alias("pool"), (below / F.when(n > 0, n)).alias("percentile"))
