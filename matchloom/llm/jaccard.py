"""N-gram Jaccard join by vertical partitioning.

A document is its set of hashed word n-grams. Equal sets form a class with one representative. In the order of their
hashes the n-grams are cut into fragments; a document is thereby cut into segments, and each fragment is counted apart:

1. Fragments count how many documents have each n-gram of a document's leading part. A set that must share 80 of 100
   n-grams with a partner cannot have more than 20 of 100 that nobody else has, so most documents leave here.
2. For the survivors the same count gives the order rare first, and each keeps the prefix in which partners must meet.
3. Candidate pairs are verified by vertical partitions: each fragment counts the pair's overlap in its segments alone,
   and the partial overlaps are summed per pair.

Documents that meet under an n-gram are first tried against a hub, the one with the fewest n-grams of its own, so that a
group of thousands of near copies becomes one component in as many pairs. What is still in different components is
then paired in full, save pairs that cannot link by the places of their first common n-gram: had they an earlier one,
they would meet there. So no link between components is lost.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import FRAGMENT_BYTES, ask_counts, counts_in, fragments, make_blocks, texts_of, with_answers
from .common import Words, mix, shingles, table, written
from .components import components

N, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Parts of the n-gram order that a pair's overlap is counted in, a power of two.
FRAGMENTS = 8


def _sets(row, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(doc_ids, sorted distinct n-gram hashes of each document) of a block."""
    ids, texts = texts_of(row)
    h, text, _ = shingles(Words(texts), n)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return ids, np.split(h, np.searchsorted(text, np.arange(1, len(texts)))) if texts else []


def _slack(size: int, num: int, den: int) -> int:
    """N-grams of a set of this size that a partner may lack."""
    return size - -(-num * size // den)


def _lead(size: int, num: int, den: int) -> int:
    """n-grams of the leading part of a set of this size."""
    return min(size, 2 * _slack(size, num, den) + 1)


@cache
def _least_repeated(size: int, num: int, den: int) -> int:
    """Common n-grams that the leading parts of a set of this size and of any partner have in common at least.

    Of sets of m and k n-grams, o of them common, the j-th common one is at most the (m - o + j)-th of one and the (k - o + j)-th of the other.
    """
    k = np.arange(max(1, -(-num * size // den)), size * den // num + 1)
    both = -(-num * (size + k) // (num + den))
    k, both = k[both <= np.minimum(size, k)], both[both <= np.minimum(size, k)]
    lead = np.minimum(k, 2 * (k - -(-num * k // den)) + 1)
    return int(np.minimum(_lead(size, num, den) - (size - both), lead - (k - both)).min())


def signatures(blocks: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, sig_a, sig_b): 128 bits that are equal for equal sets."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, sets = _sets(row, n)
                a = [int(mix(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                b = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                yield pd.DataFrame({"doc_id": ids, "n_shingles": [len(s) for s in sets], "sig_a": a, "sig_b": b})

    return blocks.mapInPandas(run, "doc_id long, n_shingles long, sig_a long, sig_b long")


def _repeated_leading(blocks: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(block, doc_ids, sizes, raw, texts): the sets, as bytes, of documents that can have a partner at all."""
    lead = lambda s: s[: _lead(len(s), num, den)]
    bits = fragments(blocks, 0.6)

    def keys_of(row):
        _, sets = _sets(row, n)
        every = [lead(s) for s in sets]
        return np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)

    def use(row, right):
        ids, sets = _sets(row, n)
        keys, _ = keys_of(row)
        repeated = keys[counts_in(right) >= 2]
        own, kept = [], []
        for i, s in zip(ids, sets):
            head = lead(s)
            if not len(head):
                continue
            at = np.searchsorted(repeated, head)
            hits = int((repeated[np.minimum(at, len(repeated) - 1)] == head).sum()) if len(repeated) else 0
            if hits >= _least_repeated(len(s), num, den):
                own.append(i)
                kept.append(s)
        raw = b"".join(s.tobytes() for s in kept)
        return pd.DataFrame({"block": [row.block], "doc_ids": [np.array(own, np.int64)], "sizes": [np.array([len(s) for s in kept], np.int32)], "raw": [len(raw)], "texts": [raw]})

    answers = ask_counts(blocks, keys_of, bits)
    return written(with_answers(blocks, answers, use, "block long, doc_ids array<long>, sizes array<int>, raw long, texts binary"), "survivors", zstd=False)


def _set_rows(row):
    """(doc_id, set) of a row of survivors."""
    keys, end = np.frombuffer(row.texts, np.uint64), np.cumsum(row.sizes)
    return [(int(i), keys[e - k : e]) for i, e, k in zip(row.doc_ids, end, row.sizes)]


POST_COLUMNS = ["key", "doc_id", "size", "place", "alone"]


def _prefixes(survivors: DataFrame, num: int, den: int) -> DataFrame:
    """(key, doc_id, size, place, alone): each survivor's rare-first prefix without the n-grams that no other survivor has.

    place counts all its n-grams before this one in that order, alone those that no other has.
    """
    bits = fragments(survivors, 1.0)

    def keys_of(row):
        return np.unique(np.frombuffer(row.texts, np.uint64), return_counts=True)

    def use(row, right):
        keys, _ = keys_of(row)
        df = counts_in(right)
        out = []
        for i, s in _set_rows(row):
            d = df[np.searchsorted(keys, s)]
            first = np.lexsort((s, d))[: _slack(len(s), num, den) + 1]
            place = np.flatnonzero(d[first] >= 2)
            out.append(pd.DataFrame({"key": s[first[place]].view(np.int64), "doc_id": i, "size": len(s), "place": place, "alone": int((d == 1).sum())}))
        return pd.concat(out) if out else pd.DataFrame({k: [] for k in POST_COLUMNS}).astype("int64")

    return with_answers(survivors, ask_counts(survivors, keys_of, bits), use, ", ".join(f"{c} long" for c in POST_COLUMNS))


def verified(pairs: DataFrame, survivors: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link: partial overlaps by fragment, summed per pair. survivors holds the sets.

    Pairs are dealt to groups by b, and a document's segments go once to each group that asks for it, so a hub of very many pairs is
    spread and what moves grows with the pairs. Groups grow in number with the sets; FRAGMENTS parts of the order are counted apart.
    """
    total = survivors.agg(F.sum("raw")).first()[0] or 0  # one number
    groups = int(max(1, total // FRAGMENT_BYTES))
    shift = np.uint64(64 - FRAGMENTS.bit_length() + 1)

    def cut(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = []
                for i, s in _set_rows(row):
                    edge = np.searchsorted((s >> shift).astype(np.int64), np.arange(FRAGMENTS + 1))
                    out += [(i, f, s[edge[f] : edge[f + 1]].tobytes()) for f in range(FRAGMENTS) if edge[f] < edge[f + 1]]
                yield pd.DataFrame(out, columns=["doc", "frag", "keys"])

    def count(left, right):
        none = pd.DataFrame({"a": [], "b": [], "part": []}).astype("int64")
        if not len(left) or not len(right):
            return none
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in left["keys"]])
        docs = np.repeat(left["doc"].to_numpy(np.int64), [len(k) // 8 for k in left["keys"]])
        order = np.lexsort((keys, docs))
        keys, docs = keys[order], docs[order]
        once = np.ones(len(keys), bool)  # rows may repeat
        once[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[once], docs[once]
        ids, first = np.unique(docs, return_index=True)
        first = np.append(first, len(docs))
        a, b = right["a"].to_numpy(), right["b"].to_numpy()
        ia, ib = np.searchsorted(ids, a), np.searchsorted(ids, b)
        have = (ia < len(ids)) & (ib < len(ids))
        have[have] = (ids[ia[have]] == a[have]) & (ids[ib[have]] == b[have])
        a, b, ia, ib = a[have], b[have], ia[have], ib[have]
        if not len(a):
            return none
        # a number for each (document, n-gram), so that all pairs are looked up at once
        word = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        place = np.repeat(np.arange(len(ids)), np.diff(first)) * np.int64(word.max() + 1) + word
        total = np.zeros(len(a), np.int64)
        for c in range(0, len(a), 20_000):
            x, y = ia[c : c + 20_000], ib[c : c + 20_000]
            size = first[x + 1] - first[x]
            pair = np.repeat(np.arange(len(x)), size)
            at = np.repeat(first[x] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            want = y[pair] * np.int64(word.max() + 1) + word[at]
            pos = np.searchsorted(place, want)
            hit = (pos < len(place)) & (place[np.minimum(pos, len(place) - 1)] == want)
            total[c : c + 20_000] = np.bincount(pair[hit], minlength=len(x))
        return pd.DataFrame({"a": a, "b": b, "part": total})[total > 0]

    wanted = pairs.select("a", "b", "size_a", "size_b")
    dealt = wanted.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(groups)).alias("group"))
    every = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("frag"))
    asked = dealt.select(F.explode(F.array("a", "b")).alias("doc"), F.col("group").alias("asker")).distinct()
    parts = survivors.mapInPandas(cut, "doc long, frag int, keys binary").join(asked, "doc")
    counted = parts.groupBy("asker", "frag").cogroup(every.groupBy("group", "frag")).applyInPandas(count, "a long, b long, part long").groupBy("a", "b").agg(F.sum("part").alias("both"))
    return counted.join(wanted, ["a", "b"]).where(den * F.col("both") >= num * (F.col("size_a") + F.col("size_b") - F.col("both"))).select("a", "b")


def _can_link(num: int, den: int):
    """Whether sets that first meet at these places of their orders can link: what comes before is not common."""
    most = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    return den * most >= num * (F.col("size_a") + F.col("size_b") - most)


def class_links(blocks: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, component) over representatives (classes.rep) that link with another one."""
    survivors = _repeated_leading(blocks, n, num, den)
    reps = classes.select(F.col("rep").alias("doc_id"))
    posts = written(_prefixes(survivors, num, den).join(reps, "doc_id", "left_semi").distinct(), "prefixes")
    side = lambda d, x: d.select("key", *(F.col(c).alias(f"{c}_{x}") for c in d.columns if c != "key"))
    # each document against the hub it meets most often
    hub = posts.groupBy("key").agg(F.min_by(F.struct("doc_id", "size", "place"), F.struct(F.col("alone") / F.col("size"), "size", "doc_id")).alias("h")).select("key", "h.*")
    met = side(posts.drop("alone"), "b").join(side(hub, "a"), "key").where("doc_id_a != doc_id_b").where(_can_link(num, den))
    tried = met.groupBy("doc_id_a", "doc_id_b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("n"))
    best = tried.groupBy("doc_id_b").agg(F.max_by(F.struct(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), "size_a", "size_b"), F.struct("n", F.negative("doc_id_a").alias("a"))).alias("x"))
    links = written(verified(written(best.select("x.*"), "pairs"), survivors, num, den), "links")
    labels = written(components(links), "labels")
    # whatever meets in a prefix and is still apart: rows of an n-gram's smaller components against all of its rows
    named = posts.drop("alone").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "largest")
    apart = written(named.join(split, "key"), "apart")
    x, y = side(apart.where("component != largest").drop("largest"), "a"), side(apart.drop("largest"), "b")
    pairs = x.join(y, (x["key"] == y["key"]) & (F.col("component_a") != F.col("component_b")) & _can_link(num, den))
    low = F.col("doc_id_a") < F.col("doc_id_b")
    pick = lambda c, first: F.when(low == first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    pairs = written(pairs.select(pick("doc_id", True).alias("a"), pick("doc_id", False).alias("b"), pick("size", True).alias("size_a"), pick("size", False).alias("size_b")).distinct(), "pairs")
    if pairs.isEmpty():
        return labels
    return written(components(links.union(written(verified(pairs, survivors, num, den), "links"))), "labels")


def jaccard_components(docs: DataFrame, n: int = N, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs with a doc_id; a link is a Jaccard similarity of num/den or more.

    Null and empty texts, and texts without words, have no n-gram and link with nothing, not even with each other. A text of fewer than
    n words is one n-gram of all of them. Rows that repeat a doc_id are sets of their own that share a component. Rows without a doc_id
    are left out; other columns are not read. n-grams are compared by 64-bit hashes.
    """
    blocks = make_blocks(docs)
    sigs = written(signatures(blocks, n), "signatures")
    of_class = ["sig_a", "sig_b", "n_shingles"]
    classes = written(sigs.where("n_shingles > 0").groupBy(*of_class).agg(F.min("doc_id").alias("rep")), "classes")
    labels = class_links(blocks, classes, n, num, den)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(*of_class, F.coalesce("component", "rep").alias("component_id"))
    return sigs.join(named, of_class, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLE: dict[str, str] = {}
