"""Toxicity scores from subword-bag embeddings.

A word is a bag of its character n-grams and itself, hashed to BUCKETS rows of an embedding matrix, so unseen
misspellings share vectors with known words. A document is the average of its subwords' vectors, classified by a linear
softmax; embedding and classifier are trained together in numpy on a bounded sample of labelled documents. As the
model is linear in the words, scoring needs one number a word, which tasks remember for words they have met.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, chunks, mix, table

BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5)
#: The bound of the training sample in documents, the passes over it (more if they would make fewer than STEPS steps), and the rest of the training.
SAMPLE, EPOCHS, STEPS, RATE, BATCH = 5000, 6, 900, 0.5, 32
#: Characters that a text of the training sample may have, so that the sample's size has a bound; scoring reads whole texts of any length.
SAMPLE_CHARS = 50_000
#: Documents that a bucket must occur in to get a vector (at least MIN_DOCS, and one in RARE of the sample), and the pull of vectors towards zero.
MIN_DOCS, RARE, DECAY = 3, 300, 1e-3
#: Averages are small beside single vectors; the classifier works on SCALE times the average.
SCALE = 100.0
HELD_OUT = 2
THRESHOLD = 0.3


#: Characters of words that are hashed at once.
CHARACTERS = 1 << 18


def subwords_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of its word) of the words themselves and their character n-grams, hashed in arrays without an object per n-gram."""
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.cumsum(size)
    p, q = _powers(len(code) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(code * np.uint64(0xD6E8FEB86659FD93)) * p[:-1], dtype=np.uint64)))
    word = np.repeat(np.arange(len(words)), size)
    left = end[word] - np.arange(len(code))  # characters from each one to its word's end
    hashes, of = [mix((total[end] - total[end - size]) * q[end - size] + size.astype(np.uint64))], [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        hashes.append(mix((total[at + n] - total[at]) * q[at] + np.uint64(n)))
        of.append(word[at])
    return (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(of)


def subwords(word: str) -> np.ndarray:
    """Buckets of a word and its character n-grams."""
    return subwords_of([word])[0]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, times) of all subwords of all of a text's words."""
    count = Counter(words_of(text))
    if not count:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    found, word = subwords_of(list(count))
    ids, where = np.unique(found, return_inverse=True)
    return ids, np.bincount(where, weights=np.array(list(count.values()), float)[word]).astype(np.int64)


class Model:
    """embedding (BUCKETS x DIM), classifier weights for the toxic class against the other, bias; table is one number a bucket."""

    def __init__(self, embedding: np.ndarray, weights: np.ndarray, bias: float):
        self.embedding, self.weights, self.bias = embedding, weights, bias
        self.table = (embedding @ weights).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model | None:
    """Jointly train embedding and softmax by Adagrad on mini-batches; None unless both labels occur.

    Two classes make the softmax a logistic function of one difference of weights.
    """
    y = np.asarray(labels, float)
    if not 0 < y.sum() < len(y):
        return None
    rng = np.random.default_rng(seed)
    # a bucket of few documents says more about those than about the label: its vector stays zero
    least = max(MIN_DOCS, len(y) // RARE)
    df, most = np.zeros(BUCKETS, np.int64), 0
    for t in texts:
        i, n = _bag(t)
        df[i] += 1
        most = max(most, n.max(initial=0))
    kept = df >= least
    number = np.cumsum(kept) - 1
    # bags are made twice and laid end to end, as the driver has little memory: all subwords of all words of a text have the same share
    bucket, times = np.empty(df[kept].sum(), np.int32), np.empty(df[kept].sum(), np.min_scalar_type(most))
    edge, share = np.zeros(len(y) + 1, np.int64), np.zeros(len(y))
    for k, t in enumerate(texts):
        i, n = _bag(t)
        some = kept[i]
        edge[k + 1] = edge[k] + some.sum()
        bucket[edge[k] : edge[k + 1]], times[edge[k] : edge[k + 1]], share[k] = number[i[some]], n[some], 1 / max(n.sum(), 1)
    e = rng.normal(0, 0.1, (BUCKETS, DIM))[kept]
    w = rng.normal(0, 0.5, DIM)
    b = 0.0
    ge, gw, gb = np.full(len(e), 1e-8), np.full(DIM, 1e-8), 1e-8
    epochs = max(EPOCHS, STEPS * BATCH // len(y))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(order), BATCH):
            some = [i for i in order[a : a + BATCH] if edge[i] < edge[i + 1]]
            if not some:
                continue
            size = edge[1:][some] - edge[some]
            ids = np.concatenate([bucket[edge[i] : edge[i + 1]] for i in some])
            row = np.repeat(np.arange(len(some)), size)
            wt = (np.concatenate([times[edge[i] : edge[i + 1]] for i in some]) * share[some][row]).astype(np.float32)
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            doc = np.add.reduceat(e[ids] * wt[:, None], first, axis=0)
            p = 1 / (1 + np.exp(-np.clip(doc @ w * SCALE + b, -30, 30)))
            g = (p - y[some]) / len(some)
            # the gradient of a bucket is a multiple of w
            u = np.flatnonzero(np.bincount(ids, minlength=len(e)))
            s = np.bincount(ids, weights=wt * g[row], minlength=len(e))[u] * SCALE
            ge[u] += s * s * (w @ w)
            step = rate * s / np.sqrt(ge[u])
            e[u] -= step[:, None] * w + DECAY * e[u]
            dw, db = g @ doc * SCALE, g.sum()
            gw += dw * dw
            gb += db * db
            w -= 0.2 * rate * dw / np.sqrt(gw)
            b -= 0.2 * rate * db / np.sqrt(gb)
    embedding = np.zeros((BUCKETS, DIM))
    embedding[kept] = e
    return Model(embedding, w * SCALE, b)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of a doc_id as text leaves HELD_OUT modulo 4; a null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model from at most `sample` labelled documents that are not held out, those of the smallest hash of the id, of fewer than SAMPLE_CHARS characters.

    A document with several labels counts as toxic if one says so; null labels, ids and texts are left out.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    total = marks.count()
    if not total:
        return None
    # a hash of the id thins the labels to somewhat more than the sample before any text moves
    share = min(1.0, 1.3 * sample / total)
    thin = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = (
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(thin), "doc_id")
        .where(F.length("text") < SAMPLE_CHARS)
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "text")
        .limit(sample)
        .select("text", "toxic")
        .toArrow()
    )
    texts, marks = rows["text"].to_pylist(), rows["toxic"].to_pylist()
    del rows
    return train(texts, [int(t > 0) for t in marks])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for every row of docs: the probability of the toxic label for the whole text.

    Null and empty texts get the score of an empty bag, as do all texts without a model (no or one label only: 0.0). Each row is
    scored by its own text alone, so copies and repeated or null ids do no harm.
    """
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.table, model.bias))

    def run(batches):
        fitted = sent.value
        # of each word met its number, and by number the sum and the count of its subwords
        memo: dict[str, int] = {}
        sums, counts = np.zeros(0), np.zeros(0, np.int64)
        for pdf in batches:
            out = np.zeros(len(pdf))
            texts = [t or "" for t in pdf["text"]]
            for a, b in chunks([len(t) for t in texts], CHARACTERS) if fitted is not None else ():
                values, bias = fitted
                if len(memo) > 200_000:
                    memo, sums, counts = {}, sums[:0], counts[:0]
                parts = [words_of(t) for t in texts[a:b]]
                new = list(set(chain.from_iterable(parts)).difference(memo))
                memo.update(zip(new, range(len(memo), len(memo) + len(new))))
                for i, j in chunks([len(w) for w in new], CHARACTERS):
                    ids, word = subwords_of(new[i:j])
                    sums = np.append(sums, np.bincount(word, weights=values[ids], minlength=j - i))
                    counts = np.append(counts, np.bincount(word, minlength=j - i))
                number = np.fromiter(map(memo.__getitem__, chain.from_iterable(parts)), np.int64)
                text = np.repeat(np.arange(b - a), [len(p) for p in parts])
                total = np.bincount(text, weights=sums[number], minlength=b - a)
                n = np.bincount(text, weights=counts[number], minlength=b - a)
                out[a:b] = 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(n, 1), -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": out})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; see fit and score."""
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
