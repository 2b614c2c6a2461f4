"""Stupid-backoff language-model scores against counts of the whole corpus.

N-grams of every block of documents are exploded to hashed keys with counts; the count tables live partitioned by hash
and sum them over the corpus; counts are joined back to each block's n-grams and the words' log scores are summed per
document. Counts of n-grams of two and more words below MIN_COUNT count as unseen, so a text does not vouch for itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .blocks import ask_counts, counts_in, fragments, make_blocks, texts_of, with_answers
from .common import Words, mix, table

ORDER, ALPHA, MIN_COUNT = 2, 0.4, 2
LM_BLOCK_BYTES = 6 << 20
#: The key under which blocks sum their words.
TOTAL = np.uint64(0)


def _grams(w: Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length n, (keys, index of the last word) of all n-grams inside texts."""
    out, h = [], w.hash
    place = np.arange(len(h)) - w.first[w.text] if len(h) else np.zeros(0, np.int64)
    key = mix(h ^ np.uint64(0xA24BAED4963EE407))
    out.append((key, np.arange(len(h))))
    run = key
    for n in range(2, order + 1):
        at = np.flatnonzero(place >= n - 1)
        longer = np.zeros(len(h), np.uint64)
        longer[at] = mix(run[at - 1] * np.uint64(3) + h[at])
        run = longer
        out.append((run[at], at))
    return out


def _distinct(w: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(np.concatenate([k for k, _ in _grams(w, order)]), return_counts=True)
    keep = keys != TOTAL  # a key that hashes to the reserved number is read as unseen
    return np.concatenate(([TOTAL], keys[keep])), np.concatenate(([len(w.hash)], counts[keep]))


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_words, log10_score, mean_log10) for every row of docs with a doc_id.

    A word's score is count(n-gram) / count(its context) for the longest n-gram seen at least min_count times, times alpha for each
    word the context was shortened by; a single word scores count / all words. Null and empty texts have no words, score 0 and a null
    mean. Repeated rows are documents of their own and count as such. Words are lower-cased in A-Z and parted at ASCII white space.
    """
    blocks = make_blocks(docs, LM_BLOCK_BYTES)
    bits = fragments(blocks, 1.5 * order)

    def keys_of(row):
        return _distinct(Words(texts_of(row)[1]), order)

    def use(row, right):
        ids, texts = texts_of(row)
        w = Words(texts)
        keys, _ = _distinct(w, order)
        total = counts_in(right).astype(np.float64)
        look = lambda k: total[np.minimum(np.searchsorted(keys, k), len(keys) - 1)]
        grams = _grams(w, order)
        every = max(total[0], 1.0)
        best = np.log10(np.maximum(look(grams[0][0]), 1) / every)
        below = look(grams[0][0])  # of the n-gram that ends at each word, one shorter than the next
        for keys_n, at in grams[1:]:
            c = look(keys_n)
            context = below[at - 1]
            seen = (c >= min_count) & (context > 0)
            best[at] = np.where(seen, np.log10(np.maximum(c, 1) / np.maximum(context, 1)), np.log10(alpha) + best[at])
            longer = np.zeros(len(below))
            longer[at] = c
            below = longer
        score = np.bincount(w.text, weights=best, minlength=len(texts)) if len(best) else np.zeros(len(texts))
        mean = np.where(w.count > 0, score / np.maximum(w.count, 1), np.nan)
        return pd.DataFrame({"doc_id": ids, "n_words": w.count, "log10_score": score, "mean_log10": [None if np.isnan(m) else m for m in mean]})

    answers = ask_counts(blocks, keys_of, bits)
    return with_answers(blocks, answers, use, "doc_id long, n_words long, log10_score double, mean_log10 double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
ORACLE: dict[str, str] = {}
