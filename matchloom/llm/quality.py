"""Line-first quality rules.

Every line is judged alone: by its punctuation (symbols, shouted marks), as navigation (many short items between
bars), as boilerplate (fixed phrases), and by how few different words it has. Failing lines are removed; a document
that loses more than half of its word characters is rejected, as is one that fails the base rules on its whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(i for i in range(256) if i not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Phrases of lines that are boilerplate, lower case.
BOILERPLATE = re.compile(
    rb"all rights reserved|this work is licensed under|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies"
    rb"|enable javascript|lorem ipsum|click here|sign up for our newsletter|subscribe to our|share (?:this )?on (?:facebook|twitter)"
)
#: Limits: symbols, exclamation marks and bars that a line may have in hundredths of its words (a bar between spaces is a word); hundredths of repeated words in a line of at least LONG_LINE words; hundredths of word characters that must stay.
MAX_SYMBOLS, MAX_MARKS, MAX_BARS, MAX_REPEATED, LONG_LINE, MIN_KEPT = 50, 100, 25, 80, 20, 50
MIN_WORDS, MAX_REPEAT_WORDS, WINDOW = 20, 30, 8


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line (with at least one word) is to be removed."""
    n = len(words)
    symbols = len(line.translate(None, _NOT_SYMBOLS))
    if symbols and (100 * symbols > MAX_SYMBOLS * n and symbols > 2):
        return True
    bars = line.count(b"|")
    if bars > 2 and 100 * bars > MAX_BARS * n:
        return True
    if 100 * line.count(b"!") > MAX_MARKS * n and n > 2:
        return True
    if n >= LONG_LINE and 100 * (n - len(set(words))) > MAX_REPEATED * n:
        return True
    return BOILERPLATE.search(line.lower()) is not None


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur at least twice in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    # ranks of runs of 2, 4, 8 ... words, each from two runs of half the length
    size, rank = 1, w
    while size < window:
        step = min(size, window - size)
        pair = rank[: len(rank) - step] * np.int64(len(words) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size += step
    twice = np.bincount(rank)[rank] >= 2
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    seen: set[bytes] = set()
    dups = all_bytes = kept_bytes = 0
    kept_lines = []
    for line in raw.split(b"\n"):
        w = line.split()
        if not w:
            kept_lines.append(line)
            continue
        if line in seen:
            dups += 1
        else:
            seen.add(line)
        size = sum(map(len, w))
        all_bytes += size
        if not line_fails(line, w):
            kept_bytes += size
            kept_lines.append(line)
    repeated = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_WORDS * n
    kept = not failed and 100 * kept_bytes >= MIN_KEPT * all_bytes
    chars = len(b"".join(words).translate(None, _CONTINUATION))
    symbols = len(raw.translate(None, _NOT_SYMBOLS))
    return n, chars, symbols, dups, repeated, failed, kept, b"\n".join(kept_lines).decode("utf-8", "replace")


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, statistics, base_failed, kept[, text, cleaned]) for every row of docs.

    Null and empty texts have no words and fail. Rows stay apart even where doc_id is null or repeated; columns besides doc_id and
    text are not read. No shuffle: each text is judged where it is read.
    """

    def run(batches):
        for pdf in batches:
            rows = [judge(t) for t in pdf["text"]]
            out = pd.DataFrame({"doc_id": pdf["doc_id"]})
            for k, name in enumerate(NAMES):
                out[name] = [r[k] for r in rows]
            if with_text:
                out["cleaned"] = [r[7] for r in rows]
            yield out

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {TYPES}" + ", cleaned string" * with_text
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE: dict[str, str] = {}
