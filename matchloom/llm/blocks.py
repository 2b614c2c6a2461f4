"""Questions to the whole corpus about hashed keys, asked and answered in blocks.

Documents are gathered in blocks of a few megabytes and written once. A block asks about its distinct keys (words, n-grams,
windows): they are cut by their leading bits into fragments, and a fragment's task sees all blocks' keys of its range at once,
so it can count or compare them over the whole corpus. Its answers go back to the blocks in the same order. A key that
a third of the documents have is one key a block, fragments are even because keys are hashes, and the number of
fragments grows with the corpus while their size does not. Only non-empty segments are sent, never more than keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, written

BLOCK_BYTES, FRAGMENT_BYTES = 1 << 21, 1 << 24
BLOCK_SCHEMA = "block long, doc_ids array<long>, sizes array<int>, raw long, texts binary"


def make_blocks(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """docs(doc_id, text) as written blocks (block, doc_ids, sizes, raw, texts), texts compressed.

    Null texts count as empty. Rows whose doc_id is null are left out. Other columns are not read.
    """

    block_bytes = block_bytes or BLOCK_BYTES

    def run(batches):
        z, ids, texts, total, k = zstandard.ZstdCompressor(3), [], [], 0, 0
        part = TaskContext.get().partitionId()

        def row():
            return pd.DataFrame(
                {
                    "block": [(part << 24) + k],
                    "doc_ids": [np.array(ids, np.int64)],
                    "sizes": [np.array([len(t) for t in texts], np.int32)],
                    "raw": [total],
                    "texts": [z.compress(b"".join(texts))],
                }
            )

        for pdf in batches:
            for i, t in zip(pdf["doc_id"].to_numpy(), as_bytes(pdf["text"])):
                ids.append(i)
                texts.append(t)
                total += len(t)
                if total >= block_bytes:
                    yield row()
                    ids, texts, total, k = [], [], 0, k + 1
        if ids:
            yield row()

    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(plain.mapInPandas(run, BLOCK_SCHEMA), "blocks", zstd=False)


def texts_of(row) -> tuple[np.ndarray, list[bytes]]:
    """(doc_ids, texts) of a block's row."""
    raw = zstandard.ZstdDecompressor().decompress(row.texts, max_output_size=max(1, int(row.raw)))
    end = np.cumsum(row.sizes)
    return np.asarray(row.doc_ids, np.int64), [raw[e - n : e] for e, n in zip(end.tolist(), row.sizes)]


def fragments(blocks: DataFrame, bytes_per_byte: float) -> int:
    """Bits of the fragment number, so that a fragment holds about FRAGMENT_BYTES when a byte of text asks bytes_per_byte."""
    total = blocks.agg(F.sum("raw")).first()[0] or 0  # one number
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, int(max(2, min(least, 1 + total // 65536), total * bytes_per_byte / FRAGMENT_BYTES) - 1).bit_length())


def _planes(a: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, byte plane by byte plane, which compresses."""
    d = np.diff(a, prepend=np.zeros(1, a.dtype))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    d = np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)


def segments(keys: np.ndarray, bits: int):
    """(fragment, begin, end) of sorted keys."""
    frag = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(frag)) + 1
    begin = np.concatenate(([0], cut)) if len(keys) else np.zeros(0, np.int64)
    return zip(frag[begin].tolist(), begin.tolist(), np.concatenate((cut, [len(keys)])).tolist())


def ask_counts(blocks: DataFrame, keys_of: Callable, bits: int) -> DataFrame:
    """(block, frag, counts): for the sorted distinct keys of each block, the corpus's sum of their counts.

    keys_of(block row) -> (sorted distinct keys, counts in this block).
    """

    def ask(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                keys, counts = keys_of(row)
                out = [(f, row.block, _planes(keys[a:b]), counts[a:b].astype(np.uint32).tobytes()) for f, a, b in segments(keys, bits)]
                yield pd.DataFrame(out, columns=["frag", "block", "keys", "counts"])

    def answer(pdf):
        keys = [_unplanes(b) for b in pdf["keys"]]
        every = np.concatenate(keys)
        counts = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["counts"]]).astype(np.float64)
        _, where = np.unique(every, return_inverse=True)
        total = np.bincount(where, weights=counts)[where].astype(np.uint64)  # exact below 2^53
        end = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"block": pdf["block"], "frag": pdf["frag"], "counts": [total[e - len(k) : e].view(np.uint8).reshape(-1, 8).T.tobytes() for k, e in zip(keys, end)]})

    asked = blocks.mapInPandas(ask, "frag int, block long, keys binary, counts binary")
    return asked.groupBy("frag").applyInPandas(answer, "block long, frag int, counts binary")


def with_answers(blocks: DataFrame, answers: DataFrame, use: Callable, schema: str) -> DataFrame:
    """use(block row, answers' rows by fragment) -> frame, for every block with its own answers."""

    def run(left, right):
        right = right.sort_values("frag")
        out = [use(row, right) for row in left.itertuples(index=False)]
        return out[0]

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


def counts_in(right: pd.DataFrame) -> np.ndarray:
    """The answered counts of a block's keys, in the order of its sorted keys."""
    planes = [np.frombuffer(b, np.uint8).reshape(8, -1).T for b in right["counts"]]  # byte plane by byte plane, as most are zero
    return np.ascontiguousarray(np.concatenate(planes)).view(np.uint64).ravel() if planes else np.zeros(0, np.uint64)
