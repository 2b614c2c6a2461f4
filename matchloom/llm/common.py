"""What the training-data operators share: table paths, written intermediates and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The bytes that `[^\x20\x09-\x0D]+` separates words at.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 1


#: Rows, and bytes of rows, sent to Python at once. Texts can be long, and a batch is held several times over on its way.
BATCH_ROWS, BATCH_BYTES = 500, 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir. Where that is unset a local session makes one of its own; a cluster's is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, zstd: bool = True) -> DataFrame:
    """df as a table in the shared folder: what is built on it reads files and does not depend on any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd" if zstd else "none").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of h."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_POW.get("p", ())) < n:
        size = -(-n // 65536) * 65536
        inverse = pow(_BASE, -1, 1 << 64)
        for key, b in (("p", _BASE), ("q", inverse)):
            out = np.ones(size, dtype=np.uint64)
            k = 1
            while k < size:
                out[k : 2 * k] = out[: min(k, size - k)] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
            _POW[key] = out
    return _POW["p"][:n], _POW["q"][:n]


#: Bytes of text whose words are hashed at once.
SLICE = (1 << 16) - 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of several texts as arrays: hash, text index, first byte and end byte of each word, found without a Python object per word."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.offset = np.concatenate(([0], np.cumsum(size + 1)))  # each text is followed by a line feed
        raw = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", dtype=np.uint8)
        self.raw = raw
        b = LOWER[raw] if lower else raw
        gap = SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):  # some words at a time, as sums and powers take 40 bytes a byte of text
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, a + SLICE, side="right")))
            start, end = self.start[i:j] - a, self.end[i:j] - a
            p, q = _powers(int(end[-1]) + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b[a : a + end[-1]]] * p[:-1], dtype=np.uint64)))
            self.hash[i:j] = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))
            i = j
        self.text = np.searchsorted(self.offset, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))  # of each text's words


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, word index) of all runs of n words; a text of fewer words gives one run of all its words, none if it has no word."""
    count, first = w.count, w.first
    at = np.arange(len(w.hash))
    here = at + n <= first[1:][w.text] if len(at) else np.zeros(0, bool)
    at = at[here]
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(3) + w.hash[at + k])
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        return h, w.text[at], at
    extra = np.empty(len(short), np.uint64)
    for j, t in enumerate(short):
        x = np.uint64(count[t])
        with np.errstate(over="ignore"):
            for y in w.hash[first[t] : first[t + 1]]:
                x = mix(np.array([x * np.uint64(3) + y], np.uint64))[0]
        extra[j] = x ^ np.uint64(0x5851F42D4C957F2D)
    h, text, at = np.concatenate((h, extra)), np.concatenate((w.text[at], short)), np.concatenate((at, first[short]))
    order = np.argsort(at, kind="stable")
    return h[order], text[order], at[order]


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of a column of texts; null counts as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def chunks(sizes, limit: int):
    """Ranges of rows of about `limit` bytes together, at least one row each."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
