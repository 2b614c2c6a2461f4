"""Byte-level BPE encoding and decoding through a table of distinct words.

Documents are read in blocks of a few megabytes. A block's texts are split at the spaces that always part words, and its
distinct words go to the partition of their hash, where each distinct word of the corpus is encoded once. The ids return to
the blocks and are laid down by position. A word that a third of the documents have is one row's entry a block, so nothing
is hot. Decoding joins ids to the vocabulary's pieces inside the tasks, a table bounded by the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import as_bytes, table, written

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text in a block, and of words (about WORD_SHARE of the text) in a partition of the word table.
BLOCK_BYTES, PARTITION_BYTES, WORD_SHARE = 3 << 20, 1 << 22, 0.4
#: Of compression, for what is shuffled.
LEVEL = 5
#: A lone space between two characters that are not white space always begins a word of the pre-tokeniser, so texts can be cut before it.
#: The space comes first in both patterns, as the search then looks at spaces alone.
CUT, OTHER_SPACE = re.compile(r" (?<=\S )(?=\S)"), re.compile(r" (?:(?<!\S )|(?!\S))")


def _cut(text: str) -> list[str]:
    """The text's pieces, all but the first without the space that they begin with."""
    return text.split(" ") if OTHER_SPACE.search(text) is None else CUT.split(text)


def split_words(text: str) -> list[str]:
    """The text in pieces that can be encoded apart; most are one word with its space and punctuation."""
    first, *rest = _cut(text)
    return [*([first] if first else []), *(" " + w for w in rest)]


def special_tokens(path: str) -> list[str]:
    return [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]


def _tokenizer(path: str) -> Tokenizer:
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


_TOKENIZERS: dict[str, Tokenizer] = {}


def _shared_tokenizer(path: str) -> Tokenizer:
    """One a Python worker, on the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _tokenizer(path)
    return _TOKENIZERS[path]


def _blocks(batches, block_bytes: int):
    """(number, doc ids, texts) of the blocks of a partition: the same ones whenever its rows come in the same order."""
    part, k, ids, texts, total = TaskContext.get().partitionId() << 24, 0, [], [], 0
    for pdf in batches:
        for i, t in zip(pdf["doc_id"], pdf["text"]):
            ids.append(i)
            texts.append(t)
            total += len(t) + 64
            if total >= block_bytes:
                yield part + k, ids, texts
                k, ids, texts, total = k + 1, [], [], 0
    if ids:
        yield part + k, ids, texts


def _marked(text: str) -> list[str]:
    """The text's pieces: the first one after a space as its mark, as no other begins with one; of an empty text none."""
    out = _cut(text)
    out[0] = " " + out[0]
    return out if text else []


def _word_table(texts: list[str], partitions: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(words of each text, numbers of its words one after the other, distinct words by partition and sorted there, first word of each partition and the end)."""
    parts = [_marked(t) for t in texts]
    distinct = sorted(set(chain.from_iterable(parts)))  # in their order they compress best
    number = dict(zip(distinct, range(len(distinct))))
    size = np.array([len(p) for p in parts], np.int64)
    seq = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, size.sum())
    raw = as_bytes(distinct)
    part = (pd.util.hash_array(np.array(raw, dtype=object), categorize=False) % np.uint64(partitions)).astype(np.int64) if raw else np.zeros(0, np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return size, place[seq], [raw[i] for i in order.tolist()], np.searchsorted(part[order], np.arange(partitions + 1))


def _encoded(tok: Tokenizer, words: list[bytes], length: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each); words as _marked has them, length by id is that of its bytes.

    Words after a space that end in no white space are encoded many at once: the space parts them, and the bytes of the ids say where one ends.
    """
    texts = [w.decode("utf-8", "surrogatepass") for w in words]
    texts = [t[1:] if t.startswith(" ") else " " + t for t in texts]
    joined = [i for i, w in enumerate(words) if not w.startswith(b" ") and not texts[i][-1].isspace()]
    ids: list = [None] * len(texts)
    for a in range(0, len(joined), 2_000):
        some = joined[a : a + 2_000]
        got = np.array(tok.encode_batch_fast(["".join([texts[i] for i in some])], add_special_tokens=False)[0].ids, kind)
        end = np.cumsum(length[got])
        want = np.cumsum([len(words[i]) + 1 for i in some])
        at = np.searchsorted(end, want)
        if len(end) and end[-1] == want[-1] and (end[at] == want).all():
            for i, x in zip(some, np.split(got, at[:-1] + 1)):
                ids[i] = x
    rest = [i for i, x in enumerate(ids) if x is None]
    for a in range(0, len(rest), 2_000):
        some = rest[a : a + 2_000]
        for i, e in zip(some, tok.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)):
            ids[i] = np.array(e.ids, kind)
    return np.concatenate(ids) if ids else np.zeros(0, kind), np.array([len(x) for x in ids], np.int64)


def _flat(numbers: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the stretches first[i] to first[i] + size[i], for each i of numbers in turn."""
    n = size[numbers]
    return np.repeat(first[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def encode(docs: DataFrame, path: str | None = None, stable: bool = False, block_bytes: int | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs(doc_id, text): the ids of the whole text.

    Null texts count as empty and give no ids. Rows whose doc_id is null or repeated each keep their own ids; other columns
    are not read. An empty table gives an empty one. A block's words and the row that says where they stand leave one task in one
    shuffle, which is read twice; should it be made anew, docs must give its rows in the same order: unless the caller says that it is
    stable (a scan of files), it is written to the shared folder first. Blocks that differ raise an error.
    """
    path, block_bytes = path or public_tokenizers.path(TOKENIZER), block_bytes or BLOCK_BYTES
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not stable:
        texts = written(texts, "texts")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = int(max(min(least, 1 + total // 65536), total * WORD_SHARE // PARTITION_BYTES, 1))
    narrow = np.dtype("<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")

    def ask(batches):
        """Rows of words to their partition (dest from 0), and the block's own row with all else to dest -1 - block."""
        z = zstandard.ZstdCompressor(LEVEL)
        for block, ids, part in _blocks(batches, block_bytes):
            size, seq, words, edge = _word_table(part, partitions)
            check = zlib.crc32(seq.tobytes(), zlib.crc32(b"".join(words)))
            fill = "" if kind == "string" else 0
            absent = [i is None or i != i for i in ids]
            planes = seq.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            out = [(-1 - block, block, check, z.compress(size.astype("<u4").tobytes()), len(seq), z.compress(planes), [fill if x else i for i, x in zip(ids, absent)], absent)]
            for f in np.flatnonzero(np.diff(edge)).tolist():
                some = words[edge[f] : edge[f + 1]]
                raw = b"".join(some)
                out.append((f, block, check, z.compress(np.array([len(x) for x in some], "<u4").tobytes()), len(raw), z.compress(raw), [], []))
            yield pd.DataFrame(out, columns=["dest", "block", "check", "sizes", "raw", "data", "doc_ids", "absent"])

    def answer(key, pdf):
        """Each distinct word of the partition is encoded once, whatever number of blocks asks."""
        if key[0] < 0:
            return pd.DataFrame(columns=["dest", "block", "frag", "check", "sizes", "ids"], dtype=object)
        z, c, tok = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(3), _shared_tokenizer(path)
        number: dict[bytes, int] = {}
        asked = []
        for sizes, raw, words in zip(pdf["sizes"], pdf["raw"], pdf["data"]):
            text, end = z.decompress(words, max_output_size=max(1, int(raw))), np.cumsum(np.frombuffer(z.decompress(sizes), "<u4")).tolist()
            some = [text[a:b] for a, b in zip([0, *end[:-1]], end)]
            new = [w for w in some if w not in number]
            number.update(zip(new, range(len(number), len(number) + len(new))))
            asked.append(np.fromiter(map(number.__getitem__, some), np.int64, len(some)))
        every = list(number)
        del number
        flat, size = _encoded(tok, every, _lengths(path), narrow)
        first = np.cumsum(size) - size
        sizes, found = [], []
        for w in asked:
            sizes.append(c.compress(size[w].astype("<u4").tobytes()))
            found.append(c.compress(flat[_flat(w, first, size)].tobytes()))
        return pd.DataFrame({"dest": -1 - pdf["block"], "block": pdf["block"], "frag": key[0], "check": pdf["check"], "sizes": sizes, "ids": found})

    def lay(left, right):
        if not len(left) or left["dest"][0] >= 0:
            return pd.DataFrame(columns=["doc_id", "ids"], dtype=object)
        z, row = zstandard.ZstdDecompressor(), left.iloc[0]
        if len(left) > 1 or (right["check"] != row["check"]).any():
            raise ValueError("the documents came in another order when they were read again")
        right = right.sort_values("frag")
        words = np.cumsum(np.frombuffer(z.decompress(row["sizes"]), "<u4").astype(np.int64))
        n = int(row["raw"])
        planes = np.frombuffer(z.decompress(row["data"], max_output_size=max(1, 4 * n)), np.uint8)
        seq = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        size = np.frombuffer(b"".join(z.decompress(x) for x in right["sizes"]), "<u4").astype(np.int64)
        flat = np.frombuffer(b"".join(z.decompress(x) for x in right["ids"]), narrow)
        if n and seq.max() >= len(size):
            raise ValueError("words of a block have no answer")
        ids = flat[_flat(seq, np.cumsum(size) - size, size)].astype(np.int32)
        end = np.concatenate(([0], np.cumsum(size[seq])))[words]
        return pd.DataFrame({"doc_id": pd.Series([None if x else i for i, x in zip(row["doc_ids"], row["absent"])], dtype=object), "ids": np.split(ids, end[:-1])})

    asked = texts.mapInPandas(ask, f"dest long, block long, check long, sizes binary, raw long, data binary, doc_ids array<{kind}>, absent array<boolean>")
    answers = asked.groupBy("dest").applyInPandas(answer, "dest long, block long, frag int, check long, sizes binary, ids binary")
    return asked.groupBy("dest").cogroup(answers.groupBy("dest")).applyInPandas(lay, f"doc_id {kind}, ids array<int>")


def pieces(path: str | None = None) -> list[bytes]:
    """The bytes of each id: the vocabulary's pieces with its printable stand-ins turned back, and the special tokens' own text."""
    path = path or public_tokenizers.path(TOKENIZER)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    stands = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    tok = _tokenizer(path)
    special = set(special_tokens(path))
    out = [b""] * tok.get_vocab_size(with_added_tokens=True)
    for piece, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = piece.encode() if piece in special else bytes(stands[c] for c in piece)
    return out


@cache
def _lengths(path: str) -> np.ndarray:
    return np.array([len(x) for x in pieces(path)], np.int64)


def decode(encoded: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, ids, text) for encoded(doc_id, ids): each id joined to its piece, pieces laid end to end and read as UTF-8.

    The table of pieces is bounded by the vocabulary, so the join is a map-side one. Null ids give an empty text, ids outside the
    vocabulary nothing, malformed UTF-8 the replacement character. With digest, ids_sha256 is that of the ids as little-endian 32-bit
    numbers, taken in the same task.
    """
    spark, table_of = encoded.sparkSession, pieces(path)
    sent = spark.sparkContext.broadcast([*table_of, b""])

    def run(batches):
        lookup = pa.array(sent.value, pa.binary())
        last = len(lookup) - 1
        for batch in batches:
            ids = batch.column("ids")
            size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            flat = ids.flatten()  # without what null rows hide
            i = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
            found = lookup.take(pa.array(np.where((i < 0) | (i > last), last, i)))
            first = np.concatenate(([0], np.cumsum(size)))
            at = np.frombuffer(found.buffers()[1], np.int32)[first].tolist() if len(found) else [0] * len(first)
            raw = memoryview(found.buffers()[2]) if len(found) and found.buffers()[2] else memoryview(b"")
            columns = [batch.column("doc_id"), ids, pa.array([str(raw[a:b], "utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())]
            if digest:
                plain, first = i.astype("<u4"), first.tolist()
                columns.append(pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(first[:-1], first[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text", "ids_sha256"][: len(columns)])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string" + ", ids_sha256 string" * digest)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""

    both = decode(encode(table(spark, sf_dir, "documents"), stable=True), digest=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op1_bpe_round_trip": op1_bpe_round_trip}
ORACLE: dict[str, str] = {}
