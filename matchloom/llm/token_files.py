"""Token ids as Arrow files of equal-length sequences and masks, written and read by a Spark data source.

Rows (doc_id, ids) arrive in ascending order, partition by partition. Each partition becomes a shard of two files in Arrow's random-access
file format, uncompressed, so that a reader maps them into memory and touches only what it asks for:

- `*.sequences.arrow`: the shard's ids end to end, cut into sequences of `length`; columns `ids` (fixed-size list of unsigned 16- or 32-bit
  numbers) and `mask` (fixed-size list of bits: 1 for an id, 0 for the padding after the shard's last id). Every record batch but the
  last holds BATCH sequences, so sequence i lies at i % BATCH of batch i // BATCH.
- `*.documents.arrow`: doc_id, start (ids before it in the shard) and n_tokens of each document.

A task writes under names of its own; a manifest written at commit names the files of the tasks that count, with the ids and
sequences before each shard. Files of a task that failed or ran twice are never read, and an aborted write removes its own.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import shared_dir, table

TOKENIZER, END, LENGTH = "byte_bpe_50k.json", 2, 2048
#: Sequences in a record batch, bytes of text in a shard, documents and ids (4 bytes each) in a batch that is read.
BATCH, SHARD_BYTES, READ_ROWS, READ_BYTES = 256, 1 << 25, 4096, 1 << 22
MANIFEST = "_manifest.json"


# --- ids of whole texts ------------------------------------------------------------------------------------------------


class ByteTokens:
    """Token ids of whole texts by a byte-level BPE tokenizer, each string between lone spaces and line ends encoded once and remembered.

    A space with a character that is no white space beside it begins a word of the tokenizer's pattern, and a line's end between two such
    characters is a word of its own, so texts can be cut there. Plain words, with marks at their end or not, go to the tokenizer's model, many
    in one call; strings of anything else go to the tokenizer itself, as do texts with special tokens. Strings are remembered without the
    space before them, those after a line's end with LINE in its place.
    """

    #: Strings remembered in a generation. Two are kept: what the older one knows moves to the newer one when it is met again.
    LIMIT = 600_000
    WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
    #: A run of these after letters is one word of the tokenizer's pattern; with an apostrophe it may not be.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Stands for a line's end at the start of a string; texts that hold it go to the tokenizer whole.
    LINE, LONE = "\x01", re.compile(r"\n(?<=\S\n)(?=\S)")
    BESIDE, CUT = re.compile(r"\s \s"), re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        #: The model alone, for words that are cut already. It takes bytes as printable stand-ins.
        model = self.tok.model
        model._resize_cache(0)  # every word comes once
        self.model = Tokenizer(model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        #: Texts with one of these go to the tokenizer whole.
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()] + [self.LINE]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.stands = np.arange(256, dtype="<u4")
        other = np.setdiff1d(np.arange(256), printable)
        self.stands[other] = 0x100 + np.arange(len(other))
        self.space = chr(int(self.stands[0x20]))
        #: Whether an id begins with a space, which words have at their start alone.
        self.first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.first[[i for piece, i in vocabulary.items() if piece.startswith(self.space)]] = True
        self.line = vocabulary[chr(int(self.stands[0x0A]))]
        self.dtype = np.dtype("<u2" if len(self.first) <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, words: list[str], between: str) -> np.ndarray:
        """The model's ids of `between`, a word, `between`, the next word and so on; stand-ins of spaces and line ends are its own."""
        plain = "\n".join(words)
        if not plain.isascii():
            plain = self.stands[np.frombuffer(plain.encode(), np.uint8)].tobytes().decode("utf-32-le").replace(chr(int(self.stands[0x0A])), "\n")
        return np.array(self.model.encode_batch_fast([between + plain.replace("\n", between)], add_special_tokens=False)[0].ids, self.dtype)

    def _learn_words(self, words: list[str], bare: list[str]) -> dict[str, bytes]:
        """Remembers words of letters with a space before each; returns the ids of the bare ones, which have none. Ids that begin with a space, or are a line's end, part the words again."""
        out, size = {}, self.dtype.itemsize
        for some, between, memo in ((words, " " + self.space, self.memo), (bare, f" {chr(int(self.stands[0x0A]))} ", out)):
            for k in range(0, len(some), 20_000):
                part = some[k : k + 20_000]
                ids = self._model(part, between)
                raw = ids.tobytes()
                begin = np.flatnonzero(self.first[ids] if memo is self.memo else ids == self.line)
                end = (np.append(begin[1:], len(ids)) * size).tolist()
                begin = ((begin + (memo is out)) * size).tolist()
                memo.update((w, raw[a:b]) for w, a, b in zip(part, begin, end, strict=True))
        return out

    def _learn(self, strings: Iterable[str]) -> None:
        memo, word = self.memo, self.WORD.fullmatch
        words, bare, marked, broken, rest = set(), set(), [], [], []
        for s in strings:
            w = s.rstrip(self.MARKS)
            if w.isascii() and w.isalpha() or word(w):
                words.add(w)
                if w is not s:
                    marked.append((s, w, s[len(w) :]))
            elif w[:1] == self.LINE and word(w, 1):
                bare.add(w[1:])
                broken.append((s, w[1:], s[len(w) :]))
            else:
                rest.append(s)
        bare = self._learn_words(list(words.difference(memo)), list(bare))
        memo.update(zip(rest, self._encode(["\n" + s[1:] if s[:1] == self.LINE else " " + s for s in rest])))
        marks = list({m for x in (marked, broken) for _, _, m in x} | {"\n"})
        marks = dict(zip(marks, self._encode(marks)))
        memo.update([(s, memo[w] + marks[m]) for s, w, m in marked])
        memo.update([(s, marks["\n"] + bare[w] + marks[m]) for s, w, m in broken])

    def _strings(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        if "\n" in text:
            text = self.LONE.sub(" " + self.LINE, text)
        return self.CUT.split(text) if self.BESIDE.search(text) else text.split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """ids as little-endian unsigned 32-bit numbers."""
        was = gc.isenabled()
        gc.disable()  # nothing here is in a cycle, and the collector would look through all new tuples again and again
        try:
            return self._ids(texts)
        finally:
            if was:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.LIMIT:
            self.old, self.memo = self.memo, {}
        parts = [self._strings(t) or [t] for t in texts]
        heads = self._encode([p[0] for p in parts])  # no space is before these
        strings = [s for p in parts for s in p[1:]]
        found = list(map(self.memo.get, strings))
        if None in found:
            new = [i for i, x in enumerate(found) if x is None]
            missing = {strings[i] for i in new}
            known = self.old.keys() & missing
            self.memo.update((s, self.old[s]) for s in known)
            self._learn(missing - known)
            for i in new:
                found[i] = self.memo[strings[i]]
        end = list(accumulate(len(p) - 1 for p in parts))
        out = (h + b"".join(found[a:b]) for h, a, b in zip(heads, [0, *end], end))
        return [np.frombuffer(x, self.dtype).astype("<u4").tobytes() for x in out]


_TOKENS: dict[str, ByteTokens] = {}


def token_ids(docs: DataFrame, path: str | None = None, end: int | None = END) -> DataFrame:
    """(doc_id long, ids binary) of every row of docs(doc_id, text): its whole text's ids and `end`, as little-endian unsigned 32-bit numbers.

    Null texts count as empty. Rows whose doc_id is null or repeated each stay. Rows come in the order of docs; other columns are not read.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches):
        if path not in _TOKENS:
            _TOKENS[path] = ByteTokens(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [i + tail for i in _TOKENS[path](texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


# --- the files ---------------------------------------------------------------------------------------------------------


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), os.path.abspath(path)


def _open(where: fs.FileSystem, path: str):
    """Mapped into memory where the file system is local, read at random elsewhere."""
    return ipc.open_file(pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path))


def _sequence_schema(length: int, width: str) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", pa.type_for_alias(width), False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Shard:
    """Writes one shard; holds no more than a record batch and a batch of documents' places."""

    def __init__(self, where: fs.FileSystem, stem: str, length: int, width: str):
        self.length, self.width, self.dtype = length, width, np.dtype(width)
        self.schema = _sequence_schema(length, width)
        self.streams = [where.open_output_stream(f"{stem}.{kind}.arrow") for kind in ("sequences", "documents")]
        self.out, self.index = (ipc.new_file(s, schema) for s, schema in zip(self.streams, (self.schema, DOCUMENTS)))
        self.rest: list[np.ndarray] = []
        self.held = self.tokens = self.documents = self.sequences = 0
        self.first = None

    def add(self, doc_ids: pa.Array, ids: list[bytes | None]) -> None:
        if not len(ids):
            return
        if not self.documents:
            self.first = doc_ids[0].as_py()
        n = np.array([len(i or b"") // 4 for i in ids], np.int64)
        start = self.tokens + np.cumsum(n) - n
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(start), pa.array(n)], schema=DOCUMENTS))
        self.documents += len(ids)
        self.tokens += int(n.sum())
        size = BATCH * self.length
        for i in ids:
            wide = np.frombuffer(i or b"", "<u4")
            narrow = wide.astype(self.dtype)
            if self.dtype.itemsize < 4 and len(wide) and int(wide.max()) > np.iinfo(self.dtype).max:
                raise ValueError(f"an id does not fit {self.width}")
            self.rest.append(narrow)
            self.held += len(narrow)
            if self.held >= size:
                flat = np.concatenate(self.rest)
                whole = len(flat) // size * size
                for a in range(0, whole, size):
                    self._write(flat[a : a + size], size)
                self.rest, self.held = [flat[whole:].copy()], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        rows = -(-len(flat) // self.length)
        ids = np.zeros(rows * self.length, self.dtype)
        ids[: len(flat)] = flat
        bits = np.packbits(np.arange(rows * self.length) < real, bitorder="little")
        mask = pa.Array.from_buffers(pa.bool_(), rows * self.length, [None, pa.py_buffer(bits.tobytes())])
        columns = [pa.FixedSizeListArray.from_arrays(values, type=field.type) for values, field in zip((pa.array(ids), mask), self.schema)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.sequences += rows

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.rest), self.held)
        for x in (self.out, self.index, *self.streams):
            x.close()


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str
    first: int | None
    documents: int
    tokens: int
    sequences: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.length = options["path"], int(options.get("length", LENGTH))
        self.width = "uint16" if int(options.get("vocabulary", 1 << 32)) <= 1 << 16 else "uint32"
        if self.length % 8:
            raise ValueError("the length must be a multiple of 8, so that masks begin at a byte")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, path = _place(self.path)
        where.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"shard-{part:06d}-{uuid.uuid4().hex}"
        shard = _Shard(where, f"{path}/{name}", self.length, self.width)
        for batch in iterator:
            shard.add(batch.column("doc_id").cast(pa.int64()), batch.column("ids").to_pylist())
        shard.close()
        return _Written(part, name, shard.first, shard.documents, shard.tokens, shard.sequences)

    def commit(self, messages: list[_Written | None]) -> None:
        where, path = _place(self.path)
        where.create_dir(path, recursive=True)
        found = sorted((m for m in messages if m and m.documents), key=lambda m: m.partition)
        rows = [{"name": m.name, "first": m.first, "documents": m.documents, "tokens": m.tokens, "sequences": m.sequences} for m in found]
        with where.open_output_stream(f"{path}/{MANIFEST}.new") as out:
            out.write(json.dumps({"length": self.length, "width": self.width, "shards": rows}).encode())
        where.move(f"{path}/{MANIFEST}.new", f"{path}/{MANIFEST}")  # readers see the old manifest or the new one

    def abort(self, messages: list[_Written | None]) -> None:
        where, path = _place(self.path)
        for m in messages:
            for kind in ("sequences", "documents") if m else ():
                where.delete_file(f"{path}/{m.name}.{kind}.arrow")


class TokenFiles:
    """Random access to written sequences: `files[i]` is (ids, mask bits) of sequence i, views of the mapped file, nothing copied."""

    def __init__(self, path: str):
        self.where, self.path = _place(path)
        with self.where.open_input_stream(f"{self.path}/{MANIFEST}") as f:
            m = json.loads(f.read())
        self.length, self.width, self.shards = m["length"], m["width"], m["shards"]
        self.sequence = [0, *accumulate(s["sequences"] for s in self.shards)]
        self.start = [0, *accumulate(s["tokens"] for s in self.shards)]
        self._readers: dict[tuple[int, str], object] = {}

    def __len__(self) -> int:
        return self.sequence[-1]

    def reader(self, shard: int, kind: str):
        if (shard, kind) not in self._readers:
            self._readers[shard, kind] = _open(self.where, f"{self.path}/{self.shards[shard]['name']}.{kind}.arrow")
        return self._readers[shard, kind]

    def batch(self, shard: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of shape sequences x length, mask bits of shape sequences x length / 8) of one record batch."""
        b = self.reader(shard, "sequences").get_batch(k)
        ids = np.frombuffer(b.column(0).values.buffers()[1], self.width, b.num_rows * self.length)
        bits = np.frombuffer(b.column(1).values.buffers()[1], np.uint8, b.num_rows * self.length // 8)
        return ids.reshape(b.num_rows, -1), bits.reshape(b.num_rows, -1)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        shard = bisect_right(self.sequence, i) - 1
        k, row = divmod(i - self.sequence[shard], BATCH)
        ids, bits = self.batch(shard, k)
        return ids[row], bits[row]

    def ids(self, shard: int, start: int, n: int) -> np.ndarray:
        """n ids from place `start` of a shard on."""
        out, size = [], BATCH * self.length
        while n:
            k, at = divmod(start, size)
            part = self.batch(shard, k)[0].reshape(-1)[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, self.width)


@dataclass
class _ShardPartition(InputPartition):
    shard: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.view = options["path"], options.get("view", "documents")

    def partitions(self) -> list[_ShardPartition]:
        return [_ShardPartition(i) for i in range(len(TokenFiles(self.path).shards))] or [_ShardPartition(-1)]

    def read(self, partition: _ShardPartition) -> Iterator[pa.RecordBatch]:
        if partition.shard < 0:
            return
        files, s = TokenFiles(self.path), partition.shard
        if self.view == "sequences":
            for k in range(files.reader(s, "sequences").num_record_batches):
                ids, bits = files.batch(s, k)
                first, n = files.sequence[s] + k * BATCH, len(ids)
                flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * files.length, pa.array(ids.reshape(-1).astype(np.int32)))
                real = np.unpackbits(bits, axis=1, bitorder="little").sum(1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), flat, pa.array(real)], ["sequence_id", "ids", "n_real"])
            return
        index = files.reader(s, "documents")
        for k in range(index.num_record_batches):
            b = index.get_batch(k)
            start, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            for a, z in _runs(n):
                flat = files.ids(s, int(start[a]), int(n[a:z].sum())).astype("<u4")
                end = np.concatenate(([0], np.cumsum(n[a:z]) * 4))
                if end[-1] >= 1 << 31:
                    raise ValueError("a document of 2^29 ids or more does not fit one row")
                ids = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(end.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(start[a:z] + files.start[s]), pa.array(n[a:z]), ids], ["doc_id", "start", "n_tokens", "ids"])


def _runs(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most READ_ROWS rows and READ_BYTES together, at least one document each."""
    a, total = 0, 0
    for i, x in enumerate(n.tolist()):
        if i > a and (i - a >= READ_ROWS or total + 4 * x > READ_BYTES):
            yield a, i
            a, total = i, 0
        total += 4 * x
    if a < len(n):
        yield a, len(n)


class TokenSource(DataSource):
    """`format("token_files")`: writes (doc_id, ids binary); reads `view` documents (doc_id, start, n_tokens, ids) or sequences.

    A write replaces what the path held: its manifest names the new shards alone.
    """

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        if self.options.get("view", "documents") == "sequences":
            return "sequence_id long, ids array<int>, n_real long"
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = END, length: int = LENGTH) -> str:
    """Writes the ids of docs(doc_id, text) to token files at `path` in ascending doc_id order (null first, ties by the text's hash); returns the path.

    Texts are range-partitioned by doc_id into shards of about SHARD_BYTES and encoded where they lie sorted: one shuffle. Null texts count as
    empty and give `end` alone; repeated rows are documents of their own; a text of any length is one document; an empty table gives a
    manifest without shards. Other columns are not read.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or public_tokenizers.path(TOKENIZER)
    spark.dataSource.register(TokenSource)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = int(max(min(least, 1 + total // 65536), total // SHARD_BYTES, 1))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = plain.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    size = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    ids = token_ids(ordered, tokenizer, end)
    ids.write.format("token_files").mode("append").option("length", length).option("vocabulary", max(size, (end or 0) + 1)).save(path)
    return path


def read_token_files(spark: SparkSession, path: str, view: str = "documents") -> DataFrame:
    """view documents: (doc_id, start, n_tokens, ids binary), start counting all ids before it; sequences: (sequence_id, ids, n_real)."""
    spark.dataSource.register(TokenSource)
    return spark.read.format("token_files").option("view", view).load(path)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    path = write_token_files(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}")
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op12_token_files": op12_token_files}
ORACLE: dict[str, str] = {}
