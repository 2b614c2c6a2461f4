"""Packing documents into training sequences by lexical retrieval.

Documents are tokenised and dealt to shards of about SHARD_TOKENS tokens by content: the smallest hash of their pairs of
neighbouring ids, which copies have in common and related texts often. A content of more tokens than half a shard is
salted by row, so shards are bounded whatever the texts are. Each shard holds a BM25 inverted index over its documents'
token ids. A seed document starts a window; what the window still lacks is filled greedily with the seed's best-scoring
unused neighbours. The document that crosses the window's end is cut there and its rest seeds the next window, so that
every window but a shard's last one is full. The number of shards grows with the corpus and their size does not.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import mix, table, written

TOKENIZER, END = "word_bpe_49k.json", 2
WINDOW, SHARD_TOKENS = 4096, 1 << 21
#: BM25's saturation of term counts in documents and in the seed, and its share of length normalisation.
K1, K3, B = 1.2, 8.0, 0.75


#: Rows of the salt table (16 bytes each) that are broadcast at most.
BROADCAST_ROWS = 100_000


class _Tokens:
    """Token ids of whole texts. White space always parts words, so each string between white space is encoded once and remembered.

    Texts are normalised as the tokenizer does, punctuation at the end of a word is parted, and new strings are cut into words by the
    tokenizer's pattern; the words go to its model in one call. Strings with characters that Python does not know go to the tokenizer.
    """

    LIMIT = 500_000
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: The mark comes first, as the search then looks at marks alone.
    TAIL = re.compile(r"[.,;:!?](?<=[^\W_].)(?!\S)")

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        #: The model alone, for words that are cut already; a word's last piece says that it is the last one.
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.last = np.zeros(self.tok.get_vocab_size(), bool)
        self.last[[i for piece, i in self.tok.get_vocab(with_added_tokens=False).items() if piece.endswith("</w>")]] = True
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        #: The model takes bytes as printable stand-ins.
        self.stands = np.arange(256, dtype="<u4")
        other = np.setdiff1d(np.arange(256), [0x20, *printable])
        self.stands[other] = 0x100 + np.arange(len(other)) + (other > 0x20)  # the space, which has a stand-in too, parts words here
        self.memo: dict[str, bytes] = {}
        #: Texts with these go to the tokenizer whole: special tokens, and separators that only Python takes as white space.
        self.odd = [t.content for t in self.tok.get_added_tokens_decoder().values()] + ["\x1c", "\x1d", "\x1e", "\x1f"]

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def strings(self, text: str) -> list[str] | None:
        if any(o in text for o in self.odd):
            return None
        if text.isascii():
            low = text.lower()
        else:  # of sigmas the tokenizer knows one lower case alone
            low = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return self.TAIL.sub(r" \g<0>", low).split()

    def learn_words(self, words: list[str]) -> None:
        plain = " ".join(words)
        if not (plain.isascii() and plain.isprintable()):
            plain = self.stands[np.frombuffer(plain.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.model.encode_batch_fast([plain], add_special_tokens=False)[0].ids, "<u4")
        end = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        raw, memo, a = ids.tobytes(), self.memo, 0
        for w, b in zip(words, end, strict=True):
            memo[w] = raw[a:b]
            a = b

    def learn(self, strings: set[str]) -> None:
        memo = self.memo
        unknown = {x for x in set("".join(strings)) if unicodedata.category(x) in ("Cn", "Cs")}
        odd = {x for x in strings if not unknown.isdisjoint(x)} if unknown else set()
        words, cut = set(), []
        for x in strings - odd if odd else strings:
            if x.isalpha():
                words.add(x)
            else:
                found = self.PATTERN.findall(x)
                cut.append((x, found))
                words.update(w for w in found if w not in memo)
        if words:
            self.learn_words(list(words))
        for x, found in cut:
            memo[x] = b"".join([memo[w] for w in found])
        for x in odd:
            memo[x] = self.whole(x)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """ids as little-endian uint32."""
        if len(self.memo) > self.LIMIT:
            self.memo.clear()
        parts = [self.strings(t) for t in texts]
        missing = set().union(*(p for p in parts if p)).difference(self.memo)
        if missing:
            self.learn(missing)
        get = self.memo.__getitem__
        return [self.whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts)]


_TOKENS: dict[str, _Tokens] = {}


def _tokens(path: str) -> _Tokens:
    """One a Python worker, so that tasks share what it remembers."""
    if path not in _TOKENS:
        _TOKENS[path] = _Tokens(path)
    return _TOKENS[path]


class _Index:
    """BM25 over one shard's documents, as postings in arrays. Terms of one document alone have no posting: they find only itself."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        size = np.array([len(d) for d in docs], float)
        norm = K1 * (1 - B + B * size / max(size.mean(), 1))
        small = self.n * (int(max(d.max() for d in docs)) + 1) < 2**32
        kind = np.uint32 if small else np.int64  # narrow numbers sort faster
        row = np.repeat(np.arange(self.n, dtype=kind), size.astype(np.int64))
        pair, tf = np.unique(np.concatenate(docs).astype(kind) * kind(self.n) + row, return_counts=True)
        term, row = (pair // kind(self.n)).astype(np.int64), (pair % kind(self.n)).astype(np.int64)
        keys, df = np.unique(term, return_counts=True)
        several = np.repeat(df > 1, df)
        row, tf, keys, df = row[several], tf[several], keys[df > 1], df[df > 1]
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        number = np.repeat(np.arange(len(keys)), df)
        weight = (idf[number] * tf * (K1 + 1) / (tf + norm[row])).astype(np.float32)
        # the terms of each document, and how much they count in it as a seed
        by = np.argsort(row, kind="stable")
        self.terms, self.times = number[by], (tf * (K3 + 1) / (tf + K3))[by].astype(np.float32)
        self.of = np.searchsorted(row[by], np.arange(self.n + 1))
        # terms of many documents are rows of a matrix, the others postings
        many = df * 16 > self.n
        self.dense = np.cumsum(many) - 1
        self.dense[~many] = -1
        self.matrix = np.zeros((int(many.sum()), self.n), np.float32)
        here = many[number]
        self.matrix[self.dense[number[here]], row[here]] = weight[here]
        self.row, self.weight = row[~here], weight[~here]
        self.first = np.concatenate(([0], np.cumsum(np.where(many, 0, df))))

    def scores(self, i: int) -> np.ndarray:
        """Of all documents for document i as the query, over all its terms."""
        t, times = self.terms[self.of[i] : self.of[i + 1]], self.times[self.of[i] : self.of[i + 1]]
        at = self.dense[t]
        query = np.zeros(len(self.matrix), np.float32)
        query[at[at >= 0]] = times[at >= 0]
        t, times = t[at < 0], times[at < 0]
        size = self.first[t + 1] - self.first[t]
        at = np.repeat(self.first[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return query @ self.matrix + np.bincount(self.row[at], weights=self.weight[at] * np.repeat(times, size), minlength=self.n)


def _best_last(score: np.ndarray) -> list[int]:
    """The places of positive scores, the highest one last, of equal ones the first one later."""
    some = np.flatnonzero(score > 0)
    return some[np.argsort(-score[some], kind="stable")][::-1].tolist()


def _fill(docs: list[np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a shard."""
    index = _Index(docs)
    unused = np.ones(index.n, bool)
    out, seq, used, begin = [], 0, 0, 0
    queue: list[int] = []  # the seed's neighbours, best last

    def place(i: int) -> bool:
        """Lay document i down from where the window stands; True if its rest begins a new window."""
        nonlocal seq, used
        unused[i] = False
        start, crossed = 0, False
        while start < len(docs[i]):
            n = min(window - used, len(docs[i]) - start)
            out.append((i, start, n, seq, used))
            start, used = start + n, used + n
            if used == window:
                seq, used, crossed = seq + 1, 0, True
        return crossed

    while True:
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            i = queue.pop()
        else:
            while begin < index.n and not unused[begin]:
                begin += 1
            if begin == index.n:
                return out
            i = begin
        if place(i) or not queue:
            queue = _best_last(np.where(unused, index.scores(i), -1))


def _contents(ids: list[bytes]) -> np.ndarray:
    """Of each document the smallest hash of its pairs of neighbouring ids; of its only id, if there is one alone."""
    every = np.frombuffer(b"".join(ids), "<u4").astype(np.uint64)
    first = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
    pairs = every * np.uint64(0x9E3779B97F4A7C15)
    pairs[:-1] ^= every[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(29)
    pairs *= np.uint64(0xBF58476D1CE4E5B9)
    several = np.diff(first) > 1
    pairs[first[1:][several] - 1] = np.uint64(2**64 - 1)  # an end id and the next document's first one are no pair
    return mix(np.minimum.reduceat(pairs, first[:-1])).view(np.int64)


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids binary, tokens, content, row): little-endian unsigned 32-bit ids of each whole text and the end id; null texts count as empty.

    tokens is the number of ids, so that sums need not read them. content is equal for texts that are mostly equal; row numbers the rows once the result is written.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        tokens, row = _tokens(path), TaskContext.get().partitionId() << 40
        end = np.array([END], "<u4").tobytes()
        for pdf in batches:
            ids = [x + end for x in tokens(list(pdf["text"]))]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "tokens": [len(x) // 4 for x in ids], "content": _contents(ids) if ids else [], "row": np.arange(row, row + len(pdf))})
            row += len(pdf)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).mapInPandas(run, f"doc_id {kind}, ids binary, tokens long, content long, row long")


def _dealt(ids: DataFrame, shard_tokens: int) -> DataFrame:
    """ids with shard and shards: by content, and contents of over half a shard also by row."""
    total = ids.agg(F.sum("tokens")).first()[0] or 0  # one number
    shards = int(max(1, -(-total // shard_tokens)))
    # fewer than two contents a shard can be that frequent: mostly none, and beyond BROADCAST_ROWS they are joined by a shuffle
    hot = ids.groupBy("content").agg(F.sum("tokens").alias("n")).where(F.col("n") > shard_tokens // 2).select("content", F.ceil(2 * F.col("n") / shard_tokens).alias("salts"))
    hot = written(hot, "hot-contents")
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("row"), "salts")).otherwise(0)
    return ids.join(hot, "content", "left").select("doc_id", "ids", "row", F.pmod(F.xxhash64("content", salt), F.lit(shards)).alias("shard"), F.lit(shards).alias("shards"))


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids (binary).

    Each row of docs is a document of its own, also where doc_id is null or repeated. Empty and null texts give one piece with the
    end id alone. Ties between neighbours go to the document first in the shard, which is sorted by doc_id and content.
    """
    kind = dict(docs.dtypes)["doc_id"]
    dealt = _dealt(written(tokenised(docs, path), "token-ids"), shard_tokens)

    def run(key, pdf):
        pdf = pdf.sort_values(["doc_id", "ids", "row"], na_position="last").reset_index(drop=True)
        raw = list(pdf["ids"])
        got = _fill([np.frombuffer(x, "<u4") for x in raw], window)
        if not got:
            return pd.DataFrame({k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")})
        i, start, length, seq, offset = map(np.array, zip(*got))
        part = [raw[d][4 * s : 4 * (s + n)] for d, s, n in zip(i, start, length)]
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].to_numpy()[i],
                "start": start,
                "length": length,
                "ids_crc32": [zlib.crc32(p) for p in part],
                "doc_tokens": [len(raw[d]) // 4 for d in i],
                "sequence_id": seq * int(key[1]) + int(key[0]),
                "offset": offset,
                "ids": part,
            }
        )

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return dealt.groupBy("shard", "shards").applyInPandas(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


QUERIES = {"op4_packing": op4_packing}
ORACLE: dict[str, str] = {}
