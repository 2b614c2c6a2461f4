"""Phrase collocations of each language, counted by prefix-free parsing.

Texts are cut into pieces at punctuation and pieces into words. A run of LONGEST - 1 words whose hash says so is a trigger; pieces are cut
into chunks that begin at the piece's start or at a trigger and end with the next trigger's words or the piece. Neighbouring chunks
overlap in the trigger's words, so every phrase of up to LONGEST words lies in the chunk that owns its first word, and in that one
alone. What owns what can be read off the chunk, so the corpus is its dictionary: distinct chunks with how often they
were parsed. Phrases are counted inside distinct chunks, times the chunk's count, each from the words that the chunk owns.

Counting goes twice over the dictionary. First, blocks of chunks ask for the sums of narrow hashes of their phrases: the fragment that
holds a range of hashes sees all blocks' counts of it and answers whether the sum reaches the least count, and whether the block is the
first that asked. A narrow hash can stand for several phrases, so this finds too many at worst. Then blocks send the counts of
phrases with such hashes under hashes of 64 bits, packed, and the texts of those that they asked for first. So what is
rare is never a row, and what is frequent is one row, not one a block.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import _planes, _unplanes, fragments, segments, with_answers
from .common import _BYTE, LOWER, _powers, as_bytes, mix, table, written

#: Fixed values of the contract: longest phrase, least count, kept phrases of a language, per cent of a phrase's count that a longer one must reach.
LONGEST, LEAST, KEPT, SHARE = 5, 100, 2000, 100
#: One in so many runs of words is a trigger; text gathered before its chunks are counted; a block of the dictionary.
TRIGGER, GATHER_BYTES, DICTIONARY_BYTES = 16, 1 << 22, 1 << 21
#: Phrases whose text is looked up at once, where another block was asked for it.
LOST = 10_000
#: Languages whose word counts are broadcast at most.
LANGS = 10_000
OWN = "frag int, keys binary, counts binary, key long, lang string, phrase string, words int, f long"
COLUMNS = ["frag", "keys", "counts", "key", "lang", "phrase", "words", "f"]
#: What parts words, and what parts pieces.
GAP, STOP = np.zeros(256, bool), np.zeros(256, bool)
STOP[[*b".,;:!?\n\x0b\x0c\r"]] = True
GAP[[0x20, 0x09]] = True
GAP |= STOP
_WIDE = re.compile(rb"[\x20\x09]+")


class _Words:
    """Words of several texts as arrays: first byte, end byte, hash, text, and the number of the piece each lies in. Pieces end at STOP and with the text."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate(([0], np.cumsum(size + 1)))  # each text is followed by a line feed
        self.raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], GAP[self.raw])).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        p, q = _powers(len(self.raw) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.raw] * p[:-1], dtype=np.uint64)))
        self.hash = mix((total[self.end] - total[self.start]) * q[self.start] + (self.end - self.start).astype(np.uint64))
        stops = np.cumsum(STOP[self.raw])[self.start] if len(self.start) else np.zeros(0, np.int64)
        new = np.diff(stops, prepend=-1) > 0
        self.piece = np.cumsum(new) - 1
        self.first = np.concatenate((np.flatnonzero(new), [len(self.hash)]))  # of each piece's words
        self.text = np.searchsorted(first, self.start, side="right") - 1

    def runs(self, n: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of n words that begin at `places` (anywhere) and end in the piece they begin in."""
        at = np.arange(len(self.hash)) if places is None else places
        at = at[at + n <= self.first[self.piece[at] + 1]]
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(3) + self.hash[at + k])
        return at, h + np.uint64(n)


def _triggers(w: _Words, width: int, every: int) -> np.ndarray:
    """Places where a trigger of `width` words begins."""
    at, h = w.runs(width)
    return at[mix(h) % np.uint64(every) == 0]


def parse(texts: list[bytes], width: int, every: int) -> tuple[np.ndarray, list[bytes]]:
    """(text, chunk) of every chunk of the texts; a chunk's words are joined by single spaces."""
    w = _Words(texts)
    if not len(w.hash):
        return np.zeros(0, np.int64), []
    begin = np.union1d(w.first[:-1], _triggers(w, width, every))
    piece = w.piece[begin]
    last = np.append(piece[1:] != piece[:-1], True)
    stop = np.where(last, w.first[piece + 1], np.append(begin[1:], 0) + width)  # one after the chunk's last word
    a, b = w.start[begin], w.end[stop - 1]
    wide = np.cumsum(np.concatenate(([0], (w.start[1:] - w.end[:-1] != 1) | (w.raw[w.end[:-1]] != 0x20))))
    odd = (wide[stop - 1] - wide[begin]) > 0  # a gap inside that is not one space
    raw = w.raw.tobytes()
    chunks = [raw[i:j] for i, j in zip(a.tolist(), b.tolist())]
    for k in np.flatnonzero(odd).tolist():
        chunks[k] = _WIDE.sub(b" ", chunks[k])
    return w.text[begin], chunks


def dictionary(docs: DataFrame, longest: int = LONGEST, every: int = TRIGGER) -> DataFrame:
    """(lang, chunk, n): the distinct chunks of each language and how often they were parsed.

    Chunks are counted in the task first, so one that a third of the texts hold is one row a task. Null texts have no words, a null
    lang counts as `und`. Rows count as often as they are repeated; a null doc_id makes no difference, other columns are not read.
    """
    width = longest - 1

    def run(batches):
        held: list[tuple[str, bytes]] = []
        total = 0

        def count():
            langs = [x for x, _ in held]
            at, chunks = parse([x for _, x in held], width, every)
            n = Counter(zip([langs[i] for i in at.tolist()], chunks))
            # chunks are cut at ASCII bytes alone, so they are UTF-8 where the texts are
            rows = [(x, c.decode("utf-8", "surrogatepass"), k) for (x, c), k in n.items()]
            return pd.DataFrame(rows, columns=["lang", "chunk", "n"]).astype({"lang": object, "chunk": object, "n": "int64"})

        for pdf in batches:
            for lang, text in zip(pdf["lang"], as_bytes(pdf["text"])):
                held.append((lang, text))
                total += len(text) + 64
                if total >= GATHER_BYTES:
                    yield count()
                    held, total = [], 0
        if held:
            yield count()

    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    return plain.mapInPandas(run, "lang string, chunk string, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def _blocks(chunks: DataFrame) -> DataFrame:
    """Written blocks (block, langs, sizes, counts, raw, texts) of about DICTIONARY_BYTES of the dictionary; langs is the number of a lang among `names`."""

    def run(batches):
        z, part, k = zstandard.ZstdCompressor(3), TaskContext.get().partitionId(), 0
        names: dict[str, int] = {}
        langs, sizes, counts, texts, total = [], [], [], [], 0

        def row():
            return pd.DataFrame({"block": [(part << 24) + k], "names": [list(names)], "langs": [np.array(langs, np.int32)], "sizes": [np.array(sizes, np.int32)], "counts": [np.array(counts, np.int64)], "raw": [total], "texts": [z.compress(b"".join(texts))]})

        for pdf in batches:
            for lang, chunk, n in zip(pdf["lang"], as_bytes(pdf["chunk"]), pdf["n"]):
                langs.append(names.setdefault(lang, len(names)))
                sizes.append(len(chunk))
                counts.append(n)
                texts.append(chunk)
                total += len(chunk)
                if total >= DICTIONARY_BYTES:
                    yield row()
                    names, langs, sizes, counts, texts, total, k = {}, [], [], [], [], 0, k + 1
        if texts:
            yield row()

    return written(chunks.select("lang", "chunk", "n").mapInPandas(run, "block long, names array<string>, langs array<int>, sizes array<int>, counts array<long>, raw long, texts binary"), "chunks", zstd=False)


class _Phrases:
    """The phrases of a block's chunks: of each distinct one its hash, language, count, and where it stands."""

    def __init__(self, row, longest: int, every: int):
        raw = zstandard.ZstdDecompressor().decompress(row.texts, max_output_size=max(1, int(row.raw)))
        end = np.cumsum(row.sizes)
        self.w = w = _Words([raw[e - n : e] for e, n in zip(end.tolist(), row.sizes)])
        width = longest - 1
        self.names = list(row.names)
        lang, counts = np.asarray(row.langs, np.int64), np.asarray(row.counts, np.int64)
        # a chunk of more words than a trigger's that ends in one does not own that one's words
        words = np.diff(w.first)
        ends = np.zeros(len(w.hash) + 1, bool)
        ends[_triggers(w, width, every)] = True
        cut = (words > width) & ends[np.maximum(w.first[1:] - width, 0)]
        owned = np.where(cut, words - width, words)
        place = np.arange(len(w.hash)) - w.first[:-1][w.piece]
        own = np.flatnonzero(place < owned[w.piece])
        self.words = np.bincount(lang[w.text[own]], weights=counts[w.text[own]], minlength=len(self.names)).astype(np.int64)  # exact below 2^53
        salt = np.array([hash_text(x) for x in self.names], np.uint64)
        at, h, n = [], [], []
        for k in range(1, longest + 1):
            a, x = w.runs(k, own)
            at.append(a)
            h.append(mix(x ^ salt[lang[w.text[a]]]) if len(a) else x)
            n.append(np.full(len(a), k))
        at, h, n = np.concatenate(at), np.concatenate(h), np.concatenate(n)
        self.key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        self.at, self.size = at[first], n[first]
        self.lang = lang[w.text[self.at]] if len(self.at) else self.at
        total = np.zeros(len(self.key), np.int64)
        np.add.at(total, inverse, counts[w.text[at]])
        self.count = total

    def text(self, i: np.ndarray) -> list[str]:
        raw, w = self.w.raw.tobytes(), self.w
        return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(w.start[self.at[i]].tolist(), w.end[self.at[i] + self.size[i] - 1].tolist())]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of COLUMNS as Python objects: numbers beside nulls would become floats, which do not hold 64 bits."""
    return pd.DataFrame({c: pd.Series(list(x), dtype=object) for c, x in zip(COLUMNS, zip(*rows) if rows else [()] * len(COLUMNS))})


def hash_text(x: str) -> int:
    b = np.frombuffer(x.encode("utf-8", "surrogatepass") + b"\x01", np.uint8)
    p, _ = _powers(len(b))
    return int(mix(np.array([np.sum(_BYTE[b] * p, dtype=np.uint64)], np.uint64))[0])


def _cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct leading `bits` bits of sorted keys, the place of each key's among them)."""
    narrow = keys >> np.uint64(64 - bits)
    new = np.diff(narrow, prepend=narrow[:1] + np.uint64(1)) != 0 if len(narrow) else np.zeros(0, bool)
    return narrow[new], np.cumsum(new) - 1


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, every: int = TRIGGER) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 1 to `longest` words with f >= least; words is 0 for the row that counts a language's words."""
    blocks = _blocks(dictionary(docs, longest, every))
    chars = blocks.agg(F.sum("raw")).first()[0] or 0  # one number
    parts = fragments(blocks, 2.0)
    # frequent phrases are no more than words / least, so that at twice their bits hardly two share a hash; another block can then be the first to ask for one
    bits = min(64, max(32, parts + 8, 2 * max(math.ceil(math.log2(chars / (2 * least) + 1)), 0) + 2))

    def ask(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                p = _Phrases(row, longest, every)
                keys, where = _cut(p.key, bits)
                n = np.minimum(np.bincount(where, weights=np.minimum(p.count, least), minlength=len(keys)), least).astype("<u4")
                wide = keys << np.uint64(64 - bits)
                out = [(f, row.block, _planes(keys[a:b]), n[a:b].tobytes()) for f, a, b in segments(wide, parts)]
                yield pd.DataFrame(out, columns=["frag", "block", "keys", "counts"])

    def answer(pdf):
        pdf = pdf.sort_values("block")
        keys = [_unplanes(b) for b in pdf["keys"]]
        _, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([np.frombuffer(b, "<u4") for b in pdf["counts"]]))
        hit = (total >= least)[where]
        mine = np.zeros(len(hit), bool)
        mine[first[total >= least]] = True
        end = np.cumsum([len(k) for k in keys])
        bits_of = lambda x: [np.packbits(x[e - len(k) : e]).tobytes() for k, e in zip(keys, end)]
        return pd.DataFrame({"block": pdf["block"], "frag": pdf["frag"], "n": [len(k) for k in keys], "hits": bits_of(hit), "mine": bits_of(mine)})

    def texts(p, i) -> list[tuple]:
        langs = [p.names[k] for k in p.lang[i].tolist()]
        return [(-1, None, None, *x, None) for x in zip(p.key[i].view(np.int64).tolist(), langs, p.text(i), p.size[i].tolist())]

    def use(row, right):
        p = _Phrases(row, longest, every)
        _, where = _cut(p.key, bits)
        read = lambda c: np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(right[c], right["n"])]).astype(bool)[where]
        out = [(-1, None, None, None, x, "", 0, n) for x, n in zip(p.names, p.words.tolist())]
        if len(where):
            hit = np.flatnonzero(read("hits"))
            for f, a, b in segments(p.key[hit], parts):
                out.append((f, _planes(p.key[hit[a:b]]), p.count[hit[a:b]].view(np.uint8).reshape(-1, 8).T.tobytes(), None, None, None, None, None))
            out += texts(p, np.flatnonzero(read("mine")))
        return _frame(out)

    def look_up(wanted: np.ndarray):
        """The texts of wanted phrases, from every block that holds them."""

        def run(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    p = _Phrases(row, longest, every)
                    yield _frame(texts(p, np.flatnonzero(np.isin(p.key.view(np.int64), wanted))))

        return run

    def add(pdf):
        keys, where = np.unique(np.concatenate([_unplanes(b) for b in pdf["keys"]]), return_inverse=True)
        counts = np.concatenate([np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel() for b in pdf["counts"]])
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, counts)
        return pd.DataFrame({"key": keys.view(np.int64), "f": total})[total >= least]

    asked = blocks.mapInPandas(ask, "frag int, block long, keys binary, counts binary")
    answers = written(asked.groupBy("frag").applyInPandas(answer, "block long, frag int, n int, hits binary, mine binary"), "answers")
    own = written(with_answers(blocks, answers, use, OWN), "own-phrases")
    totals = own.where("frag >= 0").select("frag", "keys", "counts").groupBy("frag").applyInPandas(add, "key long, f long")
    text = lambda df: df.where("words > 0").select("key", "lang", "phrase", "words")
    found = written(totals.join(text(own), "key", "left"), "frequent-phrases")
    out = found.where("phrase is not null").select("lang", "phrase", "words", "f")
    lost = found.where("phrase is null").select("key", "f")
    while some := [r.key for r in lost.orderBy("key").limit(LOST).collect()]:  # two frequent phrases share a narrow hash, and another block was the first to ask
        again = text(blocks.mapInPandas(look_up(np.array(some, np.int64)), OWN)).dropDuplicates(["key"])
        out = out.unionByName(lost.join(again, "key").select("lang", "phrase", "words", "f"))
        lost = lost.where(F.col("key") > some[-1])
    sums = own.where("words = 0").groupBy("lang").agg(F.sum("f").alias("f"))
    return out.unionByName(sums.select("lang", F.lit("").alias("phrase"), F.lit(0).alias("words"), "f"))


def _joined(words: Column, begin, size) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, kept: int = KEPT, share: int = SHARE, every: int = TRIGGER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `longest` words of each language.

    score is floor(1000 * a * n / (l * r)) at the cut that makes it least (ties: the earliest cut), in decimals of 38 digits. A phrase goes if a
    longer one that holds its words has at least `share` per cent of its count. The first `kept` of each language stay, by
    falling score, falling a and the phrase's bytes; candidates of a language are cut to that many in every task first.
    """
    f = written(frequent_phrases(docs, longest, least, every), "phrases")
    n = f.where("words = 0").select("lang", F.col("f").alias("n"))
    if n.limit(LANGS + 1).count() <= LANGS:  # a language can have most of the phrases, so they are not dealt by it where its number fits every task
        n = F.broadcast(n)
    candidates = f.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # every cut looks up the counts of its two parts
    cuts = candidates.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    count = lambda side, name: f.where("words > 0").select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    counted = parts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"]).join(n, "lang")
    # 1000 * a * n and l * r each fit 38 digits below 10^17 words
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    best = counted.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("z"))
    # the largest count of a longer candidate around each phrase
    inside = candidates.where("words > 2").select("lang", F.col("a").alias("longer"), "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "longer", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("begin"))
    around = inside.groupBy("lang", _joined(F.col("w"), F.col("begin"), F.col("size")).alias("phrase")).agg(F.max("longer").alias("longer"))
    left = best.select("lang", "phrase", "z.*").join(around, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(share) * F.col("a"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank).where(F.col("rank") <= kept).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLE: dict[str, str] = {}
