"""Exact repeated byte strings by suffix arrays.

Every window of WIDTH bytes is dealt to a shard by its minimiser, the smallest hash of its GRAM-byte strings: equal
windows have equal minimisers, so they meet, and neighbouring windows with one minimiser travel as one string. Equal
strings are first pooled (only the earliest can hold a window's first occurrence, the others are covered whole). What
remains ambiguous, strings that share a minimiser without being equal or that may repeat within themselves, is sent as
text. A shard lays its strings end to end and builds their suffix array by induced sorting; common prefixes follow in
text order, and each run of suffixes that agree on WIDTH bytes keeps its earliest occurrence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import fragments, make_blocks, texts_of
from .common import _BYTE, _powers, mix, table, written

WIDTH, GRAM = 100, 40
SHARD_BYTES = 1 << 21
#: Rolling hashes take some hundred bytes of memory a byte of a block.
BYTES_PER_BLOCK = 1 << 20


# --- induced sorting -------------------------------------------------------------------------------------------------


def _doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array of a short text over any alphabet, by ranks of prefixes of doubled length."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    n, k = len(s), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] if k < n else 0
        key = rank * np.int64(n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1]))) + 1
        if rank[order[-1]] == n or k >= n:
            return order
        k *= 2


def _induce(s: np.ndarray, small: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes induced from that of the leftmost smaller ones (lms, as sorted so far).

    A bucket is scanned in waves: all entries it has so far give their predecessors at once, in order.
    """
    n, k = len(s), len(sizes)
    head = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    tail = np.cumsum(sizes)
    sa = np.full(n, -1, np.int64)
    # the leftmost smaller suffixes at the ends of their buckets
    c = s[lms]
    order = np.argsort(c, kind="stable")
    seeds, c = lms[order], c[order]
    count = np.bincount(c, minlength=k)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    # larger ones, from left to right: bucket by bucket, what was put in front and then the seeds
    fill = head.copy()

    def larger(found: np.ndarray) -> None:
        p = found[found > 0] - 1
        p = p[~small[p]]
        if not len(p):
            return
        ch = s[p]
        o = np.argsort(ch, kind="stable")
        p, ch = p[o], ch[o]
        u, at, m = np.unique(ch, return_index=True, return_counts=True)
        sa[np.repeat(fill[u], m) + np.arange(len(p)) - np.repeat(at, m)] = p
        fill[u] += m

    if not small[n - 1]:
        sa[fill[s[n - 1]]] = n - 1
        fill[s[n - 1]] += 1
    for b in range(k):
        done = head[b]
        while done < fill[b]:
            now = fill[b]
            larger(sa[done:now])
            done = now
        if count[b]:
            larger(seeds[first[b] : first[b] + count[b]])
    # smaller ones, from right to left
    front = tail.copy()

    def smaller(found: np.ndarray) -> None:
        p = found[found > 0] - 1
        p = p[small[p]]
        if not len(p):
            return
        ch = s[p]
        o = np.argsort(ch, kind="stable")
        p, ch = p[o], ch[o]
        u, at, m = np.unique(ch, return_index=True, return_counts=True)
        sa[np.repeat(front[u], m) - 1 - (np.arange(len(p)) - np.repeat(at, m))] = p
        front[u] -= m

    for b in range(k - 1, -1, -1):
        done = tail[b]
        while done > front[b]:
            now = front[b]
            smaller(sa[now:done][::-1])
            done = now
        if fill[b] > head[b]:
            smaller(sa[head[b] : fill[b]][::-1])
    return sa


def suffix_array(s: np.ndarray, alphabet: int = 256) -> np.ndarray:
    """Starts of all suffixes of s (numbers below alphabet) in order; a suffix that is another's prefix comes first."""
    n = len(s)
    if n < 64 or alphabet > 4096:
        return _doubling(s) if n else np.zeros(0, np.int64)
    s = s.astype(np.int64)
    # a suffix is smaller than the next one if it rises first; the last one is larger than its empty successor
    change = np.flatnonzero(s[1:] != s[:-1])
    nxt = np.searchsorted(change, np.arange(n))
    small = np.zeros(n, bool)
    inside = nxt < len(change)
    at = change[nxt[inside]]
    small[inside] = s[at] < s[at + 1]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(s, minlength=alphabet)
    if len(lms) < 2:
        return _induce(s, small, sizes, lms)
    sa = _induce(s, small, sizes, lms)
    # names of the substrings between leftmost smaller positions, in their sorted order
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found = sa[is_lms[sa]]
    end = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = end - lms + 1
    a, b = found[:-1], found[1:]
    same = length[a] == length[b]
    same &= (a != lms[-1]) & (b != lms[-1])
    k, todo = 0, np.flatnonzero(same)
    while len(todo):
        x, y = a[todo] + k, b[todo] + k
        equal = (s[x] == s[y]) & (small[x] == small[y])
        same[todo[~equal]] = False
        k += 1
        todo = todo[equal & (length[a[todo]] > k)]
    name = np.zeros(n, np.int64)
    name[found] = np.concatenate(([0], np.cumsum(~same)))
    reduced = name[lms]
    names = int(reduced.max()) + 1
    if names == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = suffix_array(reduced, names)
    return _induce(s, small, sizes, lms[order])


def agreeing(s: np.ndarray, sa: np.ndarray, width: int) -> np.ndarray:
    """For each position of sa but the first, whether its suffix agrees with the one before on `width` bytes.

    Common prefixes are taken in text order against each suffix's predecessor in sa: eight bytes at a time, only where all before agreed.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words = np.zeros(n, np.uint64)
    padded = np.concatenate((s.astype(np.uint8), np.zeros(8, np.uint8)))
    for k in range(8):
        words |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    todo = np.flatnonzero((before >= 0) & (np.maximum(before, np.arange(n)) + width <= n))
    for k in [*range(0, width - 7, 8), width - 8]:
        todo = todo[words[todo + k] == words[before[todo] + k]]
    permuted = np.zeros(n, bool)
    permuted[todo] = True
    return permuted[sa[1:]]


# --- windows and minimisers ------------------------------------------------------------------------------------------


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each run of w entries."""
    size = 1
    while 2 * size <= w:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


class Strings:
    """The strings of a block: runs of windows of one document that share their minimiser.

    key: minimiser; doc: index of the document; start, end: of the string in it; windows: their number; sure: False if the minimiser
    may occur twice in the string.
    """

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.raw = raw = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(size)))
        w = width - gram + 1
        if len(raw) < width:
            self.key = np.zeros(0, np.uint64)
            self.doc = self.start = self.end = self.windows = np.zeros(0, np.int64)
            self.sure = np.zeros(0, bool)
            return
        p, q = _powers(len(raw) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * p[: len(raw)], dtype=np.uint64)))
        h = mix((total[gram:] - total[:-gram]) * q[: len(raw) - gram + 1])
        low = _slide(h, w, np.minimum)  # one a window of the whole block
        doc = np.repeat(np.arange(len(texts)), size)[: len(low)]
        inside = np.arange(len(low)) + width <= self.offset[1:][doc]
        chosen = np.concatenate((np.full(w - 1, low[0]), low, np.full(w - 1, low[-1])))
        chosen = _slide(chosen, w, np.maximum)[: len(h)] == h  # is the smallest of some window
        at = np.flatnonzero(inside)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
        first = at[new]
        number = np.diff(np.append(np.flatnonzero(new), len(at)))
        self.key, self.doc, self.windows = low[first], doc[first], number
        self.start = first - self.offset[self.doc]
        self.end = self.start + number + width - 1
        # occurrences of the minimiser among the chosen positions of the string
        sel = np.flatnonzero(chosen)
        lo, hi = np.searchsorted(sel, first), np.searchsorted(sel, first + number + w - 1)
        times = np.zeros(len(first), np.int64)
        for j in range(12):
            k = np.minimum(lo + j, len(sel) - 1)
            times += (lo + j < hi) & (h[sel[k]] == self.key)
        self.sure = (times <= 1) & (hi - lo <= 12)
        self.key = mix(self.key)  # smallest hashes are small: mixed again they spread over the fragments

    def text(self, i: int) -> bytes:
        o = self.offset[self.doc[i]]
        return self.raw[o + self.start[i] : o + self.end[i]].tobytes()

    def content(self) -> np.ndarray:
        """64 bits of each string's bytes, by a rolling hash."""
        if not len(self.key):
            return np.zeros(0, np.uint64)
        p, q = _powers(len(self.raw) + 1)
        b = mix(_BYTE ^ np.uint64(0xB5297A4D3F84D5B5))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b[self.raw] * p[: len(self.raw)], dtype=np.uint64)))
        a, e = self.offset[self.doc] + self.start, self.offset[self.doc] + self.end
        return mix((total[e] - total[a]) * q[a] + (e - a).astype(np.uint64))


NOTHING, TEXT, COVERED = 0, 1, 2


def repeated_spans(blocks: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(block, row, start, windows): runs of windows of a block's row whose bytes also start earlier; rows number a block's documents."""
    bits = fragments(blocks, 1.0)

    def ask(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, texts = texts_of(row)
                s = Strings(texts, width, gram)
                content = s.content()
                frag = (s.key >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(frag, kind="stable")
                edge = np.searchsorted(frag[order], np.arange((1 << bits) + 1))
                out = []
                for f in range(1 << bits):
                    o = order[edge[f] : edge[f + 1]]
                    if len(o):
                        out.append((f, row.block, s.key[o].tobytes(), content[o].tobytes(), ids[s.doc[o]].tobytes(), s.start[o].astype(np.int32).tobytes(), s.sure[o].tobytes()))
                yield pd.DataFrame(out, columns=["frag", "block", "keys", "content", "docs", "starts", "sure"])

    def answer(pdf):
        get = lambda c, t: np.concatenate([np.frombuffer(b, t) for b in pdf[c]])
        keys, content, docs, starts, sure = get("keys", np.uint64), get("content", np.uint64), get("docs", np.int64), get("starts", np.int32), get("sure", bool)
        n = np.array([len(b) // 8 for b in pdf["keys"]])
        place = np.repeat(np.arange(len(pdf)), n)
        order = np.lexsort((place, starts, docs, content, keys))
        k, c = keys[order], content[order]
        new_key = np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        new = new_key.copy()
        new[1:] |= c[1:] != c[:-1]
        flag = np.full(len(k), COVERED, np.uint8)
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, weights=new)[group] > 1
        flag[new] = np.where(several[new] | ~sure[order][new], TEXT, NOTHING)
        out = np.empty(len(k), np.uint8)
        out[order] = flag
        end = np.cumsum(n)
        return pd.DataFrame({"block": pdf["block"], "frag": pdf["frag"], "flags": [out[e - m : e].tobytes() for e, m in zip(end, n)]})

    asked = blocks.mapInPandas(ask, "frag int, block long, keys binary, content binary, docs binary, starts binary, sure binary")
    flags = written(asked.groupBy("frag").applyInPandas(answer, "block long, frag int, flags binary"), "flags")

    def flags_of(s, right):
        frag = (s.key >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(frag, kind="stable")
        out = np.zeros(len(order), np.uint8)
        if len(order):
            out[order] = np.frombuffer(b"".join(right.sort_values("frag")["flags"]), np.uint8)
        return out

    total = blocks.agg(F.sum("raw")).first()[0] or 0  # one number
    shards = int(max(1, min(1 + total // 65536, max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD_BYTES))))

    def emit(left, right):
        cols = ["shard", "block", "row", "doc_id", "start", "windows", "text"]
        out = []
        for row in left.itertuples(index=False):
            ids, texts = texts_of(row)
            s = Strings(texts, width, gram)
            flag = flags_of(s, right)
            i = np.flatnonzero(flag == COVERED)
            out.append(pd.DataFrame({"shard": -1, "block": row.block, "row": s.doc[i], "doc_id": ids[s.doc[i]], "start": s.start[i], "windows": s.windows[i], "text": None}))
            i = np.flatnonzero(flag == TEXT)
            out.append(
                pd.DataFrame({"shard": (s.key[i] % np.uint64(shards)).astype(np.int64), "block": row.block, "row": s.doc[i], "doc_id": ids[s.doc[i]], "start": s.start[i], "windows": s.windows[i], "text": [s.text(j) for j in i]})
            )
        return pd.concat(out)[cols]

    strings = written(
        blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInPandas(emit, "shard long, block long, row long, doc_id long, start long, windows long, text binary"), "strings"
    )

    def solve(pdf):
        pdf = pdf.sort_values(["doc_id", "block", "row", "start"], kind="stable")
        texts = list(pdf["text"])
        s = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        end = np.cumsum(size)
        which = np.repeat(np.arange(len(texts)), size)
        sa = suffix_array(s)
        same = np.concatenate(([False], agreeing(s, sa, width)))
        # strings lie in the order of their documents and starts; positions follow
        first = pdf["start"].to_numpy()[which] + np.arange(len(s)) - (end - size)[which]
        docs = np.unique(np.stack([pdf["doc_id"], pdf["block"], pdf["row"]], 1), axis=0, return_inverse=True)[1].ravel()[which]
        rank = docs * np.int64(first.max() + 2) + first
        whole = np.arange(len(s)) + width <= end[which]  # windows that end inside their string
        rank = np.where(whole, rank, np.iinfo(np.int64).max)
        group = np.cumsum(~same) - 1
        least = np.minimum.reduceat(rank[sa], np.flatnonzero(~same))
        later = np.zeros(len(s), bool)
        later[sa] = rank[sa] > least[group]
        later &= whole
        # runs of marked windows within a string
        at = np.flatnonzero(later)
        if not len(at):
            return pd.DataFrame({"block": [], "row": [], "start": [], "windows": []}).astype("int64")
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (which[at[1:]] != which[at[:-1]])
        b = at[new]
        number = np.diff(np.append(np.flatnonzero(new), len(at)))
        w = which[b]
        return pd.DataFrame({"block": pdf["block"].to_numpy()[w], "row": pdf["row"].to_numpy()[w], "start": first[b], "windows": number})

    spans = strings.where("shard >= 0").groupBy("shard").applyInPandas(solve, "block long, row long, start long, windows long")
    return spans.union(strings.where("shard < 0").select("block", "row", "start", "windows"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of docs with a doc_id: bytes covered by an earlier started string of `width` bytes are removed.

    Earlier is a smaller doc_id, among rows that repeat a doc_id the one read first, within a document the earlier start. Null and
    empty texts and texts shorter than `width` lose nothing. Rows without a doc_id are left out; other columns are not read.
    """
    blocks = make_blocks(docs, BYTES_PER_BLOCK)
    spans = repeated_spans(blocks, width, gram)

    def use(left, right):
        out = []
        for row in left.itertuples(index=False):
            ids, texts = texts_of(row)
            raw = np.frombuffer(b"".join(texts), np.uint8)
            size = np.array([len(t) for t in texts], np.int64)
            offset = np.concatenate(([0], np.cumsum(size)))
            edge = np.zeros(len(raw) + 1, np.int64)
            if len(right):
                r, a, n = (right[c].to_numpy(np.int64) for c in ("row", "start", "windows"))
                np.add.at(edge, offset[r] + a, 1)
                np.add.at(edge, offset[r] + a + n + width - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            runs = gone.copy()
            runs[1:] &= ~gone[:-1]
            begins = offset[:-1][size > 0]
            runs[begins] = gone[begins]
            count = lambda m: np.concatenate(([0], np.cumsum(m)))[offset]
            kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(offset[:-1], offset[1:])]
            out.append(pd.DataFrame({"doc_id": ids, "n_bytes": size, "n_removed": np.diff(count(gone)), "n_spans": np.diff(count(runs)), "kept": kept}))
        return pd.concat(out)

    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(use, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_suffix_array": op9_suffix_array}
ORACLE: dict[str, str] = {}
