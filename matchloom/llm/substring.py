"""Near-duplicate passages by compact windows.

A text is a sequence of hashed word n-grams. Under one hash function the Cartesian tree of the sequence groups its
subsequences by their smallest hash: a node (l, c, r) stands for all subsequences within [l, r] that hold c, and only
nodes at least a passage wide matter, about two for each passage length of text. Windows of different documents with
equal smallest hash are joined within fragments of the hash range: each with the earliest, with the last one before it
and with the earliest of equal content, so a passage that thousands of documents share costs each of them three rows.
N-grams of many documents (licence lines, phrases) come last in every function's order: a window has such a
key only if it consists of them, so phrases shorter than a passage bring nothing together.
Where the aligned intervals of at least ENOUGH hash functions overlap for a pair of documents, or windows are equal, the
passages are fetched and compared n-gram by n-gram. Windows that the passages found so far don't cover, up to the share by
which near duplicates may differ, then meet all earlier windows of their key, one for each content.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import _planes, _unplanes, fragments, make_blocks, segments, texts_of
from .common import Words, _powers, as_bytes, mix, shingles, table, written

N, PASSAGE_WORDS, HASHES, ENOUGH = 5, 50, 5, 2
NUMERATOR, DENOMINATOR = 80, 100
#: Range minima take some hundred bytes of memory a word of a block.
BYTES_PER_BLOCK = 1 << 20
#: n-grams of fewer than OFTEN places of the corpus keep their order; of those of m places a share of (OFTEN / m)^2 does, the others come last.
OFTEN = 18
#: Places are counted under so many leading bits of the n-gram's mixed hash that there are a SLOTS slots for each byte of text (about six
#: times as many for each n-gram); a task sends the counts of about PLACES places at once.
SLOTS, PLACES = 2, 1 << 21
#: The table of frequent n-grams has one bit for each value of the leading bits of their hashes: a bit for 256 bytes of text, at most
#: 2^MOST_BITS (128 MB). n-grams that share a bit come last together.
MOST_BITS = 30
#: n-grams by which two windows' alignments may differ within one passage.
DRIFT = 24


class Grams:
    """The n-grams of a block's rows, and where they lie in the texts; of the rows in `only` alone, if that is given."""

    def __init__(self, row, n: int, only=None):
        self.ids, texts = texts_of(row)
        if only is not None:
            only = {int(x) for x in only}
            texts = [t if i in only else b"" for i, t in enumerate(texts)]
        self.words = w = Words(texts)
        hashes, text, at = shingles(w, n)
        long = w.count[text] >= n if len(text) else np.zeros(0, bool)
        self.hash, self.row, self.at = hashes[long], text[long], at[long]
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))  # of each row's n-grams

    def bytes_at(self, row: int, first: int, last: int, n: int) -> tuple[int, int]:
        """(begin, end) in the row's text of the words of n-grams first..last."""
        w, a = self.words, self.words.first[row]
        return int(w.start[a + first] - w.offset[row]), int(w.end[a + last + n - 1] - w.offset[row])


_ROOM = [np.empty(0, np.uint64)]
#: Larger tables of minima are not kept for the next block.
ROOM_NUMBERS = 1 << 23


def _room(shape: tuple[int, int]) -> np.ndarray:
    """Numbers to write to, kept from call to call, as new memory costs more than the minima that go there."""
    size = shape[0] * shape[1]
    if size > ROOM_NUMBERS:
        return np.empty(shape, np.uint64)
    if len(_ROOM[0]) < size:
        _ROOM[0] = np.empty(size, np.uint64)
    return _ROOM[0][:size].reshape(shape)


def compact_windows(hash_: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the Cartesian-tree nodes at least `width` wide, for each row's part of the sequence; ties go to the right one."""
    if not len(hash_):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate(([True], row[1:] != row[:-1]))
    place = np.arange(len(hash_)) + np.cumsum(new)
    g = np.zeros(place[-1] + 2, np.uint64)  # a zero before, between and after rows
    g[place] = np.maximum(hash_, np.uint64(1))
    longest = int(np.diff(np.append(np.flatnonzero(new), len(hash_))).max())
    if longest < width:
        return (np.zeros(0, np.int64),) * 3
    levels, room = [g], _room((longest.bit_length() - 1, len(g)))
    for k, m in enumerate(room):
        half = 1 << k
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:], out=m[: len(levels[-1]) - half]))
    k = width.bit_length() - 1
    low = np.minimum(levels[k][: len(g) - width + 1], levels[k][width - (1 << k) :][: len(g) - width + 1])
    # a node is wide enough exactly if it is the smallest of some run of `width`
    top = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    size = 1
    while 2 * size <= width:
        top = np.maximum(top[:-size], top[size:])
        size *= 2
    if width > size:
        top = np.maximum(top[: len(top) - (width - size)], top[width - size :])
    c = np.flatnonzero((top[: len(g)] == g) & (g > 0))
    l, r, v = c.copy(), c.copy(), g[c]
    for k in range(len(levels) - 1, -1, -1):
        m, step = levels[k], 1 << k
        to = l - step
        ok = (to >= 0) & (m[np.maximum(to, 0)] > v)
        l[ok] -= step
        to = r + 1
        ok = (to < len(m)) & (m[np.minimum(to, len(m) - 1)] >= v)
        r[ok] += step
    wide = r - l + 1 >= width  # of equal hashes only one has the whole run
    c, l, r = c[wide], l[wide], r[wide]
    back = np.cumsum(g == 0)
    return c - back[c], l - back[c], r - back[c]


def _enough_places(slots: np.ndarray) -> np.ndarray:
    """From how many places on the n-grams of each slot come last: OFTEN / sqrt(u), u a hash of the slot from 0 to 1."""
    u = (mix(slots ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)).astype(float) + 1
    return OFTEN / np.sqrt(u / (1 << 53))


def frequent_grams(blocks: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(table of bits, number of leading bits of an n-gram's mixed hash that index it): the n-grams of many places.

    Every place of the corpus is counted, in the fragments of the n-grams' hashes, and a fragment sends its stretch of the table. Hashes are
    cut to what tells n-grams of a corpus of this size apart, so one that shares its slot or bit with others can come last too. The order
    of n-grams decides how many windows meet, not which passages are equal. It also decides what can be found: where the intact runs of a
    near copy are shorter than a window of frequent n-grams, those of its passage's n-grams that keep their order have to find it. Their
    share falls with the square of the places, as the pairs grow with it: a phrase costs about as many whatever the number of its places.
    """
    total = int(blocks.agg(F.sum("raw")).first()[0] or 0)  # one number
    bits = fragments(blocks, 1.4)
    size = max(bits + 3, min(MOST_BITS, max(16, total.bit_length() - 8)))
    slot = min(40, max(size, 24, (SLOTS * total).bit_length()))

    def ask(batches):
        z = zstandard.ZstdCompressor(1)

        def counted(parts):
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            counts = np.minimum(counts, (1 << 24) - 1).astype(np.uint32)
            out = [(f, b - a, z.compress(_planes(keys[a:b])), z.compress(_by_plane(counts[a:b]))) for f, a, b in segments(keys << np.uint64(64 - slot), bits)]
            return pd.DataFrame(out, columns=["frag", "n", "keys", "counts"])

        parts, n_places = [], 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                parts.append(mix(Grams(row, n).hash) >> np.uint64(64 - slot))
                n_places += len(parts[-1])
                if n_places >= PLACES:
                    yield counted(parts)
                    parts, n_places = [], 0
        if parts:
            yield counted(parts)

    def answer(key, pdf):
        z, found = zstandard.ZstdDecompressor(), []
        for n_, keys, counts in zip(pdf["n"], pdf["keys"], pdf["counts"]):
            keys = _unplanes(z.decompress(keys, max_output_size=8 * n_))
            found.append(keys << np.uint64(24) | _from_planes(z.decompress(counts, max_output_size=4 * n_), np.uint32).astype(np.uint64))
        found = np.sort(np.concatenate(found))
        keys, counts = found >> np.uint64(24), found & np.uint64((1 << 24) - 1)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        hot = keys[counts >= _enough_places(keys)] >> np.uint64(slot - size)
        part = np.zeros(1 << (size - bits), bool)
        part[hot.astype(np.int64) - (int(key[0]) << (size - bits))] = True
        return pd.DataFrame({"frag": [key[0]], "part": [np.packbits(part).tobytes()]})

    out = np.zeros(1 << (size - 3), np.uint8)
    step = 1 << (size - bits - 3)
    asked = blocks.mapInPandas(ask, "frag int, n int, keys binary, counts binary")
    for r in asked.groupBy("frag").applyInPandas(answer, "frag int, part binary").toLocalIterator():
        out[r.frag * step : (r.frag + 1) * step] = np.frombuffer(r.part, np.uint8)
    return out, size


def _is_frequent(g: Grams, table_: tuple[np.ndarray, int]) -> np.ndarray:
    bit = (mix(g.hash) >> np.uint64(64 - table_[1])).astype(np.int64)
    return (table_[0][bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1


def _windows(g: Grams, width: int, hashes: int, frequent: tuple[np.ndarray, int]):
    """Sorted by key: (key, row, c, l, r, function), with c, l, r counted within the row.

    In a run of one n-gram over and over each place is smallest; the first and the last one stand for it.
    """
    as_before = np.zeros(len(g.hash) + 1, bool)
    as_before[1:-1] = (g.hash[1:] == g.hash[:-1]) & (g.row[1:] == g.row[:-1])
    parts, last = [], _is_frequent(g, frequent).astype(np.uint64) << np.uint64(63)
    for f in range(hashes):
        value = mix(g.hash ^ np.uint64((0x9E3779B97F4A7C15 * (f + 1)) % (1 << 64))) >> np.uint64(1) | last
        c, l, r = compact_windows(value, g.row, width)
        edge = ~(as_before[c] & as_before[c + 1])
        c, l, r = c[edge], l[edge], r[edge]
        row = g.row[c]
        base = g.first[row]
        # smallest hashes are small: mixed again they spread over the fragments
        parts.append((mix(value[c]), row, c - base, l - base, r - base, np.full(len(c), f)))
    key, row, c, l, r, f = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    return key[order], row[order], c[order], l[order], r[order], f[order]


def _by_plane(a: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, as most leading bytes are zero and compress."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _from_planes(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _contents(g: Grams, row: np.ndarray, c: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A hash of each window's n-grams and of where its smallest one lies."""
    p, q = _powers(len(g.hash) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g.hash) * p[:-1], dtype=np.uint64)))
    a, b = g.first[row] + l, g.first[row] + r + 1
    return mix(mix((total[b] - total[a]) * q[a]) + (((c - l) << 32) + (r - c)).astype(np.uint64))


ROW_BITS, FUNCTION_BITS = 22, 24
#: A window that may have more partners than _answer names; first says whether it is the earliest of its content.
AGAIN = np.dtype([("key", "<i8"), ("doc", "<i8"), ("number", "<i8"), ("c", "<i4"), ("l", "<i4"), ("r", "<i4"), ("f", "<i4"), ("first", "<i4")])


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each window its earliest partner, the last one before it and the earliest of equal content, in other documents.

    again has the windows of keys with more contents and documents than these three can be, one for each content and document that has it first.
    """
    cols = ["block", "frag", "rows", "own", "partner", "at", "same", "again"]
    get = lambda c, t: np.concatenate([_from_planes(b, t) for b in pdf[c]])
    keys = [_unplanes(b) for b in pdf["keys"]]
    n = np.array([len(k) for k in keys])
    key, docs, rows = np.concatenate(keys), get("docs", np.int64), get("rows", np.int32)
    c = get("c", np.int32)
    at = np.stack([c, c - get("before", np.int32), c + get("after", np.int32)], 1)
    content, function = get("contents", np.uint64), rows >> FUNCTION_BITS
    seg = np.repeat(np.arange(len(pdf)), n)
    number = (pdf["block"].to_numpy(np.int64)[seg] << ROW_BITS) + (rows & ((1 << FUNCTION_BITS) - 1))
    order = np.lexsort((at[:, 0], number, docs, key))
    k, d, what = key[order], number[order], content[order]
    i = np.arange(len(k))
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new_doc = new_key | np.concatenate(([True], d[1:] != d[:-1]))
    lead = np.maximum.accumulate(np.where(new_key, i, 0))
    prev = np.maximum.accumulate(np.where(new_doc, i, 0)) - 1
    has = prev >= lead
    # the earliest window of each content
    by = np.lexsort((i, what, k))
    head = np.concatenate(([True], (k[by][1:] != k[by][:-1]) | (what[by][1:] != what[by][:-1])))
    origin = np.empty(len(k), np.int64)
    origin[by] = by[np.maximum.accumulate(np.where(head, i, 0))]
    same = np.flatnonzero(d[origin] != d)
    first = np.flatnonzero(has & (what[lead] != what))
    second = np.flatnonzero(has & (prev != lead) & (what[prev] != what))
    own = order[np.concatenate((same, first, second))]
    other = order[np.concatenate((origin[same], lead[first], prev[second]))]
    equal = np.repeat([True, False], [len(same), len(first) + len(second)])
    by = np.argsort(seg[own], kind="stable")
    own, other, equal = own[by], other[by], equal[by]
    edge = np.searchsorted(seg[own], np.arange(len(pdf) + 1))
    group = np.cumsum(new_key) - 1
    contents = np.bincount(group[origin == i], minlength=group[-1] + 1 if len(k) else 0)
    documents = np.bincount(group[new_doc], minlength=len(contents))
    more = np.flatnonzero((d[origin] == d) & (contents[group] > 2) & (documents[group] > 2))
    again = np.zeros(len(more), AGAIN)
    x = order[more]
    again["key"], again["doc"], again["number"], again["f"], again["first"] = k[more].view(np.int64), docs[x], d[more], function[x], origin[more] == more
    again["c"], again["l"], again["r"] = at[x].T
    cut = np.argsort(seg[x], kind="stable")
    last = np.searchsorted(seg[x][cut], np.arange(len(pdf) + 1))
    out = []
    for j, (block, frag) in enumerate(zip(pdf["block"], pdf["frag"])):
        o, p, e = own[edge[j] : edge[j + 1]], other[edge[j] : edge[j + 1]], equal[edge[j] : edge[j + 1]]
        rest = again[cut[last[j] : last[j + 1]]].tobytes()
        out.append((block, frag, _by_plane(rows[o]), _by_plane(at[o].T.ravel()), _by_plane(number[p]), _by_plane(at[p].T.ravel()), e.tobytes(), rest))
    return pd.DataFrame(out, columns=cols)


def _least(width: int, num: int, den: int) -> int:
    """n-grams that near duplicates of this width share at least, and so the aligned parts of their windows hold."""
    return -(-width * num // den)


def _stretches(row, c, l, r, f, partner, at, same, least: int, hashes: int, enough: int) -> list[tuple]:
    """(row, a0, a1, partner, b0, b1): stretches where windows of `enough` hash functions agree on an alignment, or equal windows."""
    if not len(row):
        return []
    left, after = np.minimum(c - l, at[:, 0] - at[:, 1]), np.minimum(r - c, at[:, 2] - at[:, 0])
    keep = left + after + 1 >= least
    # one hash function alone is mostly a phrase that occurs elsewhere
    pair = np.unique(np.stack([row, partner], 1), axis=0, return_inverse=True)[1].ravel()
    seen = np.unique(pair[keep] * np.int64(hashes) + f[keep]) // hashes
    keep &= (np.bincount(seen, minlength=pair.max() + 1)[pair] >= enough) | same
    k = np.flatnonzero(keep)
    k = k[np.lexsort((c[k] - left[k], pair[k]))]
    out = []
    a0s, a1s, diag = (c - left)[k].tolist(), (c + after)[k].tolist(), (c - at[:, 0])[k].tolist()
    rows, pairs, partners, fs, equal = row[k].tolist(), pair[k].tolist(), partner[k].tolist(), f[k].tolist(), same[k].tolist()
    open_: list[list] = []  # stretches of the current pair
    last = None

    def flush():
        for a0, a1, b0, b1, _, funcs, rw, pt, eq in open_:
            if eq or len(funcs) >= enough:
                out.append((rw, a0, a1, pt, b0, b1))

    for a0, a1, d, rw, p, pt, fn, eq in zip(a0s, a1s, diag, rows, pairs, partners, fs, equal):
        if p != last:
            flush()
            open_, last = [], p
        for s in open_:
            if a0 <= s[1] and abs(d - s[4]) <= DRIFT:
                s[1], s[2], s[3], s[4] = max(s[1], a1), min(s[2], a0 - d), max(s[3], a1 - d), d
                s[5].add(fn)
                s[8] |= eq
                break
        else:
            open_.append([a0, a1, a0 - d, a1 - d, d, {fn}, rw, pt, eq])
    flush()
    return out


def _candidates(answers: pd.DataFrame, least: int, hashes: int, enough: int) -> list[tuple]:
    """_stretches of a block's windows with the partners that _answer names; both come from the answers, so no text is read."""
    answers = answers.sort_values("frag")
    get = lambda c, t: np.concatenate([_from_planes(x, t) for x in answers[c]])
    places = lambda c: np.concatenate([_from_planes(x, np.int32).reshape(3, -1) for x in answers[c]], axis=1).astype(np.int64)
    rows, same = get("rows", np.int32).astype(np.int64), np.concatenate([np.frombuffer(x, bool) for x in answers["same"]])
    row, f = rows & ((1 << FUNCTION_BITS) - 1), rows >> FUNCTION_BITS
    return _stretches(row, *places("own"), f, get("partner", np.int64), places("at").T, same, least, hashes, enough)


def _open(batches, rest: int):
    """Of windows with the passages found in their rows (spans of n-grams), those of which more than `rest` in a row lie in no passage."""
    for pdf in batches:
        keep = []
        for l, r, spans in zip(pdf["l"], pdf["r"], pdf["spans"]):
            free = 0
            for a, b in sorted((x["g0"], x["g1"]) for x in spans) if spans is not None else ():
                free = max(free, min(a, r + 1) - l)
                l = max(l, b + 1)
            keep.append(max(free, r + 1 - l) > rest)
        yield pdf[keep].drop(columns="spans")


def _dense(hit: np.ndarray, width: int, cost: int) -> list[tuple[int, int]]:
    """Stretches [a, b) at least `width` long where hits outweigh misses by `cost` to one, the longest first."""
    out, todo = [], [(0, len(hit))]
    while todo:
        a, b = todo.pop()
        if b - a < width:
            continue
        s = np.concatenate(([0], np.cumsum(np.where(hit[a:b], 1, -cost))))
        # for each end the first start that makes the sum at least 0
        start = np.searchsorted(-np.minimum.accumulate(s), -s)
        e = int((np.arange(len(s)) - start).argmax())
        i = int(start[e])
        if e - i < width:
            continue
        # what hangs on at either side at a loss is cut off, unless it is needed for the width
        middle, whole = (i + e) // 2, i + np.flatnonzero(hit[a + i : a + e])
        e = middle + int(s[middle : e + 1].argmax())
        i = i + int(s[i : middle + 1].argmin())
        if e - i < width:
            i, e = int(whole[0]), int(whole[-1]) + 1
        if e - i >= width:
            out.append((a + i, a + e))
        todo += [(a, a + i), (a + e, b)] if e > i else []
    return out


def _among(numbers: np.ndarray, size: int) -> np.ndarray:
    """For each number under size whether it is among numbers."""
    out = np.zeros(size, bool)
    out[numbers] = True
    return out


def _their(piece: np.ndarray, theirs: np.ndarray, size: int, num: int, den: int) -> tuple[int, int, float]:
    """(begin, end, J): the stretch [begin, end) of theirs most like the piece, among those about as long, shorter or longer; n-grams are numbers under size."""
    p = _among(piece, size)
    where, n = np.flatnonzero(p[theirs]), np.count_nonzero(p)
    best, tried = (0, 0, 0.0), set()
    for limit in (len(piece), len(piece) + DRIFT, -(-len(piece) * num // den), len(piece) * den // num) if len(where) else ():
        if best[2] == 1:
            break
        ahead = np.searchsorted(where, where + limit)
        k = int((ahead - np.arange(len(where))).argmax())
        begin, end = int(where[k]), int(where[ahead[k] - 1]) + 1
        if (begin, end) in tried:
            continue
        tried.add((begin, end))
        q = _among(theirs[begin:end], size)
        both = np.count_nonzero(p & q)
        best = max(best, (begin, end, both / (n + np.count_nonzero(q) - both)), key=lambda x: (x[2], x[1] - x[0]))
    return best


def _gaps(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of hits in mine, steps between them): a step is the longer one of both sides."""
    order = np.argsort(theirs, kind="stable")
    low, high = np.searchsorted(theirs[order], mine, "left"), np.searchsorted(theirs[order], mine, "right")
    at = np.flatnonzero(high > low)
    place = order[low[at]]
    # of repeated n-grams the place that goes best with the last one that occurs once
    once = np.flatnonzero(high[at] - low[at] == 1)
    for k in np.flatnonzero(high[at] - low[at] > 1) if len(once) else ():
        near = once[max(0, int(np.searchsorted(once, k)) - 1)]
        some = order[low[at[k]] : high[at[k]]]
        place[k] = some[np.abs(some - (place[near] + at[k] - at[near])).argmin()]
    return at, np.maximum(np.diff(at), np.abs(np.diff(place)))


def matches(mine: np.ndarray, theirs: np.ndarray, width: int, num: int, den: int) -> list[tuple[int, int, int, int, float]]:
    """(i, e, begin, end, J): stretches mine[i:e] and theirs[begin:end], at least `width` long, with J >= num/den.

    A dense stretch that fails as a whole is split at its worst gap on either side, and so are its parts, down to the width.
    """
    if len(mine) >= width and np.array_equal(mine, theirs):
        return [(0, len(mine), 0, len(mine), 1.0)]
    # small numbers for n-grams: what is among others is then looked up, not searched
    every, number = np.unique(np.concatenate((mine, theirs)), return_inverse=True)
    mine, theirs, size = number[: len(mine)], number[len(mine) :], len(every)
    out, hit = [], _among(theirs, size)[mine]
    # hits that one miss outweighs: J >= num/den means hits >= num/den of the own side, with equal lengths 2 num / (num + den) of it
    bounds = (num // (den - num), (2 * num) // (den - num)) if den > num else (1 << 20,)
    for cost in bounds:
        failed = False
        todo = _dense(hit, width, cost)
        while todo:
            i, e = todo.pop()
            begin, end, j = _their(mine[i:e], theirs, size, num, den)
            if j * den >= num - 1e-9 and end - begin >= width:
                out.append((i, e, begin, end, j))
                continue
            failed = True
            at, step = _gaps(mine[i:e], theirs)
            if not len(step):
                continue
            cut = np.flatnonzero(step == step.max()) if step.max() > 1 else np.array([len(step) // 2])
            edge = [(a, b) for a, b in zip([0, *(cut + 1)], [*cut, len(at) - 1])]
            todo += [(i + int(at[a]), i + int(at[b]) + 1) for a, b in edge if at[b] - at[a] + 1 >= width]
        if not failed:
            break
    return list(dict.fromkeys(out))


SPAN_SCHEMA = "doc_id long, start_word long, n_words long, begin long, end long, partner_id long, partner_start_word long, jaccard double"


def near_duplicate_passages(
    docs: DataFrame, n: int = N, words: int = PASSAGE_WORDS, hashes: int = HASHES, enough: int = ENOUGH, num: int = NUMERATOR, den: int = DENOMINATOR
) -> DataFrame:
    """(doc_id, start_word, n_words, begin, end, partner_id, partner_start_word, jaccard): passages of at least `words` words that nearly equal one of an earlier document.

    begin and end are bytes of the text's UTF-8. Passages are near duplicates if their n-gram sets have a Jaccard similarity of num/den or
    more, verified on the whole passages. Earlier is the smaller doc_id, among rows that repeat a doc_id the one read first; repeats within
    a document don't count. Null, empty and shorter texts have no passage. Rows without a doc_id are left out; other columns are not read.
    """
    width = max(1, words - n + 1)
    hang = width * (den - num) // num  # n-grams that one side's part of a passage may have more on either side of an aligned window
    least = _least(width, num, den)
    blocks = make_blocks(docs, BYTES_PER_BLOCK)
    bits = fragments(blocks, 0.4 * hashes)
    sent = blocks.sparkSession.sparkContext.broadcast(frequent_grams(blocks, n))

    def ask(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                g = Grams(row, n)
                key, r_, c, l, r, fn = _windows(g, width, hashes, sent.value)
                what = _contents(g, r_, c, l, r)
                columns = [g.ids[r_], *(x.astype(np.int32) for x in (r_ + (fn << FUNCTION_BITS), c, c - l, r - c)), what]
                out = [(f, row.block, _planes(key[a:b]), *(_by_plane(x[a:b]) for x in columns)) for f, a, b in segments(key, bits)]
                yield pd.DataFrame(out, columns=["frag", "block", "keys", "docs", "rows", "c", "before", "after", "contents"])

    asked = blocks.mapInPandas(ask, "frag int, block long, keys binary, docs binary, rows binary, c binary, before binary, after binary, contents binary")
    answers = written(asked.groupBy("frag").applyInPandas(_answer, "block long, frag int, rows binary, own binary, partner binary, at binary, same binary, again binary"), "answers")

    def wanting(out):
        out = pd.DataFrame(out, columns=["block", "a_row", "a0", "a1", "partner", "b0", "b1"]).astype("int64")
        out = out.assign(a0=np.maximum(out["a0"] - hang, 0), a1=out["a1"] + hang, b0=np.maximum(out["b0"] - hang, 0), b1=out["b1"] + hang)
        return out.assign(b_block=out["partner"] // (1 << ROW_BITS), b_row=out["partner"] % (1 << ROW_BITS)).drop(columns="partner")

    def request(key, pdf):
        return wanting([(key[0], *x) for x in _candidates(pdf, least, hashes, enough)])

    schema = "block long, a_row long, a0 long, a1 long, b0 long, b1 long, b_block long, b_row long"
    asks = written(answers.drop("again").groupBy("block").applyInPandas(request, schema), "passages")

    def fetch(left, right):
        out = []
        for row in left.itertuples(index=False) if len(right) else ():
            g = Grams(row, n, right["b_row"])
            for x in right.itertuples(index=False):
                a = g.first[x.b_row]
                part = g.hash[a + x.b0 : min(a + x.b1 + 1, g.first[x.b_row + 1])]
                out.append((x.b_block, x.b_row, x.b0, x.b1, int(g.ids[x.b_row]), part.tobytes()))
        return pd.DataFrame(out, columns=["b_block", "b_row", "b0", "b1", "partner_id", "grams"])

    def verify(left, right):
        out = []
        for row in left.itertuples(index=False) if len(right) else ():
            g = Grams(row, n, right["a_row"])
            for x in right.itertuples(index=False):
                a, theirs = g.first[x.a_row], np.frombuffer(x.grams, np.uint64)
                mine = g.hash[a + x.a0 : min(a + x.a1 + 1, g.first[x.a_row + 1])]
                for i, e, their, _, j in matches(mine, theirs, width, num, den):
                    begin, end = g.bytes_at(x.a_row, x.a0 + i, x.a0 + e - 1, n)
                    out.append(((x.block << ROW_BITS) + x.a_row, x.a0 + i, x.a0 + e - 1, int(g.ids[x.a_row]), x.a0 + i, e - i + n - 1, begin, end, x.partner_id, x.b0 + their, j))
        return pd.DataFrame(out, columns=["number", "g0", "g1", "doc_id", "start_word", "n_words", "begin", "end", "partner_id", "partner_start_word", "jaccard"])

    def verified(asks):
        of_b = ["b_block", "b_row", "b0", "b1"]
        wanted = asks.select(*of_b).distinct()
        fetched = blocks.groupBy("block").cogroup(wanted.groupBy("b_block")).applyInPandas(fetch, "b_block long, b_row long, b0 long, b1 long, partner_id long, grams binary")
        both = asks.join(fetched, of_b)
        return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(verify, f"number long, g0 long, g1 long, {SPAN_SCHEMA}")

    found = written(verified(asks), "found")

    def unpack(batches):
        for pdf in batches:
            yield pd.DataFrame(np.frombuffer(b"".join(pdf["again"]), AGAIN))

    window = "key long, doc long, number long, c int, l int, r int, f int, first int"
    again = answers.select("again").where("octet_length(again) > 0").mapInPandas(unpack, window)
    covered = found.groupBy("number").agg(F.collect_set(F.struct("g0", "g1")).alias("spans"))
    late = again.join(covered, "number", "left").mapInPandas(lambda batches: _open(batches, width - least), window)
    early = again.where("first = 1").select("key", *(F.col(x).alias(f"{x}_b") for x in ("doc", "number", "c", "l", "r")))
    before = F.expr("doc_b < doc or doc_b = doc and number_b < number")
    aligned = F.expr("least(c - l, c_b - l_b) + least(r - c, r_b - c_b) + 1") >= least
    met = late.drop("first").join(early, "key").where(before & aligned)
    pairs = met.groupBy("number", "number_b").agg(F.collect_list(F.struct("c", "l", "r", "f", "c_b", "l_b", "r_b")).alias("windows"), F.count_distinct("f").alias("functions")).where(F.col("functions") >= enough)

    def request_rest(batches):
        for pdf in batches:
            out = []
            for x in pdf.itertuples(index=False):
                w = np.array([tuple(y.values()) if isinstance(y, dict) else tuple(y) for y in x.windows], np.int64)
                row, partner = np.full(len(w), x.number & ((1 << ROW_BITS) - 1)), np.full(len(w), x.number_b)
                got = _stretches(row, *w[:, :4].T, partner, w[:, 4:], np.zeros(len(w), bool), least, hashes, enough)
                out += [(x.number >> ROW_BITS, *y) for y in got]
            yield wanting(out)

    rest = written(pairs.mapInPandas(request_rest, schema), "passages")
    return found.union(verified(rest)).drop("number", "g0", "g1").distinct()


def remove_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the bytes of spans(doc_id, begin, end) cut out of text; all its columns stay, and n_chars, if there, counts anew.

    Documents without a span, and rows without a doc_id, stay as they are. Spans may overlap or repeat.
    """
    cuts = spans.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("begin", "end")).alias("_cuts"))
    joined = docs.join(cuts, docs["doc_id"] == cuts["_doc"], "left").drop("_doc")

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(text, cuts):
            if c is None or t is None:
                out.append(t)
                continue
            raw, gone = as_bytes([t])[0], 0
            parts = []
            for b, e in sorted((x["begin"], x["end"]) for x in c):
                if b > gone:
                    parts.append(raw[gone:b])
                gone = max(gone, e)
            out.append(b"".join([*parts, raw[gone:]]).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    out = joined.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(cut("text", "_cuts"))).drop("_cuts")
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op7_compact_windows": op7_compact_windows}
ORACLE: dict[str, str] = {}
