"""The operators against brute force on small inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchloom.llm import blocks, bpe, components, jaccard, lm_score, packing, quality, registry, substring, suffix_array, toxicity

from ..compare import rows
from ..conftest import DATA


@pytest.fixture(scope="module")
def texts(spark):
    """A few hundred documents of the test table with planted copies, near copies and passages."""
    rnd = random.Random(4)
    out = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    base = next(t.split() for t in out.values() if len(t.split()) > 250)
    for k in range(25):
        w = list(base[:200])
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
        out[10**6 + k] = " ".join(w)
    for k in range(10):
        pad = [f"p{rnd.randrange(10**7)}" for _ in range(60)]
        out[2 * 10**6 + k] = " ".join(pad[:30] + base[60:130] + pad[30:])
    for k, odd in enumerate(("", "one", "ab" * 150, "ab" * 60 + "a", "<|endoftext|> İ don't  \n\n x")):
        out[3 * 10**6 + k] = odd
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1 << 16)


def test_bpe_equals_tokenizer(docs, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    want = {d: tok.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    for size in (1 << 22, 1 << 15):
        for r in bpe.decode(bpe.encode(docs, block_bytes=size)).toPandas().itertuples():
            assert list(r.ids) == want[r.doc_id] and r.text == tok.decode(want[r.doc_id], skip_special_tokens=False)


def test_bpe_words_can_be_encoded_apart():
    tok, rnd = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER)), random.Random(5)
    pool = [*"   \n\t.,!'sS09aé", "\x1c", "\x85", "\u00a0", "\u3000", "don't", "<|endoftext|>", "\U0001f642", "e\u0301", "ab", "\ud7a3"]
    for _ in range(4000):
        text = "".join(rnd.choices(pool, k=rnd.randint(0, 14)))
        apart = [i for w in bpe.split_words(text) for i in tok.encode(w, add_special_tokens=False).ids]
        assert "".join(bpe.split_words(text)) == text and apart == tok.encode(text, add_special_tokens=False).ids


def test_bpe_query_digests(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    tok.no_truncation()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.op1_bpe_round_trip(spark, DATA).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing_lays_every_id_once(docs, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    out = packing.pack(docs, shard_tokens=20_000).toPandas()
    for d, g in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*tok.encode(texts[d], add_special_tokens=False).ids, packing.END], "<u4")
        assert b"".join(g["ids"]) == ids.tobytes() and (g["doc_tokens"] == len(ids)).all()
        assert [zlib.crc32(x) for x in g["ids"]] == list(g["ids_crc32"])
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096


def test_packing_ids_of_odd_characters():
    """Control characters, case pairs, marks that compose, characters newer than Python's tables, and random strings of all of them."""
    path, rnd = public_tokenizers.path(packing.TOKENIZER), random.Random(1)
    tok, ours = Tokenizer.from_file(path), packing._Tokens(path)
    cases = [f"a{chr(c)}B {chr(c)}x" for c in [*range(0x600), *range(0x1E00, 0x2100), 0x1C89, 0xA7DC, 0x10D50, 0x1F642]]
    cases += ["\u0391\u03a3 \u03a3\u0391\u03a3.", "\u00e9t\u0301 \u0301x", "x\u00a0y\u3000z ... a.. b. it's. <|endoftext|>."]
    pool = [*map(chr, range(0x250)), *map(chr, range(0x370, 0x400)), *"\u0301\u1100\u1161\u11a8\uac00\ua7dc\U00010d50\u2028\u200b", *" " * 60, *"abcdeST'.,!" * 6]
    cases += ["".join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(3000)]
    for _ in range(2):  # the second time from memory
        assert [c for c, x in zip(cases, ours(cases)) if np.array(tok.encode(c, add_special_tokens=False).ids, "<u4").tobytes() != x] == []


def test_packing_counts_tokens_beside_the_ids(docs):
    ids = packing.tokenised(docs).collect()
    assert ids and all(r.tokens == len(r.ids) // 4 for r in ids)


def test_packing_scores_are_bm25():
    rnd = random.Random(6)
    docs = [np.array([rnd.randrange(40) for _ in range(rnd.randint(1, 60))] + [2], "<u4") for _ in range(30)] + [np.array([2], "<u4")]
    index, n, mean = packing._Index(docs), len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d.tolist()))
    for i, q in enumerate(docs):
        want = np.zeros(n)
        for t, times in Counter(q.tolist()).items():
            for k, d in enumerate(docs):
                tf = int((d == t).sum())
                if tf and df[t] > 1:
                    norm = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
                    want[k] += math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + norm) * times * (packing.K3 + 1) / (times + packing.K3)
        assert index.scores(i) == pytest.approx(want)


def test_packing_brings_copies_together(spark):
    """Of many shards, copies meet in one; a content of more than half a shard is spread over several."""
    rnd = random.Random(3)
    fresh = lambda n: " ".join("".join(rnd.choices("abcdefghiklmnoprstuv", k=5)) for _ in range(n))
    texts = [fresh(80) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[0]) for k in range(100)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=600, shard_tokens=6000).toPandas()
    of = out.groupby("doc_id")["sequence_id"].agg(set)
    ids = packing._dealt(packing.written(packing.tokenised(spark.createDataFrame(rows, "doc_id long, text string")), "ids"), 6000).toPandas()
    assert ids.groupby("shard")["ids"].agg(lambda x: sum(map(len, x)) // 4).max() < 3 * 6000
    shards = int(ids["shards"].iloc[0])
    assert shards > 5
    near = sum(min(abs(x - y) for x in of[k] for y in of[100 + k]) in (0, shards) for k in range(1, 60))
    assert near >= 55


def test_jaccard_components(docs, texts):
    words = {d: t.encode().lower().split() for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for d, w in words.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {d: (len(sets[d]), find(d)) for d in sets}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(339, 400), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in [7, 400, *range(300, 340)]}}


def test_suffix_array_against_sorting():
    rnd = random.Random(2)
    for n, k in [(1, 1), (63, 2), (64, 1), (65, 3), (500, 2), (700, 200), (900, 4)]:
        s = np.array([rnd.randrange(k) for _ in range(n)], np.uint8)
        b = s.tobytes()
        assert list(suffix_array.suffix_array(s)) == sorted(range(n), key=lambda i: b[i:])


def test_repeats_removed_exactly(docs, texts):
    seen, want = set(), {}
    for d in sorted(texts):
        b = texts[d].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, y in zip(b, gone) if not y)
        want[d] = (len(b), sum(gone), sum(1 for i, y in enumerate(gone) if y and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_array.remove_repeats(docs).collect()}
    assert got == want


def test_passages_found_and_cut(docs, texts):
    spans = substring.near_duplicate_passages(docs)
    found = {r.doc_id for r in spans.select("doc_id").distinct().collect()}
    assert found >= set(range(2 * 10**6, 2 * 10**6 + 10)) and found >= set(range(10**6, 10**6 + 25))
    first, clean = {}, set(texts)
    for d in sorted(texts):
        w = texts[d].lower().split()
        runs = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        if any(first.get(r, d) != d for r in runs):
            clean.discard(d)
            assert d in found
        for r in runs:
            first.setdefault(r, d)
    cut = {r.doc_id: r.text for r in substring.remove_passages(docs, spans).collect()}
    assert all(cut[d] == texts[d] for d in texts if d not in found)
    assert all(len(cut[2 * 10**6 + k].split()) <= 62 for k in range(10))


def uncovered_runs(texts, spans, words=50):
    """(doc_id, place) of the runs of words that occur in an earlier document and lie in no span."""
    kept, lost, first = defaultdict(list), [], {}
    for r in spans.collect():
        kept[r.doc_id].append((r.start_word, r.start_word + r.n_words))
    for d in sorted(texts):
        w = texts[d].lower().split()
        for i in range(len(w) - words + 1):
            run = tuple(w[i : i + words])
            if first.setdefault(run, d) != d and not any(a <= i and i + words <= b for a, b in kept[d]):
                lost.append((d, i))
    return lost


def test_passages_among_hot_phrases(spark):
    """Exact passages whose smallest n-grams are mostly phrases that all documents have; the partner is neither first nor last."""
    rnd = random.Random(8)
    phrase = [f"hot{k}" for k in range(16)]
    fresh = lambda n: [x for _ in range(n) for x in phrase + [f"w{rnd.randrange(10**9)}" for _ in range(6)]]
    texts = {d: fresh(6) for d in range(150)}
    for d in range(60, 140):
        at = rnd.randrange(60)
        texts[d][40:95] = texts[d - 50][at : at + 55]
    texts = {d: " ".join(w) for d, w in texts.items()}
    spans = substring.near_duplicate_passages(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5))
    assert not uncovered_runs(texts, spans)
    assert all(r.doc_id in range(60, 140) for r in spans.collect())


def test_passages_of_documents_between_others(spark):
    """Groups of four: an exact passage of 60 words in the second and fourth, 42 words of it in the first and third too."""
    rnd = random.Random(12)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = {}
    for d in range(0, 1200, 4):
        x = fresh(60)
        for k in range(4):
            texts[d + k] = fresh(30) + (x if k % 2 else x[9:51]) + fresh(30)
    texts = {d: " ".join(w) for d, w in texts.items()}
    spans = substring.near_duplicate_passages(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5))
    assert not uncovered_runs(texts, spans)


def test_passages_recall_of_near_copies(spark):
    """Passages with random edits at a similarity of 0.8 and somewhat more, against brute force on the planted pairs."""
    rnd = random.Random(13)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    phrases = [fresh(12) for _ in range(4)]
    texts, near = {}, []
    for d in range(300):
        x = fresh(20) + phrases[d % 4] + fresh(48)
        y = list(x)
        for _ in range(rnd.randint(1, 2)):
            y[rnd.randrange(80)] = fresh(1)[0]
        texts[d], texts[1000 + d] = fresh(40) + x + fresh(40), fresh(40) + y + fresh(40)
        p, q = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
        if len(p & q) >= 0.8 * len(p | q):
            near.append(1000 + d)
    texts = {d: " ".join(w) for d, w in texts.items()}
    spans = substring.near_duplicate_passages(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5))
    found = {r.doc_id for r in spans.collect() if r.partner_id == r.doc_id - 1000}
    assert len(near) > 150 and len(found & set(near)) >= 0.95 * len(near)
    assert all(d >= 1000 for d in found)


def test_frequent_grams_count_every_place(spark):
    """N-grams are marked by the number of all their places, to the last one, however the rows are dealt."""
    rnd = random.Random(21)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts, phrases = defaultdict(list), {}
    for places in (substring.OFTEN - 1, 25, 40, 100):
        phrases[places] = [fresh(5) for _ in range(200)]
        for p in phrases[places]:
            for d in rnd.sample(range(400), places):
                texts[d] += p + fresh(1)
    made = spark.createDataFrame([(d, " ".join(w)) for d, w in sorted(texts.items())], "doc_id long, text string")
    tables = [substring.frequent_grams(blocks.make_blocks(made.repartition(k)), 5) for k in (1, 5)]
    assert np.array_equal(tables[0][0], tables[1][0]) and tables[0][1] == tables[1][1]
    slot = (substring.SLOTS * sum(len(" ".join(w).encode()) for w in texts.values())).bit_length()
    wrong = 0
    for places, some in phrases.items():
        h = np.concatenate([substring.mix(substring.shingles(substring.Words([" ".join(p).encode()]), 5)[0]) for p in some])
        bit = (h >> np.uint64(64 - tables[0][1])).astype(np.int64)
        marked = (tables[0][0][bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
        want = places >= substring._enough_places(h >> np.uint64(64 - max(slot, 24)))
        assert not (want & ~marked).any()
        wrong += int((marked & ~want).sum())
    assert wrong <= 8  # by a shared bit alone, of 65536 or more


def test_near_copies_of_passages_in_many_places(spark):
    """Copies of one passage of 80 words, each with a word of its own in the middle, beyond OFTEN places."""
    rnd = random.Random(60)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts, groups = {}, 10
    for g in range(groups):
        x = fresh(80)
        for d in range(60):
            texts[1000 * g + d] = " ".join(fresh(30) + x[:40] + fresh(1) + x[41:] + fresh(30))
    spans = substring.near_duplicate_passages(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"))
    found = {r.doc_id for r in spans.select("doc_id").distinct().collect()}
    assert len(found) >= 0.8 * 59 * groups


@pytest.mark.parametrize("apart", [16, 20, 24])
def test_passages_side_by_side(spark, apart):
    """Two exact passages that lie apart in the earlier text and side by side in the later one."""
    rnd = random.Random(apart)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = {}
    for d in range(20):
        x, y = fresh(50 + 5 * (d % 3)), fresh(50 + 5 * (d % 3))
        texts[d] = fresh(30) + x + fresh(apart) + y + fresh(30)
        texts[100 + d] = fresh(30) + x + y + fresh(30)
    texts = {d: " ".join(w) for d, w in texts.items()}
    spans = substring.near_duplicate_passages(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"))
    assert not uncovered_runs(texts, spans)


@pytest.mark.parametrize("seed", range(6))
def test_matches_with_insertions_on_one_side(seed):
    """Whatever pair of stretches brute force finds at the bound overlaps a match, whichever side is the longer one."""
    rnd = random.Random(seed)
    word = lambda: rnd.randrange(1, 2**31)
    width, base = 46, [word() for _ in range(48)]
    long = list(base)
    for k in range(11):
        long.insert(4 * k + 3, word())
    noise = lambda: [word() for _ in range(20)]
    short = np.array(noise() + base + noise(), np.uint32)
    long = np.array(noise() + long + noise(), np.uint32)
    for mine, theirs in ((short, long), (long, short), (short, short)):
        best = 0.0
        for i in range(len(mine) - width + 1):
            for e in range(i + width, len(mine) + 1, 1):
                p = set(mine[i:e].tolist())
                where = [k for k, x in enumerate(theirs.tolist()) if x in p]
                if where and where[-1] + 1 - where[0] >= width:
                    q = set(theirs[where[0] : where[-1] + 1].tolist())
                    best = max(best, len(p & q) / len(p | q))
        got = substring.matches(mine, theirs, width, 80, 100)
        assert bool(got) == (best >= 0.8)
        assert all(e - i >= width and b - a >= width and j >= 0.8 for i, e, a, b, j in got)


@pytest.mark.parametrize(("num", "den"), [(80, 100), (1, 2), (9, 10)])
def test_first_filter_keeps_all_that_can_link(num, den):
    """For all small sizes and overlaps at the bound, what both leading parts share where common n-grams come last."""
    for m in range(1, 120):
        for k in range(1, 120):
            for both in range(1, min(m, k) + 1):
                if den * both >= num * (m + k - both):
                    shared = min(both, jaccard._lead(m, num, den) - (m - both), jaccard._lead(k, num, den) - (k - both))
                    assert shared >= jaccard._least_repeated(m, num, den)


def test_nine_and_eight_words_link(spark):
    rnd = random.Random(9)
    texts = {}
    for d in range(40):
        w = [f"w{rnd.randrange(10**9)}" for _ in range(9)]
        texts[d], texts[100 + d] = " ".join(w), " ".join(w[:8] if d % 2 else w[1:])
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    assert got == {d: d % 100 for d in texts}


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores(docs, texts, order):
    words = {d: [w.decode() for w in t.encode().lower().split()] for d, t in texts.items()}
    counts = defaultdict(Counter)
    for w in words.values():
        for n in range(1, order + 1):
            counts[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(counts[1].values())

    def score(w, i):
        factor = 1.0
        for n in range(min(order, i + 1), 1, -1):
            g = tuple(w[i - n + 1 : i + 1])
            if counts[n][g] >= 2:
                return factor * counts[n][g] / counts[n - 1][g[:-1]]
            factor *= 0.4
        return factor * counts[1][(w[i],)] / total

    for r in lm_score.lm_scores(docs, order=order).collect():
        assert r.log10_score == pytest.approx(sum(math.log10(score(words[r.doc_id], i)) for i in range(r.n_words)), abs=1e-6)


def test_quality_statistics(texts):
    for t in list(texts.values())[:150]:
        w = t.encode().split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = Counter(windows)
        inside = {i + k for i, x in enumerate(windows) if twice[x] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if x.split()]
        n, chars, symbols, dups, repeated, failed, kept, _ = quality.judge(t)
        assert (n, chars, repeated) == (len(w), sum(len(x.decode()) for x in w), len(inside))
        assert symbols == sum(c in "#*$%&|<>" for c in t) and dups == len(lines) - len(set(lines))
        assert failed == (n < 20 or 100 * repeated > 30 * n) and not (failed and kept)


def test_subwords_do_not_depend_on_the_words_beside_them(spark):
    """Words hashed together have the buckets that each has alone, and scores are the same however texts are batched."""
    words = ["a", "fool", "xfool", "straße", "日本語", "ab" * 40, "\U0001f600"]
    ids, word = toxicity.subwords_of(words)
    for k, w in enumerate(words):
        alone = toxicity.subwords(w)
        m = len(w) + 2
        assert sorted(ids[word == k].tolist()) == sorted(alone.tolist()) and len(alone) == 1 + sum(max(0, m - n + 1) for n in toxicity.GRAMS)
    shared = set(ids[word == 1].tolist()) & set(ids[word == 2].tolist())
    assert len(shared) >= 6  # foo, ool, ol>, fool, ool>, fool>
    model = toxicity.train(["you fool " * 3, "a nice day"] * 20, [1, 0] * 20)
    texts = {k: " ".join(words[: k % 8] * (k % 5)) for k in range(40)} | {40: None}
    scores = [dict(toxicity.score(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(k), model).collect()) for k in (1, 7)]
    assert all(abs(scores[0][d] - scores[1][d]) < 1e-12 for d in texts)
    for d, t in texts.items():
        found, of = toxicity.subwords_of(toxicity.words_of(t)) if t else (np.zeros(0, int), [])
        z = model.bias + (float(model.table[found].mean(dtype=float)) if len(found) else 0.0)
        assert abs(scores[0][d] - 1 / (1 + math.exp(-z))) < 1e-6


def test_toxicity_generalises_to_unseen_spellings():
    rnd = random.Random(1)
    plain = ["".join(rnd.choice("abcdeghilmnoprstu") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    odd = ["zorg" + "".join(rnd.choice("abcdeo") for _ in range(3)) for _ in range(200)]
    make = lambda bad, words: " ".join(rnd.choices(plain, k=80) + (rnd.sample(words, 4) if bad else []))
    labels = [k % 4 == 0 for k in range(400)]
    model = toxicity.train([make(y, odd[:150]) for y in labels], labels)

    def p(text):
        s = np.concatenate([toxicity.subwords(w) for w in toxicity.words_of(text)])
        return 1 / (1 + math.exp(-(model.bias + model.table[s].mean())))

    hits = sum(p(make(True, odd[150:])) >= toxicity.THRESHOLD for _ in range(60))
    false = sum(p(make(False, odd)) >= toxicity.THRESHOLD for _ in range(60))
    assert hits >= 48 and false <= 6


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(registry.ORACLE[name]).df())


def test_pipeline_stages(spark, texts):
    import corpus_pipeline as P

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in sorted(texts.items())], "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "substring dedup", "packing"]
    good = P.keep_quality(spark, docs, DATA)
    assert good.columns == names and ids(good) == {d for d, t in texts.items() if quality.judge(t)[6]}
    single = P.drop_near_copies(spark, docs, DATA)
    assert single.columns == names and ids(single) == {r.doc_id for r in jaccard.jaccard_components(docs).collect() if r.doc_id == r.component_id}
    cut = P.cut_passages(spark, single, DATA)
    assert cut.columns == names and ids(cut) == ids(single)
    assert P.pack_sequences(spark, cut, DATA).count() >= cut.count()


def test_corpus_sums_beyond_32_bits(docs):
    """Sums of counts go on growing where 32 bits end."""
    few = blocks.make_blocks(docs.limit(200), 1 << 14)
    n = few.count()
    keys = np.array([0, 5, 2**63], np.uint64)
    ask = lambda row: (keys, np.array([3 * 10**9, 1, 2], np.int64))
    use = lambda row, right: blocks.pd.DataFrame({"counts": [blocks.counts_in(right.sort_values("frag")).astype(np.int64)]})
    got = blocks.with_answers(few, blocks.ask_counts(few, ask, 2), use, "counts array<long>").collect()
    assert n > 1 and all(list(r.counts) == [3 * 10**9 * n, n, 2 * n] for r in got)
