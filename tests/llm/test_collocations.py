"""Collocations against brute force, what chunks own, exact arithmetic, edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from matchloom.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, f int"


def brute_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            lang_ = "und" if lang is None else lang
            n[lang_] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang_][tuple(words[i : i + k])] += 1
    return f, n


def brute(rows, least, kept=2000, share=100):
    out = []
    counts, n = brute_counts(rows)
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        scored = []
        for p, a in cand.items():
            if 100 * around[p] >= share * a and around[p]:
                continue
            s, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:kept], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, docs):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "and", "Été", "x", "ﬂ y", "o'k", "\U0001f642", *("w%d" % i for i in range(30))]
    phrases = [[rng.choice(vocabulary) for _ in range(rng.randint(2, 7))] for _ in range(12)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice(phrases) if rng.random() < 0.3 else [rng.choice(vocabulary)]
        text = "".join(w + rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " \t "]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "en", None, "de", ""])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(4)


def test_chunks_own_every_phrase_once():
    rng = np.random.default_rng(2)
    rows = [" ".join(str(x) for x in rng.integers(0, 12, n)).encode() for n in (0, 1, 3, 4, 5, 6, 50, 700)] + [b"same " * 500, b"a, b; c\n\nd"]
    for every in (1, 2, 5, 1 << 30):
        _, chunks = C.parse(rows, 4, every)
        assert all(c.split(b" ") == c.split() for c in chunks)
        counts = Counter()
        for chunk, n in Counter(chunks).items():
            words = chunk.split(b" ")
            w = C._Words([chunk])
            ends = len(words) - 4 in C._triggers(w, 4, every)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    if not (len(words) > 4 and ends) or i < len(words) - 4:
                        counts[tuple(words[i : i + k])] += n
        want, _ = brute_counts([(0, t.decode(), "en") for t in rows])
        assert {tuple(x.decode() for x in p): n for p, n in counts.items()} == dict(want["en"])


def test_equals_brute_force(spark):
    rows = texts(1, 250)
    rows += [(None, rows[3][1], "en"), (3, rows[3][1], rows[3][2]), (4, None, "en"), (5, "", None), (6, "Repeat me now " * 20000, "xx"), (7, "a" * 200_000, "en"), (8, " \t\n", "fr")]
    df = frame(spark, rows)
    for least, every in ((20, 16), (5, 3), (100, 16)):
        want = brute(rows, least)
        assert want and found(C.collocations(df, least=least, every=every)) == want
    assert found(C.collocations(df, least=5, kept=7, share=60)) == brute(rows, 5, 7, 60)


def test_small_blocks_and_narrow_hashes(spark, monkeypatch):
    """Many blocks and fragments, and hashes so narrow that phrases share them."""
    rows = texts(2, 120)
    want = brute(rows, 8)
    monkeypatch.setattr(C, "DICTIONARY_BYTES", 500)
    monkeypatch.setattr(C, "GATHER_BYTES", 2000)
    monkeypatch.setattr(C, "LOST", 0)  # every text comes from the block that asked first, none has to be looked up
    assert found(C.collocations(frame(spark, rows), least=8)) == want
    monkeypatch.setattr(C, "LOST", 7)
    narrow = C._cut
    monkeypatch.setattr(C, "_cut", lambda keys, bits: (lambda z: ((z[0] << np.uint64(bits - 12)), z[1]))(narrow(keys, 12)))
    assert found(C.collocations(frame(spark, rows), least=8)) == want


def test_products_past_64_bits(spark, monkeypatch):
    """Counts of 10^13 out of 10^15 words: 1000 * a * n is about 10^31."""
    a, n = 10**13 + 7, 10**15 + 1
    l, r = 3 * 10**13 + 1, 7 * 10**13 + 3
    f = [("en", "", 0, n), ("en", "p", 1, l), ("en", "q", 1, r), ("en", "p q", 2, a)]
    monkeypatch.setattr(C, "frequent_phrases", lambda docs, *_: spark.createDataFrame(f, "lang string, phrase string, words int, f long"))
    assert found(C.collocations(spark.createDataFrame([], SCHEMA))) == [("en", 1, "p q", a, l, r, n, 1000 * a * n // (l * r))]


def test_empty(spark):
    assert found(C.collocations(spark.createDataFrame([], SCHEMA))) == []
    assert found(C.collocations(frame(spark, [(1, None, "en"), (2, "", None), (3, "one two", "en")]))) == []


def test_query(spark):
    import pandas as pd

    from ..conftest import DATA

    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    rows = list(zip(docs["doc_id"], docs["text"], docs["lang"]))
    assert found(C.op11_collocations(spark, DATA)) == brute(rows, 100)
