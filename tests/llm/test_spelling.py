"""Spelling variants against brute force, signatures' promise, chains, edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

from matchloom.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int, sig long"


def brute_counts(rows, every=199, length=6, least=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def deletions(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def brute_near(words):
    """By deleted letters: a replacement leaves equal words at one place, a deletion gives the other word."""
    by, near = defaultdict(list), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[i, w[:i], w[i + 1 :]].append(w)
    for same in by.values():
        for a in same:
            near[a].update(b for b in same if b != a)
    for w in words:
        for d in deletions(w):
            if d in words:
                near[w].add(d)
                near[d].add(w)
    return near


def brute(rows, **options):
    n = brute_counts(rows, **options)
    near = brute_near(n)
    form = {}
    for w in n:
        if near[w]:
            b = min(near[w], key=lambda x: (-n[x], x))
            if n[b] >= 5 * n[w]:
                form[w] = b

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def key(rows):
    return sorted(tuple(r) for r in rows)


def found(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(6, 9))) for _ in range(400)}
    for w in list(words)[:250]:
        i, c = rng.randrange(len(w)), rng.choice("abcdéz")
        words.add(rng.choice([w[:i] + w[i + 1 :] + "", w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    words |= {"aaaaaa" + "a" * k for k in range(4)} | {"abababab", "babababa", "×÷abcdef"}
    want = {(a, b) for a, bs in brute_near(words).items() for b in bs if a < b}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for crowd in (0, 3, 64):  # all words under halves, some, none
        got = [tuple(r) for r in S.near_pairs(df, crowd=crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    for first, second in ((2, 4), (3, 1), (1, 4)):
        assert {tuple(r) for r in S.near_pairs(df, first=first, second=second).collect()} == want


def test_variants_equal_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgéÿ") for _ in range(rng.randint(6, 10))) for _ in range(40)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.expovariate(0.2)), 39)]
            if rng.random() < 0.2:
                j = rng.randrange(len(w))
                w = w[:j] + rng.choice(["", "x", w[j].upper() + "q"]) + w[j + 1 :]
            words.append(w)
        rows.append((i, rng.choice([" ", "_", "1", ", "]).join(words)))
    rows += [(None, " ".join(base)), (5, None), (6, ""), (7, base[0] + " ") , (7, base[0] + " "), (8, (base[1] + " ") * 20000), (9, "z" * 100_000)]
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    assert found(S.spelling_variants(df, every=7)) == brute(rows, every=7)
    assert found(S.spelling_variants(df)) == brute(rows)


def test_chains_and_ties(spark):
    counts = {"spelling": 5000, "speling": 1000, "spling": 200, "splings": 40, "spllings": 8, "tieword": 10, "tiewora": 50, "tieworb": 50}
    rows = [(None, " ".join([w] * n)) for w, n in counts.items()]
    got = {r[0]: r for r in found(S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 40))}
    assert got["spllings"][1:3] == ("splings", "spelling") and got["spelling"][1:3] == (None, "spelling")
    assert got["tieword"] == ("tieword", "tiewora", "tiewora", 10, 2, 50) and got["tiewora"][1:] == (None, "tiewora", 50, 2, None)


def test_empty(spark):
    for rows in ([], [(1, None), (2, ""), (3, "short")]):
        assert not S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_query(spark):
    import pandas as pd

    from ..conftest import DATA

    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    assert found(S.op13_spelling_variants(spark, DATA)) == brute(list(zip(docs["doc_id"], docs["text"])))


def test_no_table_is_broadcast(spark, monkeypatch):
    """Spark takes tables of exploded signatures for as small as the words' file; a broadcast of them is the driver's memory."""
    plans, write = [], S.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def written(df, name):
        plans.append(plan(df))
        return write(df, name)

    monkeypatch.setattr(S, "written", written)
    counts = {"spelling": 5000, "speling": 1000, "spling": 200, "splings": 40, "spllings": 8}
    docs = spark.createDataFrame([(None, " ".join([w] * n)) for w, n in counts.items()], "doc_id long, text string")
    out = S.spelling_variants(docs, every=1 << 40)
    assert len(out.collect()) == 5
    pairs = S.near_pairs(spark.createDataFrame([(w,) for w in counts], "word string"), crowd=1)
    assert len(pairs.collect()) == 4
    plans += [plan(out), plan(pairs)]
    assert len(plans) >= 5 and sum("SortMergeJoin" in p for p in plans) >= 4
    assert not [p for p in plans if "Broadcast" in p]
