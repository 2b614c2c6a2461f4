"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import numpy as np
import pytest

from matchloom.llm import bpe, jaccard, knn, lm_score, packing, quality, substring, suffix_array, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, key long, block long, score double, frag int, ids string"
ROWS = [
    (1, None, None, 1, 1, 0.1, 0, "x"),
    (2, "", "en", None, None, None, None, None),
    (3, " \n\t ", "en", 1, 1, 0.1, 0, "x"),
    (4, "one two three four five six seven", "en", 1, 1, 0.1, 0, "x"),
    (4, "one two three four five six seven", "en", 1, 1, 0.1, 0, "x"),
    (5, "One Two three four five six seven", "en", 1, 1, 0.1, 0, "x"),
    (6, "word " * 30000, "en", 1, 1, 0.1, 0, "x"),
    (7, "\u00e9t\u00e9 \u0130 \U0001f642 <|endoftext|> \u03a3", "fr", 1, 1, 0.1, 0, "x"),
    (None, "no id here at all", "en", 1, 1, 0.1, 0, "x"),
    (-9, "negative id of a short text", "en", 1, 1, 0.1, 0, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, None), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def frame(df):
    return df.toPandas()


def test_bpe(docs, empty):
    out = frame(bpe.decode(bpe.encode(docs)))
    assert len(out) == len(ROWS) and set(out["text"]) == {r[1] or "" for r in ROWS}
    assert not len(frame(bpe.decode(bpe.encode(empty))))


def test_toxicity(docs, empty, labels):
    out = frame(toxicity.toxicity(docs, labels))
    assert len(out) == len(ROWS) and out["score"].between(0, 1).all()
    assert not len(frame(toxicity.toxicity(empty, labels)))
    assert len(frame(toxicity.toxicity(docs, labels.limit(0)))) == len(ROWS)


def test_quality(docs, empty):
    out = frame(quality.quality_rules(docs, with_text=True))
    assert len(out) == len(ROWS) and not out["kept"].any()  # all are short, or one word over and over
    assert not len(frame(quality.quality_rules(empty)))


def test_packing(docs, empty):
    out = frame(packing.pack(docs))
    assert out["length"].sum() == sum(len(x) // 4 for x in frame(packing.tokenised(docs))["ids"])
    assert out.groupby("sequence_id")["length"].sum().max() <= 4096
    assert out["doc_id"].isna().sum() == 1
    assert not len(frame(packing.pack(empty)))


def test_jaccard(docs, empty):
    out = frame(jaccard.jaccard_components(docs)).set_index("doc_id")
    assert len(out) == len(ROWS) - 1
    assert list(out["component_id"].loc[[5]]) == [4] and out["component_id"].loc[2] == 2 and out["n_shingles"].loc[3] == 0
    assert not len(frame(jaccard.jaccard_components(empty)))


def test_passages(docs, empty):
    assert not len(frame(substring.near_duplicate_passages(empty)))
    spans = substring.near_duplicate_passages(docs)
    assert not len(frame(spans))  # the long text repeats itself alone
    assert len(frame(substring.remove_passages(docs, spans))) == len(ROWS)


def test_suffix_array(docs, empty):
    out = frame(suffix_array.remove_repeats(docs))
    assert len(out) == len(ROWS) - 1
    assert int(out.loc[out["doc_id"] == 6, "n_removed"].iloc[0]) == 150000 - 5
    assert not len(frame(suffix_array.remove_repeats(empty)))


def test_lm(docs, empty):
    out = frame(lm_score.lm_scores(docs)).set_index("doc_id")
    assert len(out) == len(ROWS) - 1 and out["log10_score"].loc[1] == 0 and np.isnan(out["mean_log10"].loc[2])
    assert not len(frame(lm_score.lm_scores(empty)))


def test_knn(spark):
    rows = [(0, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, [-1.0, 2.0], 1), (3, None, 1), (4, [], 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 0.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (1, [0.5, 0.25], 2)]
    v = knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    out = frame(knn.top_inner_products(v, v.where("vec_id = 0"), 10)).sort_values("rank")
    assert list(out["vec_id"]) == [1, 1, 2] and list(out["score"]) == [512 * 512 + 256 * 256] * 2 + [-512 * 1024 + 256 * 2048]
    assert not len(frame(knn.top_inner_products(v.limit(0), v.limit(0), 10)))


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://Www.Example.COM/en/x?q"), (4, "a://b.net/es/"), (5, "a://b.net/esx"), (6, "a://x.com"), (7, "a://Example.com/en/"), (7, "a://notexample.com/en/"), (8, "://"), (9, "x://h.org#f://z.net/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    out = frame(url_filter.filter_urls(pages, url_filter.host_reputation(none)))
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in out.itertuples())
    assert got == [
        (1, "", "", "", "allow"), (2, "", "", "", "allow"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (4, "b.net", "/es/", "net/es/", "block"),
        (5, "b.net", "/esx", "", "allow"), (6, "x.com", "", "", "allow"), (7, "example.com", "/en/", "example.com/en/", "block"), (7, "notexample.com", "/en/", "com/", "allow"),
        (8, "", "", "", "allow"), (9, "h.org", "", "", "allow"),
    ]
    bad = spark.createDataFrame([("h.org", 1)] * 60 + [("g.org", 0)] * 60 + [(None, 1), ("k.org", None)], "host string, bad int")
    rep = {r.host: r.bound for r in url_filter.host_reputation(bad).collect()}
    assert rep["h.org"] > 0.5 > rep["g.org"] and set(rep) == {"h.org", "g.org"}
