"""Token files: ids against the tokenizer, a round trip through the files, random access, edge cases, failed tasks."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchloom.llm import token_files as T

SCHEMA = "doc_id long, text string, ids string, start int"
ROWS = [
    (5, "The last of them, with some words.\nAnd a line; 3rd, don't!", "x", 1), (None, "without an id", None, None), (2, None, "x", 1), (3, "", "x", 1), (1, " a  b\n \n c\t", "x", 1),
    (4, "word and " * 9000, "x", 1), (4, "word and " * 9000, "x", 1), (4, "another text of this id", "x", 1), (-7, "été İ \U0001f642 <|endoftext|> 日本 x", "x", 1),
]


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    return t


def expected(tok, rows):
    out, start = [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, T.END], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_ids_equal_the_tokenizers(tok):
    make, rng = T.ByteTokens(public_tokenizers.path(T.TOKENIZER)), random.Random(3)
    some = [" ", "  ", "\n", " \n", "\n ", "\t", "a", "B", "é", "ß", "'s", "don't", ",", ".", "!?", "1", "23", "\x1c", "\x85", "<|endoftext|>", "日本", "\U0001f642", "é", "İ", "ǅ", "ª", "²", "×", "_", "\r\n"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x600), rng.randrange(0x600, 0xD800), rng.randrange(0x10000, 0x20000)])) for _ in range(12)) for _ in range(2000)]
    for text, ids in zip(texts, make(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_round_trip(spark, tok, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = T.write_token_files(docs, str(tmp_path / "t"), length=64)
    got = [tuple(r) for r in T.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).orderBy("start").collect()]
    want = expected(tok, ROWS)
    # equal ids of different texts may come in either order
    assert [(i, n) for i, _, n, _ in got if i != 4] == [(i, n) for i, _, n, _ in want if i != 4]
    assert sorted((i, n, c) for i, _, n, c in got if i is not None) == sorted((i, n, c) for i, _, n, c in want if i is not None)
    assert [s for _, s, _, _ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1].tolist()]
    assert [i for i, *_ in got] == [None, -7, 1, 2, 3, 4, 4, 4, 5]


def test_sequences_and_random_access(spark, tok, tmp_path):
    path = T.write_token_files(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "t"), length=64)
    files = T.TokenFiles(path)
    rows = T.read_token_files(spark, path, "sequences").orderBy("sequence_id").collect()
    assert [r.sequence_id for r in rows] == list(range(len(files))) and files.width == "uint16"
    for r in rows:
        ids, bits = files[r.sequence_id]
        assert not ids.flags.owndata and ids.tolist() == list(r.ids) and len(ids) == 64
        mask = np.unpackbits(bits, bitorder="little")
        assert mask.sum() == r.n_real and mask[: r.n_real].all() and not ids[r.n_real :].any()
    assert sum(r.n_real for r in rows) == files.start[-1] == sum(n for _, _, n, _ in expected(tok, ROWS))
    with pytest.raises(IndexError):
        files[len(files)]
    long = next(s for s, x in enumerate(files.shards) if x["sequences"] > T.BATCH)  # the long texts span record batches
    index = files.reader(long, "documents").get_batch(0).to_pydict()
    k = int(np.argmax(index["n_tokens"]))
    assert files.ids(long, index["start"][k], index["n_tokens"][k]).tolist() == [*tok.encode("word and " * 9000).ids, T.END]


def test_edges(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    path = T.write_token_files(empty, str(tmp_path / "e"))
    assert T.read_token_files(spark, path).count() == 0 and T.read_token_files(spark, path, "sequences").count() == 0
    with pytest.raises(Exception, match="multiple of 8"):
        T.write_token_files(empty, str(tmp_path / "f"), length=12)
    T.write_token_files(spark.createDataFrame(ROWS, SCHEMA), path)
    T.write_token_files(spark.createDataFrame(ROWS[:1], SCHEMA), path)  # the newer write counts
    assert T.read_token_files(spark, path).count() == 1


def test_files_of_failed_tasks_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.dataSource.register(T.TokenSource)
    good = T.token_ids(spark.createDataFrame(ROWS, SCHEMA))
    bad = good.withColumn("ids", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("ids")).cast("binary"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("token_files").mode("append").save(path)
    T.write_token_files(spark.createDataFrame(ROWS, SCHEMA), path)
    assert T.read_token_files(spark, path).count() == len(ROWS)


def test_query(spark, tok):
    import pandas as pd

    from ..conftest import DATA

    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = sorted(tuple(r) for r in T.op12_token_files(spark, DATA).collect())
    assert got == expected(tok, list(zip(docs["doc_id"], docs["text"])))


def test_lines_do_not_make_strings_of_word_pairs(tok):
    make = T.ByteTokens(public_tokenizers.path(T.TOKENIZER))
    words = [a + b for a in ("one", "Two", "thrée", "4", "don't") for b in ("", ".", ",!", "5")]
    texts = [f"x {v}\n{w} y" for v in words for w in words] + ["x \x01one", "x\n\x01one", "a\n\nb \nc\n d \n e\n", "\none\n'two"]
    for text, ids in zip(texts, make(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
    assert len(make.memo) < 4 * len(words)
