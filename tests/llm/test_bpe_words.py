"""Words of the BPE operator: encoded many at once, and texts read once."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from matchloom.llm import bpe

PATH = public_tokenizers.path(bpe.TOKENIZER)


def test_words_encoded_at_once_equal_those_encoded_apart():
    tok = Tokenizer.from_file(PATH)
    texts = ["one two, 'tis\tthree \n four", " lead", "  two", "end ", "x", "naïve 日本 👩‍👩‍👧 <|endoftext|> a<|endoftext|>b   c d", "a" * 300, "\n", "one two"]
    size, seq, words, edge = bpe._word_table(texts, 3)
    assert edge[0] == 0 and edge[-1] == len(words) == len(set(words)) and size.sum() == len(seq)
    flat, n = bpe._encoded(tok, words, bpe._lengths(PATH), np.dtype("<u2"))
    apart = np.split(flat, np.cumsum(n)[:-1])
    for text, at in zip(texts, np.split(seq, np.cumsum(size)[:-1])):
        assert [int(i) for w in at for i in apart[w]] == tok.encode(text, add_special_tokens=False).ids, text


def test_texts_are_cut_into_words_once(spark):
    docs = spark.createDataFrame([(i, f"text {i} of words") for i in range(40)], "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    out = bpe.encode(docs.repartition(2).mapInPandas(count, docs.schema), stable=True).collect()
    assert len(out) == 40 and seen.value == 2 * 40  # their bytes are summed, then they are cut
