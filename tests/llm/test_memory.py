"""What the operators hold in memory for a block of text."""

import tracemalloc

import numpy as np

from matchloom.llm import common, toxicity


def test_words_take_few_bytes_a_byte_of_text(monkeypatch):
    texts = [(" ".join(f"w{i * i % 977}" for i in range(k, k + 400)) + "\n").encode() for k in range(900)]
    size = sum(map(len, texts))
    monkeypatch.setattr(common, "_POW", {})
    tracemalloc.start()
    try:
        common.Words(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert size > 1_500_000 and peak < 25 * size, peak / size


def test_words_hash_alike_wherever_they_are_cut(monkeypatch):
    texts = [b"one two one", b"", b"x" * 500 + b" one", b"two\nx"]
    whole = common.Words(texts)
    monkeypatch.setattr(common, "SLICE", 7)
    cut = common.Words(texts)
    assert np.array_equal(whole.hash, cut.hash) and whole.hash[0] == whole.hash[2] == whole.hash[4]


def test_training_holds_few_bytes_a_subword(monkeypatch):
    """On the driver: five bytes for each bucket of each text, and as many again for one batch and the embedding."""
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "STEPS", 1)
    monkeypatch.setattr(toxicity, "BUCKETS", 1 << 16)
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(3000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 260)) for _ in range(1000)]
    entries = sum(len(toxicity._bag(t)[0]) for t in texts)
    tracemalloc.start()
    try:
        toxicity.train(texts, [k % 2 for k in range(len(texts))])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert entries > 3_500_000 and peak < 12 * entries, peak / entries
