"""Training counts a chunk of texts at a time: its memory stays near that of the texts, and the chunks have no say in the weights."""

import tracemalloc

import numpy as np
import pytest

from helixspark.llm import toxicity


def corpus(n, length):
    rng = np.random.default_rng(3)
    known = ["".join(map(chr, rng.integers(97, 123, rng.integers(3, 12)))) for _ in range(20_000)]
    labels = (rng.random(n) < 0.2).astype(float)
    texts = [" ".join("vile. scum" if y and i % 50 == 7 else known[k] + "." * (i % 9 == 0) for i, k in enumerate(rng.integers(0, len(known), length))).encode() for y in labels]
    return texts, labels


def test_memory_of_training(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 100_000)
    monkeypatch.setattr(toxicity, "STEPS", 3)
    texts, labels = corpus(300, 3000)
    toxicity.train(texts[:2], np.array([0.0, 1.0]))
    tracemalloc.start()
    hashes, _ = toxicity.train(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes)
    assert peak < 6 * sum(map(len, texts))


@pytest.mark.parametrize("chunk", [1, 5000])
def test_chunks_have_no_say(monkeypatch, chunk):
    texts, labels = corpus(120, 200)
    texts[5], texts[-1] = b"", b" . "
    monkeypatch.setattr(toxicity, "STEPS", 20)
    hashes, weights = toxicity.train(texts, labels)
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    again, w = toxicity.train(texts, labels)
    assert len(hashes) and np.array_equal(hashes, again) and np.array_equal(weights, w)
