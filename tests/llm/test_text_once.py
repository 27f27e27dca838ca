"""Scoring sends each text to the workers once and makes the features of few texts at once."""

import tracemalloc

import numpy as np

from helixspark.llm import toxicity


def test_text_is_sent_once(spark, monkeypatch):
    sent, real = [], toxicity.id_text
    monkeypatch.setattr(toxicity, "id_text", lambda *a: sent.append(real(*a)) or sent[-1])
    rows = [(1, "vile words. fine", "en"), (None, None, None), (3, "", "de"), (3, "añb", "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = toxicity.train([b"vile words", b"fine words"] * 4, np.array([1.0, 0.0] * 4))
    got = toxicity.score(docs, model, located=False, keep=("lang", "text", "doc_id")).collect()
    assert sorted(((r.kept2, r.kept1, r.kept0) for r in got), key=str) == sorted(rows, key=str)
    assert [x for x, _ in sent[0].dtypes] == ["doc_id", "text", "kept0", "kept1"]
    raw = docs.selectExpr("doc_id", "cast(text as binary) as text")
    assert sorted(str(r.kept0 if r.kept0 is None else bytes(r.kept0).decode()) for r in toxicity.score(raw, model, keep=("text",)).collect()) == sorted(str(t) for _, t, _ in rows)


def test_memory_of_features():
    rng = np.random.default_rng(3)
    texts = [b" ".join(bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(1, 9, 300)) for _ in range(toxicity.CHUNK // 1600)]
    toxicity.sentences(texts[:1])
    tracemalloc.start()
    toxicity.sentences(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
