"""What an operator remembers in a worker goes when a task of another operator begins there, and stays for its own next tasks."""

import numpy as np
import pyarrow as pa

from helixspark.llm import _common, bpe, toxicity


def test_another_operator_forgets(monkeypatch):
    monkeypatch.setattr(_common, "_LEFT", {})
    path, pattern = bpe.vocabulary(None)
    _common.begin("bpe", bpe.forget)
    kept = bpe.codec(path, pattern)
    _common.begin("bpe", bpe.forget)
    assert bpe.codec(path, pattern) is kept
    _common.begin("toxicity")
    assert not bpe.codec.cache_info().currsize and not bpe.ranks.cache_info().currsize


def test_operators_forget_on_workers(spark):
    """Through the plans: after BPE a worker that scores remembers no pieces any more."""
    docs = spark.createDataFrame([(k, f"some text {k}. more") for k in range(8)], "doc_id bigint, text string").coalesce(1)
    ids = bpe.bpe(docs, keep=()).collect()

    def left(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([f"{sorted(_common._LEFT)} {bpe.codec.cache_info().currsize}"])], ["left"])

    assert docs.mapInArrow(left, "left string").first()[0] == "['bpe'] 1"
    scores = toxicity.score(docs, toxicity.train([b"vile words", b"fine words"] * 4, np.array([1.0, 0.0] * 4)), located=False).collect()
    assert docs.mapInArrow(left, "left string").first()[0] == "['toxicity'] 0"
    assert len(ids) == len(scores) == 8
