"""An idle worker keeps nothing, for its memory counts beside that of busy ones; a piece of texts takes little at once."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from helixspark.llm import _common, bpe, ngram_join, toxicity


def test_idle_workers_forget(spark):
    docs = spark.createDataFrame([(k, f"some text {k}. more") for k in range(8)], "doc_id bigint, text string").coalesce(1)

    def left(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([f"{sorted(_common._LEFT)} {bpe.codec.cache_info().currsize}"])], ["left"])

    assert len(bpe.bpe(docs, keep=()).collect()) == 8
    time.sleep(6)
    assert docs.mapInArrow(left, "left string").first()[0] == "[] 0"


def test_the_next_task_finds_what_was_left(monkeypatch):
    monkeypatch.setattr(_common, "_LEFT", {})
    monkeypatch.setattr(_common, "IDLE", 0.3)
    gone = []
    for _ in range(3):
        _common.begin("bpe", lambda: gone.append(1))
        time.sleep(0.4)  # longer than IDLE, but busy
        _common.end()
        assert not gone
    time.sleep(1)
    assert gone == [1] and not _common._LEFT and not _common._WAITS


@pytest.mark.parametrize("make, most", [(lambda x: toxicity.sentences(x), toxicity.CHUNK), (lambda x: ngram_join.shingles(x, 5), ngram_join.CHUNK)])
def test_memory_of_a_piece(make, most):
    rng = np.random.default_rng(3)
    texts = [b" ".join(bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(1, 9, 300)) for _ in range(most // 1600)]
    make(texts[:1])
    tracemalloc.start()
    make(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_pieces_of_texts():
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["x", "añb", None, "", "long text", "y"], kind)[1:]
        for most in (1, 4, 100):
            got = list(_common.text_pieces(column, most))
            assert [x for *_, texts in got for x in texts] == _common.as_bytes(column)
            assert [(a, b) for a, b, _ in got] == list(_common.pieces(map(len, _common.as_bytes(column)), most))
    assert not list(_common.text_pieces(pa.array([], pa.string()), 4))
