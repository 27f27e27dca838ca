"""Stages of the pipeline: rows count by their own text, and the mixture meets its targets."""

import random

import numpy as np

import corpus_pipeline
from helixspark.llm import mixing


def test_mixing_stage_meets_targets(spark, tmp_path):
    rng = random.Random(14)
    kinds = [("a", 1, 0), ("b", 0, 0), ("c", 1, 1)]
    picked = [rng.choices(kinds, (60, 30, 10))[0] for _ in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(f"{d}{rng.randrange(9)}" for _ in range(rng.randrange(5, 60)))) for i, (d, _, _) in enumerate(picked)], "doc_id long, text string")
    spark.createDataFrame([(i, q, t) for i, (_, q, t) in enumerate(picked) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).toPandas()
    words = np.array([sum(len(t.split()) for t in out.text if t[0] == d) for d, _, _ in kinds], float)
    want = np.array([mixing.TARGETS[f"quality{q}_toxic{t}"] for _, q, t in kinds])
    assert set(out.doc_id) == set(range(4000))
    assert np.allclose(words / words.sum(), want / want.sum(), atol=0.01)


def test_rows_count_by_their_text(spark, tmp_path):
    rng = random.Random(15)
    say = lambda bad: " ".join(rng.choice("the of and that with from this".split()) for _ in range(9)) + " you grumble" * bad + "."
    docs = [(i, say(i % 4 == 0), "en", "s", 9) for i in range(600)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, say(1), "en", "s", 1), (None, say(0), "en", "s", 1), (1000, say(1), "en", "s", 2), (1000, say(0), "en", "s", 3), (1001, None, "en", "s", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    left = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(docs + odd, columns), str(tmp_path))
    assert sorted(map(tuple, left.where("doc_id is null or doc_id >= 1000").collect()), key=str) == sorted([odd[1], odd[3], odd[4]], key=str)
    assert left.where("doc_id < 600").count() == 450 and left.schema.simpleString() == spark.createDataFrame([], columns).schema.simpleString()

    twice = [(1, "one two three four five six", "en", "s", 1)] * 2 + [(2, None, "en", "s", 0)] * 2 + [(3, "another text of its own here", "en", "s", 1)]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, spark.createDataFrame(twice, columns), str(tmp_path)).collect()) == [1, 2, 3]
