"""Mixing meets its targets where rates are clipped."""

import random

import numpy as np
import pytest

from helixspark.llm import mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(12)
    vocabulary = {d: [f"{d}{i}" for i in range(12)] + [f"all{i}" for i in range(12)] for d in ("a", "b", "c", "d")}
    kinds = {"a": (1, 0), "b": (0, 0), "c": (1, 1), "d": (0, 1)}
    picked = [rng.choices("abcd", (40, 30, 20, 10))[0] for _ in range(600)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary[d]) for _ in range(int(rng.paretovariate(0.9) * 4) % 3000 + 1))) for i, d in enumerate(picked)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, *kinds[d]) for i, d in enumerate(picked) if i % 2], "doc_id long, quality int, toxic int")
    want = np.array([mixing.TARGETS[x] for x in sorted(mixing.TARGETS)])
    for least in (0.0, 1.0):
        got = mixing.mix(docs, labels, mixing.TARGETS, least).toPandas()
        p = np.stack(got.domain_posterior) * got.n_words.to_numpy()[:, None] * got.rate.to_numpy()[:, None]
        assert np.allclose(p.sum(0) / p.sum(), want, rtol=0, atol=3e-6)
        assert (got.rate >= least).all() and (least or (got.rate == 0).any())
        assert least or p.sum() == pytest.approx(got.n_words.sum(), rel=1e-5)
