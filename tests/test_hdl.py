"""The likelihood query takes every variant, and its pieces find what data were drawn with."""

import numpy as np
import pytest

from helixspark.operators import ldsc
from helixspark.plans import registry
from helixspark.plans.adapter import rel

SF = "/root/testdata/sf0.001"


def test_pieces_hold_every_variant(spark):
    ref = rel(spark, SF, "ref").toPandas().sort_values(["CHR", "BP", "SNP"])
    z = rel(spark, SF, "z").toPandas().set_index(["trait", "SNP"])
    got = {(r.piece, r.trait): r for r in registry._pieces(spark, SF).collect()}
    assert len(got) == ref.CHR.nunique() * 3
    for (piece, trait), r in got.items():
        some = ref[ref.CHR == piece]
        want = []
        for x in some.itertuples():
            hit = z.loc[(trait, x.SNP)] if (trait, x.SNP) in z.index else None
            want.append(0.0 if hit is None else (1 if hit.A1 == x.A1 else -1) * hit.Z / np.sqrt(hit.N))
        assert r.lam == pytest.approx(some.L2.tolist()) and r.b == pytest.approx(want)


def test_hdl_recovers(spark):
    rng = np.random.default_rng(5)
    n, m, ref = 3000.0, 2000.0, 1e6
    cov = np.array([[0.5, 0.2], [0.2, 0.4]])
    rows = []
    for piece in range(4):
        lam = rng.uniform(1, 30, 500)
        b = np.stack([rng.multivariate_normal([0, 0], cov / 4 / m * x * x + np.eye(2) * x / n) for x in lam])
        rows += [(piece, t, b[:, k].tolist(), lam.tolist()) for k, t in enumerate("AB")]
    got = ldsc.hdl(spark.createDataFrame(rows, "piece int, trait string, b array<double>, lam array<double>"), ["A", "B"], dict.fromkeys("AB", n), m, ref)
    assert got.s == pytest.approx(cov, abs=0.08) and np.diag(got.i) == pytest.approx([1, 1], abs=0.3)
