"""The engine against plain derivations, invariants and, for every query with SQL, another engine."""

import gzip
import math
import statistics

import duckdb
import numpy as np
import pandas as pd
import pytest

from helixspark.functions import expr
from helixspark.functions.linalg import CovStruct, chi2_tail, nearest_positive, unvech, vech
from helixspark.operators import ldsc, prep, scan, sem
from helixspark.plans import registry
from helixspark.plans.adapter import literal_covstruct, rel
from helixspark.sources import readers

SF = "/root/testdata/sf0.001"
TABLES = "part lineitem".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def values(df):
    cell = lambda v: "" if pd.isna(v) else (f"{float(v):.5f}" if isinstance(v, (int, float, np.number)) else str(v))
    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(registry.SQL) & set(registry.QUERIES)))
def test_query_matches_sql(spark, duck, name):
    assert values(registry.QUERIES[name](spark, SF).toPandas()) == values(duck.sql(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_quantiles_and_tails(spark):
    ps = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.8, 0.99, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for p, z in df.selectExpr("p", expr.qnorm("p")).collect():
        assert z == pytest.approx(statistics.NormalDist().inv_cdf(p), abs=1e-7)
    for x, a, b, c in spark.createDataFrame([(v,) for v in (0.1, 1.0, 5.0, 20.0)], "x double").selectExpr("x", expr.two_sided("x"), expr.chi2_tail("x", 3), expr.chi2_tail("x", 4)).collect():
        assert a == pytest.approx(math.erfc(x / math.sqrt(2)), rel=2e-7)
        assert b == pytest.approx(chi2_tail(x, 3), rel=1e-6)
        assert c == pytest.approx(chi2_tail(x, 4), rel=1e-12)


def test_reader(spark, tmp_path):
    text = "snpid Allele1 allele2 beta se p n\nrs1 a g 0.1 0.02 1e-320 100\nrs2 C T . 0.02 0.5\n\nrs3 a t NA 0.1 0.2 7\n"
    with gzip.open(tmp_path / "x.gz", "wt") as f:
        f.write(text)
    rows = {r.SNP: r for r in readers.read_sumstats(spark, str(tmp_path / "x.gz")).collect()}
    assert rows["rs1"].P == "1e-320" and rows["rs1"].effect == 0.1 and rows["rs2"].N is None and rows["rs3"].effect is None
    assert readers.chromosomes("ODD") == list(range(1, 23, 2)) and readers.chromosomes([3]) == [3]
    with pytest.raises(ValueError):
        readers.resolve_aliases(["A1"], required=("SNP",))


def test_munge_and_sink(spark, tmp_path):
    ref = spark.createDataFrame([("rs1", "A", "G"), ("rs2", "C", "T"), ("rs3", "G", "A")], "SNP string, A1 string, A2 string")
    raw = spark.createDataFrame([("rs1", "a", "g", 0.5, "0.05", 10.0), ("rs2", "T", "C", 0.5, "0.05", 10.0), ("rs3", "C", "A", 0.5, "0.05", 10.0), ("rs9", "A", "G", 0.5, "0.05", 1.0)], "SNP string, A1 string, A2 string, effect double, P string, N double")
    out = prep.munge(raw, ref)
    got = {r.SNP: r.Z for r in out.collect()}
    assert got.keys() == {"rs1", "rs2"} and got["rs1"] == pytest.approx(1.959964, abs=1e-5) and got["rs2"] == -got["rs1"]
    readers.write_munged(out, str(tmp_path / "m"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "m")).count() == 2


def test_ldsc_against_loops(spark):
    z, ld = rel(spark, SF, "z"), rel(spark, SF, "ld")
    got = ldsc.ldsc(z, ld, ["A", "N"], 2000.0, blocks=10)
    zz, l2 = z.toPandas(), ld.toPandas()
    m, b = 2000.0, 10
    x = zz[zz.trait == "A"].merge(l2, on="SNP").sort_values(["CHR", "BP", "SNP"])
    x["chi"] = x.Z**2
    x = x[x.chi <= max(0.001 * x.N.max(), 80)]
    agg = min(max(m * (x.chi.mean() - 1) / (x.L2 * x.N).mean(), 0), 1)
    w = 1 / np.sqrt(2 * (1 + agg * x.N / m * np.maximum(x.L2, 1)) ** 2 * np.maximum(x.wLD, 1))
    w = (w / w.sum()).to_numpy()
    design, y = np.column_stack([x.L2, np.ones(len(x))]) * w[:, None], x.chi.to_numpy() * w
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    assert got.s[0, 0] == pytest.approx(coef[0] / x.N.mean() * m, rel=1e-8) and got.i[0, 0] == pytest.approx(coef[1], rel=1e-8)
    cuts = np.floor(np.linspace(1, len(x), b + 1)).astype(int)
    lo, hi = cuts[:-1] - 1, np.append(cuts[1:-1] - 1, len(x))
    out = [np.linalg.lstsq(np.delete(design, np.s_[i:j], 0), np.delete(y, np.s_[i:j]), rcond=None)[0] for i, j in zip(lo, hi, strict=True)]
    pseudo = b * coef - (b - 1) * np.array(out)
    assert got.v[0, 0] == pytest.approx(pseudo[:, 0].var(ddof=1) / b * (m / x.N.mean()) ** 2, rel=1e-6)
    swapped = ldsc.ldsc(z, ld, ["N", "A"], 2000.0, blocks=10)
    assert swapped.s[0, 0] == pytest.approx(got.s[1, 1]) and swapped.v[0, 0] == pytest.approx(got.v[2, 2])


def test_models():
    cov = literal_covstruct(("T1", "T2", "T3", "T4"))
    one = sem.common_factor(cov)
    assert all(r["est"] == pytest.approx(math.sqrt(0.35), abs=1e-7) for r in one["results"] if r["op"] == "=~")
    assert one["fit"]["chisq"] == pytest.approx(0, abs=1e-9)
    two = sem.usermodel(cov, "F1 =~ T1 + T2\nF2 =~ T3 + T4\nF1 ~~ x*F2\nd := 2*x", "ML")
    assert two["results"][-1]["est"] == pytest.approx(0.7, abs=1e-6)
    bad = np.array([[1.0, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    fixed = nearest_positive(bad, corr=True)
    assert np.linalg.eigvalsh(fixed).min() > 0 and np.allclose(np.diag(fixed), 1)
    assert np.allclose(unvech(vech(fixed), 3), fixed)
    rg, v = sem.rg_model(cov)
    assert rg[0, 1] == pytest.approx(0.35) and (np.linalg.eigvalsh(v) > -1e-12).all()
    assert "a" not in sem.write_model(np.eye(2), ["x", "y"], 0.5, fix_resid=False)


def test_derivatives():
    model = sem.Model.parse("F1 =~ a + b + c\nF1 ~ SNP\na ~~ b", ["SNP", "a", "b", "c"])
    c, p = model.compiled(), np.linspace(0.2, 0.9, model.count)[None]
    sigma, delta = sem.moments(c, p, 4, 5)
    for j in range(model.count):
        e = np.zeros_like(p)
        e[0, j] = 1e-6
        num = (sem.moments(c, p + e, 4, 5)[0] - sem.moments(c, p - e, 4, 5)[0])[0] / 2e-6
        assert np.allclose(vech(num), delta[0, :, j], atol=1e-7)


def test_scan_closed_form_equals_fit(spark):
    cov = literal_covstruct()
    wide = rel(spark, SF, "wide").limit(40)
    load = np.array([1.0, 1.0, 1.0])
    a = scan.single_factor_scan(wide, cov, load).toPandas().set_index("SNP").sort_index()
    b = scan.user_gwas(wide, cov, "F1 =~ A + N + R\nF1 ~ SNP", keep=[("F1", "~", "SNP")]).toPandas().set_index("SNP").sort_index()
    assert np.allclose(a.est, b.est, rtol=1e-5) and np.allclose(a.se, b.se, rtol=1e-5) and np.allclose(a.q_snp, b.q_snp, rtol=1e-5)


def test_simulation_recovers(spark):
    ld = spark.range(20_000).selectExpr("concat('rs', id) as SNP", "cast(id % 22 + 1 as int) as CHR", "id as BP", "cast(1 + id % 60 as double) as L2", "1D as wLD")
    cov = np.array([[0.4, 0.2], [0.2, 0.5]])
    z = ldsc.simulate(spark, ld, cov, [5e4, 5e4], 1e5, np.eye(2), seed=3).selectExpr("trait", "SNP", "N", "Z", "'A' as A1")
    got = ldsc.ldsc(z, ld, ["T1", "T2"], 1e5, blocks=50)
    assert np.all(np.abs(vech(got.s - cov)) < 4 * np.sqrt(np.diag(got.v)))


def test_streaming(spark, tmp_path):
    from helixspark.streaming import munge_arrivals

    ref = spark.createDataFrame([("rs1", "A", "G")], "SNP string, A1 string, A2 string")
    spark.createDataFrame([("t", "rs1", "A", "G", 0.2, "0.1", 5.0)], "trait string, SNP string, A1 string, A2 string, effect double, P string, N double").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("trait string, SNP string, A1 string, A2 string, effect double, P string, N double").parquet(str(tmp_path / "in"))
    munge_arrivals(spark, source, ref, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_covstruct():
    with pytest.raises(ValueError):
        CovStruct(-np.eye(2), np.eye(3), np.eye(2)).standardized()
    assert literal_covstruct().subset(["R", "A"]).names == ["R", "A"]
