"""Odd P values, every header alias, separators and definitions: none stops a run."""

import pytest

from helixspark.operators import prep, sem
from helixspark.sources import readers


def test_odd_p(spark):
    ps = ["0", "0.0", "1", "1.5", "-0.1", "1e-320", "0e-400", "NA", None, "0.05"]
    raw = spark.createDataFrame([(f"rs{i}", "A", "G", 0.2, p, 9.0) for i, p in enumerate(ps)], "SNP string, A1 string, A2 string, effect double, P string, N double")
    ref = raw.select("SNP", "A1", "A2")
    got = {r.SNP: r.Z for r in prep.munge(raw, ref).collect()}
    assert set(got) == {f"rs{i}" for i, p in enumerate(ps) if p not in ("NA", None)}
    assert [got[f"rs{i}"] for i in (0, 1, 3, 4, 6)] == [None] * 5 and got["rs2"] == 0
    assert got["rs5"] == pytest.approx((2 * 320 * 2.302585092994046) ** 0.5) and got["rs9"] == pytest.approx(1.959964, abs=1e-5)
    r = prep.munge_report(raw, ref).first()
    assert (r.joined, r.missing_p, r.odd_p, r.kept) == (10, 2, 2, 8)


def test_aliases():
    for column, names in readers.ALIASES.items():
        for n in names:
            assert readers.resolve_aliases([n.lower()])[0].get(column) == n


@pytest.mark.parametrize("sep", [",", ";", "|", "\t", "  "])
def test_separators(spark, tmp_path, sep):
    rows = [["RS_ID", "REF", "ALT", '"SIGN"', "beta", "pval", "EFFECT_ALLELE_FREQUENCY"], ["rs1", '"a"', "g", "+-?", "0.1", "1e-320", "."], ["rs2", "C", "T", "++", "NA", "0.5", "0.3"]]
    (tmp_path / "x.txt").write_text("\n".join(sep.join(r) for r in rows) + "\n")
    got = {r.SNP: r for r in readers.read_sumstats(spark, str(tmp_path / "x.txt"), n=500).collect()}
    assert set(got) == {"rs1", "rs2"} and got["rs1"].A1 == "a" and got["rs1"].P == "1e-320" and got["rs1"].MAF is None and got["rs2"].effect is None
    assert got["rs1"].DIRECTION == "+-?" and got["rs2"].N == 500 and got["rs2"].MAF == 0.3


def test_munged_and_annotations(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("SNP\tN\tb\tse\tA1\tA2\nrs1\t5\t1.0\t0.5\tA\tG\n")
    assert readers.read_munged(spark, str(tmp_path / "m.tsv"), "t").first().Z == 2
    for c in (1, 2):
        (tmp_path / f"a{c}.annot").write_text(f"CHR\tBP\tSNP\tCM\tbase\n{c}\t1\trs{c}\t0\t1\n{c}\t2\trx{c}\t0\t1\n")
        (tmp_path / f"f{c}.frq").write_text(f"SNP\tMAF\nrs{c}\t0.2\nrx{c}\t0.01\n")
    got = readers.read_annotations(spark, f"{tmp_path}/*.annot", f"{tmp_path}/*.frq")
    assert {r.SNP for r in got.collect()} == {"rs1", "rs2"} and "CM" not in got.columns


def test_definitions():
    assert sem.arithmetic("sqrt(a)^2 + -b / 2", {"a": 3.0, "b": 4.0}) == pytest.approx(1)
    for text in ("a.__class__", "open('x')", "a if b else a", "[a][0]", "sqrt(a, b)", "c"):
        with pytest.raises(ValueError):
            sem.arithmetic(text, {"a": 3.0, "b": 4.0})
