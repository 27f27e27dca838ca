"""Paired globs and the sinks of simulations."""

import pytest

from helixspark.sources import readers


def test_annotations_meet_their_own_files_frequencies(spark, tmp_path):
    head = "CHR\tBP\tSNP\tCM\tbase\n"
    (tmp_path / "a.1.annot").write_text(head + "1\t5\trs1\t0\t1\n1\t6\trs2\t0\t0\n")
    (tmp_path / "a.2.annot").write_text(head + "2\t5\trs3\t0\t1\n")
    (tmp_path / "f.1.frq").write_text("SNP\tMAF\nrs1\t0.3\nrs2\t0.01\n")
    # rs1 again, in the other chromosome's file: not its frequency.
    (tmp_path / "f.2.frq").write_text("SNP\tMAF\nrs3\t0.2\nrs1\t0.4\n")
    got = readers.read_annotations(spark, f"{tmp_path}/a.*.annot", f"{tmp_path}/f.*.frq").collect()
    assert sorted((r.SNP, r.base, r.MAF) for r in got) == [("rs1", 1, 0.3), ("rs3", 1, 0.2)]
    assert "CM" not in got[0] and readers.read_annotations(spark, f"{tmp_path}/a.*.annot").count() == 3
    (tmp_path / "f.3.frq").write_text("SNP\tMAF\n")
    with pytest.raises(ValueError, match="2 files"):
        readers.read_annotations(spark, f"{tmp_path}/a.*.annot", f"{tmp_path}/f.*.frq")


def test_simulation_sinks(spark, tmp_path):
    rows = [(1, "a", "rs1", 0.5), (1, "b", "rs1", -0.5), (2, "a", "rs1", 1.5), (2, "a", "rs2", None)]
    readers.write_simulated(spark.createDataFrame(rows, "replicate int, trait string, SNP string, Z double"), f"{tmp_path}/sim")
    back = spark.read.option("sep", "\t").option("header", True).schema("SNP string, Z double, replicate int, trait string").csv(f"{tmp_path}/sim")
    assert sorted(map(str, back.select("replicate", "trait", "SNP", "Z").collect())) == sorted(map(str, spark.createDataFrame(rows, "replicate int, trait string, SNP string, Z double").collect()))
    assert all(x.suffix == ".gz" for x in tmp_path.glob("sim/*/*/part*"))
    readers.write_covariance(spark, [[1.0, 0.2], [0.2, 2.0]], ["a", "b"], f"{tmp_path}/cov")
    assert {(r.trait1, r.trait2): r.value for r in spark.read.parquet(f"{tmp_path}/cov").collect()} == {("a", "a"): 1.0, ("a", "b"): 0.2, ("b", "a"): 0.2, ("b", "b"): 2.0}
