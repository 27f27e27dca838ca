"""Exact repeats of short lines go where they are asked to."""

from helixspark.llm import line_dedup


def test_short_lines(spark, tmp_path):
    docs = [(1, "short\n\nown\n short\t"), (2, "short\n" + "y" * 40 + "\n\nshort"), (3, None), (None, "short"), (0, "other\n" + "y" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.dropped for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: [], 1: [3], 2: [0, 1, 3], 3: [], None: []}
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, short=True).collect()}
    assert out == {0: docs[4][1], 1: "short\n\nown", 2: "", 3: None, None: "short"}
