"""Rows that tie in the order of ``one``: whatever the order in the file, the same row is kept, and it is one that the SQL may keep."""

import duckdb
import pandas as pd
import pytest

from helixspark.plans import registry


def tables(folder, turned: bool):
    lines = [(10 + p, p, 7 + k, 2, 5.0 + k, 0.02 * k + 0.01 * p, 0.01 * k, t) for t in "ANR" for p in range(4) for k in range(3)]
    names = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_discount l_tax l_returnflag".split()
    folder.mkdir()
    pd.DataFrame(lines[:: -1 if turned else 1], columns=names).astype({"l_linenumber": "int32"}).to_parquet(folder / "lineitem.parquet")
    pd.DataFrame([(p, 20 + p) for p in range(4)], columns=["p_partkey", "p_size"]).astype({"p_size": "int32"}).to_parquet(folder / "part.parquet")
    return folder


def rows(spark, name, folder):
    df = registry.QUERIES[name](spark, str(folder))
    return df.columns, sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["ldsc_pair_join", "fusion_merge", "v_snp"])
def test_ties_are_settled(spark, tmp_path, name):
    a, b = tables(tmp_path / "a", False), tables(tmp_path / "b", True)
    columns, got = rows(spark, name, a)
    assert got and rows(spark, name, b)[1] == got
    # With the kept rows alone, which leave nothing open, the SQL gives the same.
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{a}/part.parquet'")
    c.sql(f"create view lineitem as select * from '{a}/lineitem.parquet' where l_suppkey = 7")
    want = c.sql(f"select {', '.join(columns)} from ({registry.SQL[name]}) x").fetchall()
    assert sorted(want) == got
