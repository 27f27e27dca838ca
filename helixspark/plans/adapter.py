"""The test tables seen as association data: one SQL text for each relation, which Spark and other engines both run."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from helixspark.functions.linalg import CovStruct

A1 = "substr('ACGT', cast({k} % 4 + 1 as int), 1)"
A2 = "substr('ACGT', cast(({k} + 1 + {k} % 3) % 4 + 1 as int), 1)"

TEXT = {
    "ref": f"""
select concat('rs', cast(p_partkey as string)) as SNP, cast(p_partkey % 22 + 1 as int) as CHR, p_partkey * 1000 as BP, cast(p_size as double) / 100 as MAF,
       {A1.format(k="p_partkey")} as A1, {A2.format(k="p_partkey")} as A2, cast(p_size * 7 + p_partkey % 13 as double) / 5 as L2, cast(1 + p_partkey % 7 as double) as wLD
from part""",
    "raw": f"""
select l_orderkey, l_linenumber, l_returnflag as trait, concat('rs', cast(l_partkey as string)) as SNP,
       case when l_orderkey % 97 = 0 then 'N' when l_linenumber % 2 = 0 then {A2.format(k="l_partkey")} else lower({A1.format(k="l_partkey")}) end as A1,
       case when l_linenumber % 2 = 0 then {A1.format(k="l_partkey")} else {A2.format(k="l_partkey")} end as A2,
       (l_discount - 0.045) * (1 + l_linenumber) / 10 as effect, 0.011 + l_tax / 2 as SE,
       case when l_orderkey % 41 = 0 then null when l_orderkey % 50 = 0 then concat(cast(l_linenumber + 2 as string), 'e-308') else concat('0.', lpad(cast(cast(l_quantity as int) as string), 3, '0')) end as P,
       cast(5000 + l_suppkey * 10 as double) as N, 0.5 + l_discount * 5 as INFO, cast(l_quantity as double) / 100 as MAF,
       concat(repeat('+', 4), repeat('?', cast(l_linenumber as int))) as DIRECTION
from lineitem""",
    "one": "select * from (select r.*, row_number() over (partition by trait, SNP order by l_orderkey, l_linenumber) as copy from {raw} r) x where copy = 1",
    "z": "select trait, SNP, N, effect / SE as Z, upper(A1) as A1 from {one} o",
    "ld": "select SNP, CHR, BP, L2, wLD from {ref} r",
    "wide": """
select r.SNP, r.CHR, r.BP, r.MAF, r.A1, r.A2, max(case when trait = 'A' then effect end) as beta_A, max(case when trait = 'A' then SE end) as se_A,
       max(case when trait = 'N' then effect end) as beta_N, max(case when trait = 'N' then SE end) as se_N, max(case when trait = 'R' then effect end) as beta_R, max(case when trait = 'R' then SE end) as se_R
from {one} o join {ref} r on o.SNP = r.SNP where r.MAF > 0.01 group by r.SNP, r.CHR, r.BP, r.MAF, r.A1, r.A2 having count(distinct trait) = 3""",
    "fusion": """
select trait, concat('/data/weights/', trait, 'x/', cast(l_orderkey % 5 as string), '.wgt') as FILE, concat('g', cast(l_orderkey % 701 as string)) as ID, effect / SE as TWAS_Z, INFO / 10 + 0.01 as HSQ,
       cast(l_linenumber % 5 as double) / 4 as PERM_PV, cast(1000 as double) as PERM_N
from {one} o""",
    "annot": "select SNP, CHR, MAF, cast(1 as double) as base, cast(CHR % 2 as double) as odd, cast(case when L2 > 30 then 1 else 0 end as double) as dense, L2 from {ref} r",
}


#: As Spark runs them. The order of ``one`` leaves rows tied that share order, line, part and flag; which of them SQL keeps is
#: open, and may change from run to run. Here the columns that the rest derive from settle it, so every run keeps the same row.
SETTLED = TEXT | {"one": TEXT["one"].replace("l_orderkey, l_linenumber)", "l_orderkey, l_linenumber, effect, SE, N, MAF)")}


def text(name: str, relations: dict[str, str] = TEXT) -> str:
    """The relation as one nested query over the base tables."""
    return expand(relations[name], relations)


def expand(query: str, relations: dict[str, str] = TEXT) -> str:
    """A query over relations as one over base tables."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({text(m[1], relations)})", query)


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    full = re.sub(r"\b(from|join) (part|lineitem|events|embeddings)\b", r"\1 {\2}", expand(query, SETTLED))
    return spark.sql(full, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem", "events", "embeddings") if f"{{{t}}}" in full})


def rel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, f"select * from {{{name}}} q")


def literal_covstruct(names: tuple[str, ...] = ("A", "N", "R")) -> CovStruct:
    """Fixed values of a benchmark generator: correlations .35, V of 1e-4, intercepts 1.05 and .02."""
    k = len(names)
    s, i = np.full((k, k), 0.35), np.full((k, k), 0.02)
    np.fill_diagonal(s, 1)
    np.fill_diagonal(i, 1.05)
    return CovStruct(s, 1e-4 * np.eye(k * (k + 1) // 2), i, list(names))
