"""The queries of the engine and their SQL.

``shared`` queries run one text on Spark and as the oracle; the others run an operator and are held against SQL of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import expr
from helixspark.functions.linalg import CovStruct, vech_pairs
from helixspark.operators import ldsc as ld
from helixspark.operators import prep, scan, sem
from helixspark.plans.adapter import expand, literal_covstruct, rel, sql
from helixspark.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}
COV = literal_covstruct()
LOADINGS = np.sqrt(np.full(3, 0.35))
BLOCKS, M = 20, 2000.0
TRAITS = ["A", "N", "R"]


def r(x: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({x}, {digits}) + 0)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.expr(r(f"`{c}`", digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def shared(name: str, text: str) -> None:
    QUERIES[name] = lambda spark, sf: sql(spark, sf, text)
    SQL[name] = expand(text)


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = expand(oracle)
        return f

    return keep


# Row functions and filters.
shared("neff_double", "select trait, SNP, l_orderkey, l_linenumber, 2 * N as NEFF from {raw} q")
shared("maf_fold", f"select l_orderkey, l_linenumber, {r(prep.folded('(1 - MAF)'))} as maf from {{raw}} q")
shared("allele_normalize", f"select l_orderkey, l_linenumber, {prep.allele('A1')} as a1, {prep.allele('A2')} as a2 from {{raw}} q")
shared("direction_filter", f"select l_orderkey, l_linenumber, DIRECTION as direction from {{raw}} q where {prep.direction_ok('DIRECTION')}")
shared("strand_ambiguous", f"select SNP as snp, A1 as a1, A2 as a2 from {{ref}} q where not ({prep.AMBIGUOUS})")
shared("qc_missing", "select l_orderkey, l_linenumber, P as p from {raw} q where try_cast(P as double) is not null and effect is not null")
shared("var_snp", f"select SNP as snp, {r(prep.variance('MAF'), 8)} as var_snp from {{ref}} q")
shared("z_from_p", f"select l_orderkey, l_linenumber, {r(expr.p_to_z('tail', 'effect'))} as z from (select *, cast(l_linenumber as double) / 7.5 as tail from {{raw}} q) x")
shared("z_tiny_p", f"select l_orderkey, l_linenumber, {r(expr.tiny_z('P', 'effect'))} as z from {{raw}} q where P like '%e-308'")
for _mode, _name in (("ols", "sumstats_ols"), ("linprob", "sumstats_linprob"), ("se_logit", "sumstats_selogit"), ("or_se", "sumstats_or_se")):
    _b, _s = prep.scaled(_mode)
    shared(_name, f"select l_orderkey, l_linenumber, {r(_b, 8)} as beta, {r(_s, 8)} as se from (select *, effect / SE as z, {prep.variance('MAF')} as varSNP from {{raw}} q) x where effect <> 0")
shared("allele_flip", f"select l_orderkey, l_linenumber, {r(f'case when {prep.FLIPPED} then -effect else effect end')} as effect from (select q.*, f.A1 as A1_ref, f.A2 as A2_ref from (select l_orderkey, l_linenumber, SNP, effect, upper(A1) as A1, upper(A2) as A2 from {{raw}} z) q join {{ref}} f on q.SNP = f.SNP) x")
shared("allele_mismatch", f"select count(*) as n, cast(sum(case when coalesce({prep.BAD_A1}, true) then 1 else 0 end) as bigint) as bad_a1, cast(sum(case when coalesce({prep.BAD_A2}, true) then 1 else 0 end) as bigint) as bad_a2 from (select q.A1, q.A2, f.A1 as A1_ref, f.A2 as A2_ref from (select SNP, {prep.allele('A1')} as A1, {prep.allele('A2')} as A2 from {{raw}} z) q join {{ref}} f on q.SNP = f.SNP) x")
shared("info_filter", f"select l_orderkey, l_linenumber, {r('INFO')} as info from {{raw}} q where round(INFO, 6) >= 0.9")
shared("maf_filter", f"select l_orderkey, l_linenumber, {r('MAF')} as maf from {{raw}} q where {prep.folded('MAF')} >= 0.1")
shared("ref_maf_filter", f"select SNP as snp, {r('MAF')} as maf from {{ref}} q where MAF >= 0.05")
shared("frq_filter", f"select SNP as snp, {r('MAF')} as maf from {{ref}} q where MAF > 0.05 and MAF < 0.95")
shared("chisq_filter", f"select j.trait, j.SNP as snp, {r('j.Z * j.Z')} as chisq from {{z}} j join (select trait, greatest(0.001 * max(N), 80) as most from {{z}} y group by trait) c on j.trait = c.trait where j.Z * j.Z <= c.most")
shared("pnorm", f"select l_orderkey, l_linenumber, {r(expr.two_sided('(effect / SE)'))} as p from {{raw}} q")
for _df in (1, 2, 3, 4):
    shared("pchisq" if _df == 1 else f"pchisq_{_df}", f"select l_orderkey, l_linenumber, {r(expr.chi2_tail('power(effect / SE, 2)', _df))} as p from {{raw}} q")
shared("liability_scale", f"select k, {r('k * k * (1 - k) * (1 - k) / (0.5 * 0.5 * (exp(-z * z) / (2 * pi())))')} as factor from (select k, {expr.qnorm('(1 - k)')} as z from (select distinct cast(p_size as double) / 100 as k from part) x) y")
shared("chromosome_select", "select SNP as snp, CHR as chr from {ref} q where CHR in (" + ", ".join(map(str, readers.chromosomes("ODD"))) + ")")

# Joins and merges.
shared("munge_join", "select o.trait, o.SNP as snp, f.A1 as a1_x, upper(o.A1) as a1_y from {ref} f join {one} o on f.SNP = o.SNP")
shared("sumstats_join", f"select o.trait, f.SNP as snp, f.CHR as chr, f.BP as bp, {r('o.effect')} as effect from {{ref}} f join {{one}} o on f.SNP = o.SNP")
shared("ldsc_merge", f"select z.trait, z.SNP as snp, l.CHR as chr, l.BP as bp, {r('z.Z')} as z, {r('l.L2')} as l2, l.wLD as wld from {{z}} z join {{ld}} l on z.SNP = l.SNP")
shared("ldsc_pair_join", f"select a.trait as t1, b.trait as t2, a.SNP as snp, {r('case when a.A1 = b.A1 then a.Z * b.Z else -a.Z * b.Z end')} as zz from {{z}} a join {{z}} b on a.SNP = b.SNP and a.trait <= b.trait")
shared("annot_join", f"select a.SNP as snp, a.odd, a.dense, {r('f.MAF')} as maf from {{annot}} a join {{ref}} f on a.SNP = f.SNP where f.MAF > 0.05")
shared("semi_join", "select f.SNP as snp from {ref} f where f.SNP in (select SNP from {z} z where trait = 'R' and N > 5200)")
shared("anti_join", "select f.SNP as snp, f.CHR as chr from {ref} f where not exists (select 1 from {z} z where z.SNP = f.SNP and trait = 'R' and N > 5500)")
shared("z_correlation", f"select a.trait as t1, b.trait as t2, {r('corr(a.Z, b.Z)')} as rho from {{z}} a join {{z}} b on a.SNP = b.SNP and a.trait < b.trait group by a.trait, b.trait")


@query("union_chromosomes", "select SNP as snp, CHR as chr, case when CHR = 2 then null else BP end as bp from {ref} q")
def _union(spark: SparkSession, sf: str) -> DataFrame:
    ref = rel(spark, sf, "ref").select(F.col("SNP").alias("snp"), F.col("CHR").alias("chr"), F.col("BP").alias("bp"))
    return readers.union_chromosomes([ref.where(f"chr = {c}").drop(*(["bp"] if c == 2 else [])) for c in range(1, 23)])


_KEYED = "select l_orderkey, concat(SNP, ':', trait, cast(l_linenumber as string), cast(l_orderkey % 5 as string)) as SNP from {raw} q"


@query("drop_all_duplicates", f"select SNP as snp, l_orderkey from (select *, count(*) over (partition by SNP) as copies from ({_KEYED}) x) y where copies = 1")
def _dups(spark, sf):
    return prep.drop_all_duplicates(sql(spark, sf, _KEYED)).select(F.col("SNP").alias("snp"), "l_orderkey")


@query("or_detection", f"select o.trait, SNP as snp, {r('case when odds then ln(e) else e end')} as effect from (select *, case when trait = 'A' then exp(effect) else effect end as e from {{one}} q) o join (select trait, round_even(median(case when trait = 'A' then exp(effect) else effect end), 0) = 1 as odds from {{one}} q group by trait) m on o.trait = m.trait")
def _odds(spark, sf):
    x = rel(spark, sf, "one").withColumn("effect", F.expr("case when trait = 'A' then exp(effect) else effect end"))
    return rounded(prep.detect_odds(x, ("trait",)).select("trait", F.col("SNP").alias("snp"), "effect"))


_FIT = f"not coalesce({prep.BAD_A1}, true) and not coalesce({prep.BAD_A2}, true)"


@query("munge")
def _munge(spark, sf):
    out = prep.munge(rel(spark, sf, "one").select("trait", "SNP", "A1", "A2", "effect", "P", "N", "INFO", "MAF"), rel(spark, sf, "ref").select("SNP", "A1", "A2"), ("trait",))
    return rounded(out.select("trait", F.col("SNP").alias("snp"), F.col("N").alias("n"), F.col("Z").alias("z"), F.col("A1").alias("a1"), F.col("A2").alias("a2")))


_PREP = f"""
with c as (select o.trait, o.SNP, o.A1, o.A2, o.effect, o.SE, o.P as P_text, try_cast(o.P as double) as pv, o.N, o.INFO, o.MAF, o.DIRECTION, f.A1 as A1_ref, f.A2 as A2_ref, f.MAF as MAF_ref, f.CHR, f.BP
           from (select trait, SNP, {prep.allele('A1')} as A1, {prep.allele('A2')} as A2, effect, SE, P, N, INFO, MAF, DIRECTION from {{one}} o) o join {{ref}} f on o.SNP = f.SNP
           where try_cast(o.P as double) is not null and o.effect is not null)
"""
SQL["munge"] = expand(f"{_PREP} select trait, SNP as snp, N as n, {r(prep.z_column('pv', 'P_text', 'e'))} as z, A1_ref as a1, A2_ref as a2 from (select *, case when {prep.FLIPPED} then -effect else effect end as e from c) x where {_FIT} and INFO >= 0.9 and {prep.folded('MAF')} >= 0.01")
_BETA, _SE = prep.scaled("linprob")


@query("sumstats", f"{_PREP} select trait, SNP as snp, CHR as chr, BP as bp, A1_ref as a1, A2_ref as a2, {r(f'flip * {_BETA}', 8)} as beta, {r(_SE, 8)} as se from (select *, {prep.z_column('pv', 'P_text', 'effect')} as z, case when {prep.FLIPPED} then -1 else 1 end as flip, {prep.variance(f'coalesce({prep.folded('MAF')}, MAF_ref)')} as varSNP from c where effect <> 0 and MAF_ref >= 0.01 and {prep.direction_ok('DIRECTION')}) x where {_FIT} and INFO >= 0.6")
def _sumstats(spark, sf):
    out = prep.sumstats(rel(spark, sf, "one").select("trait", "SNP", "A1", "A2", "effect", "SE", "P", "N", "INFO", "MAF", "DIRECTION"), rel(spark, sf, "ref"), "linprob", ("trait",))
    return rounded(out.select("trait", F.col("SNP").alias("snp"), F.col("CHR").alias("chr"), F.col("BP").alias("bp"), F.col("A1").alias("a1"), F.col("A2").alias("a2"), "beta", "se"), 8)


@query("listwise_merge", "select SNP as snp, CHR as chr, BP as bp, " + ", ".join(f"{r(f'{c}_{t}')} as {c}_{t.lower()}" for t in TRAITS for c in ("beta", "se")) + " from {wide} w")
def _listwise(spark, sf):
    x = rel(spark, sf, "one").select("trait", "SNP", F.col("effect").alias("beta"), F.col("SE").alias("se")).join(rel(spark, sf, "ref").where("MAF > 0.01"), "SNP")
    out = prep.listwise(x, TRAITS)
    return rounded(out.select(F.col("SNP").alias("snp"), F.col("CHR").alias("chr"), F.col("BP").alias("bp"), *(F.col(f"{c}_{t}").alias(f"{c}_{t.lower()}") for t in TRAITS for c in ("beta", "se"))))


@query("qc_report", "select trait, cast(sum(case when P is null then 1 else 0 end) as bigint) as missing_p, cast(sum(case when INFO < 0.7 then 1 else 0 end) as bigint) as low_info, cast(sum(case when upper(A1) not in ('A', 'C', 'G', 'T') then 1 else 0 end) as bigint) as bad_allele from {raw} q group by trait")
def _qc(spark, sf):
    return prep.qc_report(rel(spark, sf, "raw"), ("trait",), {"missing_p": "P is null", "low_info": "INFO < 0.7", "bad_allele": f"upper(A1) not in {prep.ACGT}"})


shared("fusion_perm", f"select trait, ID as gene, {r('case when PERM_PV = 1 then (PERM_N - 1) / PERM_N when PERM_PV = 0 then 1 / PERM_N else PERM_PV end')} as pv from {{fusion}} q")
_FB, _FS = prep.logistic("(TWAS_Z / sqrt((5000.0 / 4) * HSQ))", "(1 / sqrt((5000.0 / 4) * HSQ))", "HSQ")
shared("fusion_beta", f"select trait, ID as gene, {r(_FB.replace('5000.0', '5000'))} as beta, {r(_FS.replace('5000.0', '5000'))} as se from {{fusion}} q where HSQ > 0")
_PANEL = "regexp_extract(FILE, '([^/]+/[^/]+)$', 1)"


@query("fusion_merge", f"select distinct a.ID as gene, {_PANEL.replace('FILE', 'a.FILE')} as panel, {r('a.HSQ')} as hsq, {r('a.TWAS_Z / sqrt(5000 * a.HSQ)')} as beta_x, {r('b.TWAS_Z / sqrt(6000 * b.HSQ)')} as beta_y from (select * from {{fusion}} q where trait = 'R') a join (select *, replace(FILE, 'Nx', 'Rx') as f2 from {{fusion}} q where trait = 'N') b on a.ID = b.ID and {_PANEL.replace('FILE', 'a.FILE')} = {_PANEL.replace('FILE', 'b.f2')}")
def _fusion(spark, sf):
    f = rel(spark, sf, "fusion")
    out = prep.fusion([f.where("trait = 'R'"), f.where("trait = 'N'").withColumn("FILE", F.expr("replace(FILE, 'Nx', 'Rx')"))], ["x", "y"], [5000, 6000], [False, False])
    return rounded(out.select(F.col("Gene").alias("gene"), F.col("Panel").alias("panel"), F.col("HSQ").alias("hsq"), "beta_x", "beta_y")).distinct()


# LD-score regression.
_FRAME = f"with z as (select * from {{z}} q), ld as (select * from {{ld}} q), {ld.stages(M, BLOCKS)}"


def _ldsc(name: str, final: str) -> None:
    @query(name, f"{_FRAME} {ld.filled(final, M, BLOCKS)}")
    def run(spark, sf):
        return ld.run(rel(spark, sf, "z"), rel(spark, sf, "ld"), final, M, BLOCKS)


_ldsc("ldsc", "select t1, t2, n, round(s, 5) + 0 as s, round(intercept, 5) + 0 as intercept, round(se, 5) + 0 as se, round(intercept_se, 5) + 0 as intercept_se from (" + ld.ESTIMATES + ") e")
_ldsc("ldsc_summary", "select t1, t2, n, round(mean_n1, 5) as mean_n1, round(mean_chi1, 6) as mean_chi1, round(agg1, 6) + 0 as agg1 from facts")
_ldsc("ldsc_blocks", "select t1, t2, block, round(a, 4) + 0 as a, round(b, 4) + 0 as b, round(d, 4) + 0 as d, round(e, 4) + 0 as e, round(f, 4) + 0 as f from blocks")
_ldsc("ldsc_jackknife", "select t1, t2, block, round(slope * 1000, 5) + 0 as slope, round(intercept, 5) + 0 as intercept from left_out")
_ldsc("ldsc_V", "select a1, a2, b1, b2, round(v, 5) + 0 as v from (" + ld.SAMPLING + ") e")
_ldsc("genetic_correlation", "select c.t1, c.t2, round(c.s / sqrt(abs(a.s * b.s)), 5) + 0 as rg from (" + ld.ESTIMATES + ") c join (" + ld.ESTIMATES + ") a on c.t1 = a.t1 and a.t1 = a.t2 join (" + ld.ESTIMATES + ") b on c.t2 = b.t1 and b.t1 = b.t2 where c.t1 <> c.t2")
shared("lambda_gc", f"select trait, {r('median(Z * Z) / 0.4549364')} as lambda_gc, {r('avg(Z * Z)')} as mean_chisq, {r('max(Z * Z)')} as max_chisq from {{z}} q group by trait")
shared("wls_regression", f"select trait, {r('(sw * sxy - sx * sy) / (sw * sxx - sx * sx)', 8)} as slope, {r('(sxx * sy - sx * sxy) / (sw * sxx - sx * sx)')} as intercept from (select z.trait, sum(1 / wLD) as sw, sum(L2 / wLD) as sx, sum(L2 * L2 / wLD) as sxx, sum(Z * Z / wLD) as sy, sum(L2 * Z * Z / wLD) as sxy from {{z}} z join {{ld}} l on z.SNP = l.SNP group by z.trait) x")


@query("block_assign", f"select SNP as snp, least({BLOCKS} - 1, cast(floor((row_number() over (order by CHR, BP, SNP) * {BLOCKS} - 1.0) / (count(*) over () - 1)) as bigint)) as block from {{ref}} q")
def _blocks(spark, sf):
    x = rel(spark, sf, "ref")
    n = x.count()
    return prep.global_rank(x).select(F.col("SNP").alias("snp"), F.expr(f"least({BLOCKS} - 1, (place * {BLOCKS} - 1) div {max(n - 1, 1)})").cast("long").alias("block"))


@query("annot_overlap", "select n1 as a, n2 as b, round(sum(v1 * v2), 6) as overlap from (select SNP, 'base' as n1, base as v1 from {annot} q union all select SNP, 'odd', odd from {annot} q union all select SNP, 'dense', dense from {annot} q) x join (select SNP as s2, 'base' as n2, base as v2 from {annot} q union all select SNP, 'odd', odd from {annot} q union all select SNP, 'dense', dense from {annot} q) y on x.SNP = y.s2 group by n1, n2")
def _overlap(spark, sf):
    return rounded(ld.annotation_overlap(rel(spark, sf, "annot"), ["base", "odd", "dense"]))


# Per-variant expressions and scans.
_V = scan.v_snp(COV, "conserv")
shared("v_snp", "select SNP as snp, " + ", ".join(f"{r(f'{_V[i][j]} * 1000000', 6)} as v{i}{j}" for i, j in vech_pairs(3)) + f" from (select *, {prep.variance('MAF')} as varSNP from {{wide}} w) x")
shared("s_full", "select SNP as snp, " + ", ".join(f"{r(c, 8)} as s{k}" for k, c in enumerate(scan.s_full(COV))) + f" from (select *, {prep.variance('MAF')} as varSNP from {{wide}} w) x")
shared("z_pre", "select SNP as snp, " + ", ".join(f"{r(c)} as z_{t.lower()}" for t, c in zip(TRAITS, scan.z_pre(COV), strict=True)) + " from {wide} w")
_SCAN_OUT = "SNP as snp, CHR as chr, BP as bp, round(est, 6) + 0 as est, round(se, 6) + 0 as se, round(z, 5) + 0 as z, round(pval, 6) + 0 as pval, round(q_snp, 4) + 0 as q_snp, q_snp_df, round(q_snp_pval, 6) + 0 as q_snp_pval"


@query("user_gwas_single_factor", f"select {_SCAN_OUT} from ({scan.single_factor_sql(COV, LOADINGS, '{wide}')}) s")
def _single(spark, sf):
    return scan.single_factor_scan(rel(spark, sf, "wide"), COV, LOADINGS).selectExpr(*_SCAN_OUT.split(", round(")[0].split(", "), *(f"round({x}" for x in _SCAN_OUT.replace(", q_snp_df", "").split(", round(")[1:]), "q_snp_df")


shared("local_srmd", f"select trait, {r('sqrt(avg(power((effect - SE) / (sqrt(MAF) * sqrt(INFO)), 2)))')} as local_srmd from {{raw}} q group by trait")
shared("lsrmr", f"select trait, {r('sqrt(avg(Z * Z))')} as lsrmr, {r('cast(0.05 as double) / count(*)', 8)} as bonferroni from {{z}} q group by trait")
shared("top_residual", f"select trait, SNP as snp, {r('Z')} as z from (select *, row_number() over (partition by trait order by abs(Z) desc, SNP) as nth from {{z}} q) x where nth = 1")
shared("n_factors", f"select trait, cast(coalesce(min(case when v < sim then n end) - 1, 5) as bigint) as n_factors from (select trait, n, {r('Z')} as v, 5.0 - n * 0.1 as sim from (select trait, Z, row_number() over (partition by trait order by Z desc, SNP) as n from {{z}} q) y where n <= 40) x group by trait")
shared("eigen_quantile", f"select trait, {r('quantile')} as quantile from (select trait, percentile_ as quantile from (select trait, median(Z) as percentile_ from {{z}} q group by trait) y) x")


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    return spark.createDataFrame([tuple(x.values()) for x in rows], ", ".join(f"{k} {kinds[type(v)]}" for k, v in rows[0].items()))


# Models: driver-side algebra on small matrices, or Arrow batches; held against other derivations in the tests.
@query("common_factor", "select 'F1' as lhs, '=~' as op, t as rhs, round(sqrt(0.35), 6) as est from (values ('A'), ('N'), ('R')) v(t)")
def _common(spark, sf):
    return rounded(_frame(spark, [{k: x[k] for k in ("lhs", "op", "rhs", "est")} for x in sem.common_factor(COV)["results"] if x["op"] == "=~"]))


FOUR = literal_covstruct(("A", "N", "R", "O"))


@query("usermodel")
def _user(spark, sf):
    return _frame(spark, sem.usermodel(FOUR, "F1 =~ A + N\nF2 =~ R + O\nF1 ~~ x*F2\ntwice := 2*x")["results"])


@query("usermodel_ml")
def _user_ml(spark, sf):
    return _frame(spark, sem.usermodel(FOUR, "F1 =~ A + N + R + O", "ML")["results"])


@query("rg_model")
def _rg(spark, sf):
    rg, v = sem.rg_model(COV)
    return _frame(spark, [{"t1": TRAITS[i], "t2": TRAITS[j], "rg": float(rg[i, j]), "se": float(np.sqrt(max(v[n, n], 0)))} for n, (i, j) in enumerate(vech_pairs(3))])


@query("common_factor_gwas")
def _cf_gwas(spark, sf):
    return scan.common_factor_gwas(rel(spark, sf, "wide"), COV)


@query("user_gwas")
def _user_gwas(spark, sf):
    return scan.user_gwas(rel(spark, sf, "wide"), COV, "F1 =~ A + N + R\nF1 ~ SNP")


@query("enrich")
def _enrich(spark, sf):
    half = CovStruct(COV.s * 0.5, COV.v, COV.i, TRAITS)
    return _frame(spark, sem.enrich(COV, {"base": COV, "half": half}, "F1 =~ NA*A + N + R\nF1 ~~ 1*F1", [(t, "~~", t) for t in TRAITS], {"base": 1.0, "half": 0.25}))


@query("q_trait")
def _q_trait(spark, sf):
    return _frame(spark, sem.q_trait(FOUR, {"F1": TRAITS}, ["O"]))


@query("s_ldsc")
def _s_ldsc(spark, sf):
    x = rel(spark, sf, "z").where("trait = 'R'").join(rel(spark, sf, "annot"), "SNP").join(rel(spark, sf, "ld").select("SNP", "BP", "wLD"), "SNP")
    n, mean = x.agg(F.count("*"), F.avg("N")).first()
    rows = prep.global_rank(x).select(F.array(*(F.col(a) * F.col("L2") * F.col("N") / mean for a in ("base", "odd", "dense")), F.lit(1.0)).alias("x"), (F.col("Z") ** 2).alias("y"), (1 / F.sqrt("wLD")).alias("w"), F.expr(f"least({BLOCKS} - 1, (place * {BLOCKS} - 1) div {n - 1})").alias("block"))
    over = {(q.a, q.b): q.overlap for q in ld.annotation_overlap(rel(spark, sf, "annot"), ["base", "odd", "dense"]).collect()}
    names = ["base", "odd", "dense"]
    counts = np.array([over[a, a] for a in names])
    got = ld.stratified(rows, counts, np.array([[over[a, b] / over[b, b] for b in names] for a in names]), BLOCKS)
    return _frame(spark, [{"annotation": a, "tau": float(got["tau"][k]), "s": float(got["s"][k]), "tau_se": float(np.sqrt(got["v_tau"][k, k])), "prop": float(got["prop"][k])} for k, a in enumerate(names)])


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    """``piece, trait, b, lam``: all variants of a chromosome by place, each trait's effects signed by the reference's allele, 0 where it lacks one."""
    every = rel(spark, sf, "ref").select("CHR", "BP", "SNP", "L2", F.col("A1").alias("ref_A1")).crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in TRAITS], "trait string")))
    effect = F.when(F.col("A1") == F.col("ref_A1"), 1.0).otherwise(-1.0) * F.col("Z") / F.sqrt("N")
    x = every.join(rel(spark, sf, "z"), ["SNP", "trait"], "left").groupBy(F.col("CHR").alias("piece"), "trait")
    return x.agg(F.sort_array(F.collect_list(F.struct("BP", "SNP", F.coalesce(effect, F.lit(0.0)).alias("b"), "L2"))).alias("a")).select("piece", "trait", F.col("a.b").alias("b"), F.col("a.L2").alias("lam"))


@query("hdl")
def _hdl(spark, sf):
    got = ld.hdl(_pieces(spark, sf), TRAITS, dict.fromkeys(TRAITS, 5500.0), M, 1000.0)
    return _frame(spark, [{"t1": TRAITS[i], "t2": TRAITS[j], "s": float(got.s[i, j]), "intercept": float(got.i[i, j])} for i, j in vech_pairs(3)])


@query("sim_ldsc")
def _sim(spark, sf):
    return ld.simulate(spark, rel(spark, sf, "ld"), COV.s, [1e4, 1e4, 1e4], 1e5, np.eye(3), 1)


@query("pa_ldsc")
def _pa(spark, sf):
    return ld.parallel_analysis(spark, COV, 200)


_NS = " union all ".join(f"select SNP as key, {n} as place, {r(c, 8)} as value from (select *, 2 * MAF * (1 - MAF) as var from {{wide}} w) x" for n, c in enumerate(["var", *(f"var * beta_{t}" for t in TRAITS), "1.0", "0.35", "0.35", "1.0", "0.35", "1.0"]))


@query("add_snps", _NS)
def _add(spark, sf):
    x = scan.with_matrices(rel(spark, sf, "wide"), COV, "conserv")
    return rounded(x.select(F.col("SNP").alias("key"), F.posexplode("s_full").alias("place", "value")), 8)


@query("add_genes", "select a.ID as gene, " + _PANEL.replace("FILE", "a.FILE") + f" as panel, {r('a.HSQ', 8)} as s0, {r('a.HSQ * a.TWAS_Z / sqrt(5000 * a.HSQ)', 8)} as s1, {r('a.HSQ * b.TWAS_Z / sqrt(6000 * b.HSQ)', 8)} as s2, {r('power(1.05 * a.HSQ * abs(1 / sqrt(5000 * a.HSQ)), 2) * 1000', 8)} as v00 from (select * from {{fusion}} q where trait = 'R') a join (select *, replace(FILE, 'Nx', 'Rx') as f2 from {{fusion}} q where trait = 'N') b on a.ID = b.ID and {_PANEL.replace('FILE', 'a.FILE')} = {_PANEL.replace('FILE', 'b.f2')} where a.TWAS_Z <> 0 and b.TWAS_Z <> 0 group by all")
def _add_genes(spark, sf):
    f = rel(spark, sf, "fusion").where("TWAS_Z <> 0")
    genes = prep.fusion([f.where("trait = 'R'"), f.where("trait = 'N'").withColumn("FILE", F.expr("replace(FILE, 'Nx', 'Rx')"))], ["R", "N"], [5000, 6000], [False, False])
    x = scan.with_matrices(genes, literal_covstruct(("R", "N")), "conserv", "HSQ")
    return rounded(x.select(F.col("Gene").alias("gene"), F.col("Panel").alias("panel"), *(F.col("s_full")[i].alias(f"s{i}") for i in range(3)), (F.col("v_snp")[0] * 1000).alias("v00")), 8).distinct()


@query("munge_report", f"""
with c as (select o.trait, o.P, o.effect, o.INFO, o.MAF, upper(o.A1) as a1, upper(o.A2) as a2, f.A1 as r1, f.A2 as r2 from {{raw}} o join {{ref}} f on o.SNP = f.SNP),
d as (select trait, try_cast(P as double) as p, effect, INFO, case when MAF <= 0.5 then MAF else 1 - MAF end as maf,
             coalesce(r1 in (a1, a2), false) and a1 in ('A', 'C', 'G', 'T') and a2 in ('A', 'C', 'G', 'T') as ok1, coalesce(r2 in (a1, a2), false) as ok2 from c),
e as (select *, case when p is null then 1 when effect is null then 2 when not ok1 then 3 when not ok2 then 4 when INFO < 0.9 then 5 when maf < 0.1 then 6 else 7 end as step from d)
select trait, count(*) as joined, cast(sum(case when step = 1 then 1 else 0 end) as bigint) as missing_p, cast(sum(case when step = 2 then 1 else 0 end) as bigint) as missing_effect, cast(sum(case when step = 3 then 1 else 0 end) as bigint) as bad_a1,
       cast(sum(case when step = 4 then 1 else 0 end) as bigint) as bad_a2, cast(sum(case when step = 5 then 1 else 0 end) as bigint) as low_info, cast(sum(case when step = 6 then 1 else 0 end) as bigint) as low_maf, cast(sum(case when p < 0 or p > 1 then 1 else 0 end) as bigint) as odd_p, cast(sum(case when step = 7 then 1 else 0 end) as bigint) as kept from e group by trait""")
def _report(spark, sf):
    return prep.munge_report(rel(spark, sf, "raw").select("trait", "SNP", "A1", "A2", "effect", "P", "INFO", "MAF"), rel(spark, sf, "ref"), ("trait",), 0.9, 0.1)


@query("mean_z", f"select trait, {r('avg(abs(effect / SE))')} as mean_z, avg(abs(effect / SE)) > 5 as suspicious from {{raw}} q group by trait")
def _mean_z(spark, sf):
    return rounded(prep.mean_z(rel(spark, sf, "raw").select("trait", F.col("effect").alias("beta"), F.col("SE").alias("se")), ("trait",)))


@query("multi_snp")
def _multi(spark, sf):
    top = rel(spark, sf, "wide").orderBy("SNP").limit(3).toPandas()
    got = sem.multi_snp(COV, top[[f"beta_{t}" for t in TRAITS]].to_numpy(), top[[f"se_{t}" for t in TRAITS]].to_numpy(), top.MAF.to_numpy(), 0.2 + 0.8 * np.eye(len(top)))
    return _frame(spark, [{"row": got.names[i], "col": got.names[j], "s": float(got.s[i, j]), "v": float(got.v[n, n])} for n, (i, j) in enumerate(vech_pairs(len(got.names)))])


@query("summary_gls", "select 'b0' as term, 1.5 as beta union all select 'b1', 0.5")
def _gls(spark, sf):
    got = sem.summary_gls(np.array([2.0, 2.5, 3.0]), np.diag([1.0, 2.0, 1.0]), np.array([1.0, 2.0, 3.0]))
    return rounded(_frame(spark, [{"term": x["term"], "beta": x["beta"]} for x in got]))


@query("gls_bands")
def _bands(spark, sf):
    return _frame(spark, sem.gls_bands(np.array([2.0, 2.5, 3.1]), np.eye(3) * 0.01, np.array([1.0, 2.0, 3.0])))


@query("index_s", "select * from (values (1, 'A', 'A'), (2, 'N', 'A'), (3, 'R', 'A'), (4, 'N', 'N'), (5, 'R', 'N'), (6, 'R', 'R')) v(place, row, col)")
def _index(spark, sf):
    return _frame(spark, sem.index_s(TRAITS))


@query("write_model")
def _write(spark, sf):
    return _frame(spark, [{"model": sem.write_model(np.array([[0.8, 0.1], [0.7, 0.2], [0.1, 0.9]]), TRAITS, 0.3)}])
