"""Cleaning of association files: munge (z scores for LD-score regression) and sumstats (effects for per-variant models).

Each operator is one plan: a join with the reference, one aggregate for the odds-ratio test, and column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions import expr

ACGT = "('A', 'C', 'G', 'T')"
AMBIGUOUS = "concat(A1, A2) in ('AT', 'TA', 'CG', 'GC')"
FLIPPED = "(A1_ref <> A1 and A1_ref = A2)"
BAD_A1 = "not (A1_ref = A1 or A1_ref = A2)"
BAD_A2 = "not (A2_ref = A1 or A2_ref = A2)"


def allele(c: str) -> str:
    """Upper-case allele, or null for anything but A, C, G, T."""
    return f"case when upper({c}) in {ACGT} then upper({c}) end"


def folded(maf: str) -> str:
    return f"case when {maf} <= 0.5 then {maf} else 1 - {maf} end"


def variance(maf: str) -> str:
    return f"(2 * {maf} * (1 - {maf}))"


def direction_ok(c: str) -> str:
    return f"(length({c}) - length(replace({c}, '?', ''))) < 0.5 * length({c})"


def logistic(effect: str, se: str, var: str) -> tuple[str, str]:
    """Effect and SE of a logistic model in units of the liability's standard deviation."""
    scale = f"sqrt({effect} * {effect} * {var} + pi() * pi() / 3)"
    return f"({effect} / {scale})", f"({se} / {scale})"


def scaled(mode: str) -> tuple[str, str]:
    """Effect and SE by kind of study, from z, effect, SE, N and varSNP."""
    if mode == "ols":
        return "(z / sqrt(N * varSNP))", "abs((z / sqrt(N * varSNP)) / z)"
    if mode == "linprob":
        return logistic("(z / sqrt((N / 4) * varSNP))", "(1 / sqrt((N / 4) * varSNP))", "varSNP")
    if mode == "se_logit":
        return logistic("effect", "SE", "varSNP")
    if mode == "or_se":
        return logistic("effect", "(SE / exp(effect))", "varSNP")
    raise ValueError(f"unknown mode {mode}")


def drop_all_duplicates(df: DataFrame, key: str = "SNP") -> DataFrame:
    """Rows whose key occurs once. Counted with map-side sums, so a hot key is no burden."""
    once = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n = 1").select(key)
    return df.join(once, key, "left_semi")


def with_reference(df: DataFrame, ref: DataFrame, *ref_columns: str) -> DataFrame:
    """Inner join on SNP; the reference's columns get the suffix ``_ref``."""
    return df.join(ref.select("SNP", *(F.col(c).alias(f"{c}_ref") for c in ("A1", "A2", *ref_columns))), "SNP")


def detect_odds(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Effects of a file (or of each group) whose median rounds to 1 are odds ratios and become logarithms."""
    median = df.groupBy(*by).agg(F.expr("rint(percentile(effect, 0.5)) = 1").alias("odds"))
    both = df.join(F.broadcast(median), list(by)) if by else df.crossJoin(F.broadcast(median))
    return both.withColumn("effect", F.expr("case when odds then case when effect > 0 then ln(effect) end else effect end"))


def numeric_p(df: DataFrame) -> DataFrame:
    """P as a double beside its text."""
    return df.withColumns({"P_text": F.col("P").cast("string"), "P": F.col("P").cast("string").try_cast("double")})


def z_column(p: str = "P", text: str = "P_text", sign: str = "effect") -> str:
    """Signed z of a P; null outside 0 to 1 and for a P of 0, which has no finite z."""
    return f"case when {p} < 0 or {p} > 1 then null when {p} < 1e-307 then {expr.tiny_z(text, sign)} else {expr.p_to_z(p, sign)} end"


def munge(df: DataFrame, ref: DataFrame, by: tuple[str, ...] = (), info: float = 0.9, maf: float = 0.01) -> DataFrame:
    """``by, SNP, N, Z, A1, A2``: cleaned z scores, signed by the reference's A1.

    Alleles outside A, C, G, T, missing P or effect, mismatching alleles, low INFO or MAF (where there is one) go. A P outside
    0 to 1, or of 0, gives a null Z (``munge_report`` counts the former).
    """
    x = with_reference(numeric_p(df).withColumns({"A1": F.expr(allele("A1")), "A2": F.expr(allele("A2"))}), ref)
    x = detect_odds(x.where("P is not null and effect is not null"), by)
    x = x.withColumn("effect", F.expr(f"case when {FLIPPED} then -effect else effect end"))
    x = x.where(f"not coalesce({BAD_A1}, true) and not coalesce({BAD_A2}, true)").withColumn("Z", F.expr(z_column()))
    if "INFO" in df.columns:
        x = x.where(f"INFO >= {info}")
    if "MAF" in df.columns:
        x = x.where(f"{folded('MAF')} >= {maf}")
    return x.select(*by, "SNP", "N", "Z", F.col("A1_ref").alias("A1"), F.col("A2_ref").alias("A2"))


def munge_report(df: DataFrame, ref: DataFrame, by: tuple[str, ...] = (), info: float = 0.9, maf: float = 0.01) -> DataFrame:
    """``by`` and counts of rows that each step of ``munge`` takes away, in its order, in one pass; ``odd_p`` counts P outside 0 to 1. An allele outside A, C, G, T counts with ``bad_a1``."""
    x = with_reference(numeric_p(df).withColumns({"A1": F.expr(allele("A1")), "A2": F.expr(allele("A2"))}), ref)
    steps = {"missing_p": "P is null", "missing_effect": "effect is null", "bad_a1": f"A1 is null or A2 is null or coalesce({BAD_A1}, true)", "bad_a2": f"coalesce({BAD_A2}, true)"}
    if "INFO" in df.columns:
        steps["low_info"] = f"coalesce(INFO < {info}, true)"
    if "MAF" in df.columns:
        steps["low_maf"] = f"coalesce({folded('MAF')} < {maf}, true)"
    before, counts = "false", []
    for name, gone in steps.items():
        counts.append(F.count_if(F.expr(f"not ({before}) and ({gone})")).alias(name))
        before = f"{before} or ({gone})"
    kept = F.count_if(F.expr(f"not ({before})")).alias("kept")
    return x.groupBy(*by).agg(F.count("*").alias("joined"), *counts, F.count_if(F.expr("P < 0 or P > 1")).alias("odd_p"), kept)


def mean_z(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, mean_z, suspicious``: mean of |beta / se|; over 5, effects or standard errors are likely of another scale."""
    return df.groupBy(*by).agg(F.avg(F.abs(F.col("beta") / F.col("se"))).alias("mean_z")).withColumn("suspicious", F.col("mean_z") > 5)


def sumstats(df: DataFrame, ref: DataFrame, mode: str, by: tuple[str, ...] = (), info: float = 0.6, maf: float = 0.01, keep_indels: bool = False, ambiguous: bool = True) -> DataFrame:
    """``by, SNP, CHR, BP, MAF, A1, A2, beta, se`` of the variants that pass, against the reference's A1."""
    ref = ref.where(f"MAF >= {maf}")
    if not ambiguous:
        ref = ref.where(f"not ({AMBIGUOUS})")
    x = drop_all_duplicates(df, "SNP") if not by else df.join(df.groupBy(*by, "SNP").agg(F.count("*").alias("__n")).where("__n = 1").drop("__n"), [*by, "SNP"], "left_semi")
    x = numeric_p(x)
    if not keep_indels:
        x = x.withColumns({"A1": F.expr(allele("A1")), "A2": F.expr(allele("A2"))})
    if "DIRECTION" in df.columns:
        x = x.where(direction_ok("DIRECTION"))
    if "MAF" in df.columns:
        x = x.withColumnRenamed("MAF", "MAF_own")
    x = with_reference(x, ref, "CHR", "BP", "MAF").where("P is not null and effect is not null")
    if "MAF" in df.columns:
        x = x.where("MAF_own is null or (MAF_own <> 0 and MAF_own <> 1)")
        own = f"coalesce({folded('MAF_own')}, MAF_ref)"
    else:
        own = "MAF_ref"
    x = detect_odds(x.withColumn("varSNP", F.expr(variance(own))), by).where("effect <> 0")
    x = x.withColumn("z", F.expr(z_column())).withColumn("flip", F.expr(f"case when {FLIPPED} then -1 else 1 end"))
    x = x.where(f"not coalesce({BAD_A1}, true) and not coalesce({BAD_A2}, true)")
    if "INFO" in df.columns:
        x = x.where(f"INFO >= {info}")
    beta, se = scaled(mode)
    x = x.select(*by, "SNP", F.col("CHR_ref").alias("CHR"), F.col("BP_ref").alias("BP"), F.col("MAF_ref").alias("MAF"), F.col("A1_ref").alias("A1"), F.col("A2_ref").alias("A2"), F.expr(f"flip * {beta}").alias("beta"), F.expr(se).alias("se"))
    return x.dropna(subset=["beta", "se"])


def listwise(df: DataFrame, traits: list[str], keys: tuple[str, ...] = ("SNP", "CHR", "BP", "MAF", "A1", "A2")) -> DataFrame:
    """Variants that every trait has, one row each with ``beta_<trait>, se_<trait>``: one shuffle for any number of traits."""
    wide = [F.max(F.when(F.col("trait") == t, F.col(c))).alias(f"{c}_{t}") for t in traits for c in ("beta", "se")]
    out = df.where(F.col("trait").isin(traits)).groupBy(*keys).agg(F.count_distinct("trait").alias("__n"), *wide)
    return out.where(F.col("__n") == len(traits)).drop("__n")


def qc_report(df: DataFrame, by: tuple[str, ...], checks: dict[str, str]) -> DataFrame:
    """Rows that meet each condition, in one pass."""
    return df.groupBy(*by).agg(*(F.sum(F.expr(f"case when {c} then 1 else 0 end")).alias(n) for n, c in checks.items()))


def fusion(files: list[DataFrame], names: list[str], n: list[float], binary: list[bool] | None = None, perm: bool = False) -> DataFrame:
    """TWAS files as one table ``Gene, Panel, HSQ, beta_<name>, se_<name>, ...``; the first file gives HSQ."""
    binary = binary or [True] * len(files)
    out = []
    for k, (x, name) in enumerate(zip(files, names, strict=True)):
        if perm:
            pv = "case when PERM_PV = 1 then (PERM_N - 1) / PERM_N when PERM_PV = 0 then 1 / PERM_N else PERM_PV end"
            x = x.withColumn("__p", F.expr(pv)).withColumn("__z", F.expr(expr.p_to_z("__p", "TWAS_Z")))
        else:
            x = x.withColumn("__z", F.col("TWAS_Z"))
        if binary[k]:
            beta, se = logistic(f"(__z / sqrt(({n[k]} / 4) * HSQ))", f"(1 / sqrt(({n[k]} / 4) * HSQ))", "HSQ")
        else:
            beta, se = f"(__z / sqrt({n[k]} * HSQ))", f"(1 / sqrt({n[k]} * HSQ))"
        panel = F.regexp_extract("FILE", r"([^/]+/[^/]+)$", 1)
        own = [F.col("HSQ")] if k == 0 else []
        x = x.select(F.col("ID").alias("Gene"), F.when(panel == "", F.col("FILE")).otherwise(panel).alias("Panel"), *own, F.expr(beta).alias(f"beta_{name}"), F.expr(se).alias(f"se_{name}")).dropna()
        out.append(x)
    return reduce(lambda a, b: a.join(b, ["Gene", "Panel"]), out).dropDuplicates()


def global_rank(df: DataFrame, chrom: str = "CHR", order: tuple[str, ...] = ("BP", "SNP")) -> DataFrame:
    """Place in genome order: ranks within chromosomes plus the chromosomes' offsets, so no task sorts the genome."""
    counts = df.groupBy(chrom).agg(F.count("*").alias("__c"))
    offsets = counts.select(chrom, F.coalesce(F.sum("__c").over(Window.orderBy(chrom).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(chrom).orderBy(*order)))
    return ranked.join(F.broadcast(offsets), chrom).withColumn("place", F.col("__r") + F.col("__o")).drop("__r", "__o")
