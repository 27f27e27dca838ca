"""Readers and sinks: raw association files, LD scores, weights, counts, annotations, munged traits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = (".", "NA", "", "na", "Na", "nan", "NaN")

# Header aliases by canonical column.
ALIASES = {
    "SNP": ["SNP", "SNPID", "RSID", "RS_NUMBER", "RS_NUMBERS", "MARKERNAME", "ID", "PREDICTOR", "SNP_ID", "VARIANTID", "VARIANT_ID", "RSIDS", "RS_ID"],
    "A1": ["A1", "ALLELE1", "EFFECT_ALLELE", "INC_ALLELE", "REFERENCE_ALLELE", "EA", "REF"],
    "A2": ["A2", "ALLELE2", "ALLELE0", "OTHER_ALLELE", "NON_EFFECT_ALLELE", "DEC_ALLELE", "OA", "NEA", "ALT", "A0"],
    "effect": ["OR", "B", "BETA", "LOG_ODDS", "EFFECTS", "EFFECT", "SIGNED_SUMSTAT", "EST", "BETA1", "LOGOR"],
    "INFO": ["INFO", "IMPINFO"],
    "P": ["P", "PVALUE", "PVAL", "P_VALUE", "P-VALUE", "P.VALUE", "P_VAL", "GC_PVALUE", "WALD_P"],
    "N": ["N", "WEIGHT", "NCOMPLETESAMPLES", "TOTALSAMPLESIZE", "TOTALN", "TOTAL_N", "N_COMPLETE_SAMPLES", "SAMPLESIZE", "NEFF", "N_EFF", "N_EFFECTIVE", "SUMNEFF"],
    "MAF": ["MAF", "CEUAF", "FREQ1", "EAF", "FREQ1.HAPMAP", "FREQALLELE1HAPMAPCEU", "FREQ.ALLELE1.HAPMAPCEU", "EFFECT_ALLELE_FREQ", "FREQ.A1", "A1FREQ", "ALLELEFREQ", "EFFECT_ALLELE_FREQUENCY"],
    "Z": ["Z", "ZSCORE", "Z-SCORE", "ZSTATISTIC", "ZSTAT", "Z-STATISTIC"],
    "SE": ["STDERR", "SE", "STDERRLOGOR", "SEBETA", "STANDARDERROR", "STANDARD_ERROR"],
    "DIRECTION": ["DIRECTION", "DIREC", "DIRE", "SIGN"],
}


def resolve_aliases(header: list[str], overrides: dict[str, str] | None = None, required: tuple[str, ...] = ()) -> tuple[dict[str, str], list[str]]:
    """Upper-case header names by canonical column, and warnings. An override beats the exact name, which beats aliases."""
    names, found, notes = [h.upper() for h in header], {}, []
    for column, known in ALIASES.items():
        if overrides and column in overrides:
            if overrides[column].upper() not in names:
                raise ValueError(f"{column}: no column {overrides[column]}")
            hits = [overrides[column].upper()]
        elif column.upper() in names:
            hits = [column.upper()]
        else:
            hits = [n for n in names if n in known]
        if not hits and column == "effect" and "Z" in names:
            hits = ["Z"]
        if len(hits) > 1:
            notes.append(f"{column}: several columns ({', '.join(hits)}); the first is taken")
        if hits:
            found[column] = hits[0]
        elif column in required:
            raise ValueError(f"no column for {column}")
    for half in ("NEFFDIV2", "NEFF_HALF"):
        if half in names and "N" not in found:
            found["N_half"] = half
    return found, notes


def separator(header: str) -> str | None:
    """The character that parts a header's columns; None stands for runs of white space."""
    return next((c for c in ("\t", ",", ";", "|") if c in header and (c != "\t" or " " not in header.strip())), None)


def read_sumstats(spark: SparkSession, path: str, overrides: dict[str, str] | None = None, required: tuple[str, ...] = ("SNP",), n: float | None = None) -> DataFrame:
    """A file (gzip too) under canonical names. P stays text, other numbers are doubles, missing tokens null.

    Columns are parted by tabs, commas, semicolons, bars or white space, as the header says; fields may be quoted. Ragged rows
    are filled with nulls. ``n`` stands in for the file's sample sizes. A gzip file is one split, so it is dealt out after reading.
    """
    lines = spark.read.text(path)
    header = next((r[0] for r in lines.limit(1).collect()), "")
    sep = separator(header)
    names = [x.strip().strip('"') for x in (re.split(r"\s+", header.strip()) if sep is None else header.rstrip("\r\n").split(sep))]
    found, _ = resolve_aliases(names, overrides, required)
    upper = [x.upper() for x in names]
    if sep is None:
        if path.endswith(".gz"):
            lines = lines.repartition(max(2, spark.sparkContext.defaultParallelism))
        parts = lines.where((F.trim("value") != "") & (F.col("value") != header)).select(F.split(F.trim("value"), r"\s+").alias("v"))
        cell = lambda k: F.regexp_replace(F.get("v", F.lit(k)), '^"|"$', "")
    else:
        schema = ", ".join(f"c{k} string" for k in range(len(names)))
        parts = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema(schema).csv(path)
        if path.endswith(".gz"):
            parts = parts.repartition(max(2, spark.sparkContext.defaultParallelism))
        cell = lambda k: F.col(f"c{k}")

    def field(column: str) -> F.Column:
        x = cell(upper.index(found[column]))
        x = F.when(x.isin(*MISSING), None).otherwise(x)
        if column in ("SNP", "A1", "A2", "P", "DIRECTION"):
            return x.alias(column)
        x = x.try_cast("double")
        return (2 * x).alias("N") if column == "N_half" else x.alias(column)

    given = [] if n is None else [F.lit(float(n)).alias("N")]
    return parts.select(*(field(c) for c in found if n is None or c not in ("N", "N_half")), *given)


def read_munged(spark: SparkSession, path: str, trait: str) -> DataFrame:
    """``trait, SNP, N, Z, A1, A2`` of a munged file; z is effect over SE where the file has no Z."""
    x = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    x = x.toDF(*(c.upper() for c in x.columns))
    number = lambda c: F.col(c).try_cast("double")
    if "Z" not in x.columns and not {"B", "SE"} <= set(x.columns):
        raise ValueError(f"{path}: neither Z nor B and SE")
    ratio = number("B") / number("SE") if {"B", "SE"} <= set(x.columns) else F.lit(None).cast("double")
    z = F.coalesce(number("Z"), ratio) if "Z" in x.columns else ratio
    return x.select(F.lit(trait).alias("trait"), "SNP", number("N").alias("N"), z.alias("Z"), "A1", "A2")


def numbered(files: DataFrame) -> DataFrame:
    """The rows with ``file``, the place of their file among the glob's files in lexicographic order."""
    # The two ways to name a file differ in the slashes after the scheme.
    plain = r"^([a-zA-Z][a-zA-Z0-9+.-]*):/+"
    places = [x for i, f in enumerate(sorted(files.inputFiles())) for x in (F.lit(re.sub(plain, r"\1:/", f)), F.lit(i))]
    return files.withColumn("file", F.element_at(F.create_map(*places), F.regexp_replace("_metadata.file_path", plain, "$1:/")))


def read_annotations(spark: SparkSession, annot: str, freq: str | None = None, low: float = 0.05) -> DataFrame:
    """Annotation files (a glob) without CM, joined on SNP with the frequency files (a glob), where those are given: low < MAF < 1 - low.

    The files of both globs are paired in lexicographic order, so that a variant only meets its own file's frequency; another
    number of frequency files is an error.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).option("nullValue", "NA")
    x = reader.csv(annot)
    if freq is None:
        return x.drop("CM")
    f = reader.csv(freq)
    if len(x.inputFiles()) != len(f.inputFiles()):
        raise ValueError(f"{annot} has {len(x.inputFiles())} files, {freq} {len(f.inputFiles())}")
    f = numbered(f).select("file", "SNP", F.col("MAF").cast("double").alias("MAF")).where((F.col("MAF") > low) & (F.col("MAF") < 1 - low))
    return numbered(x).drop("CM", "MAF").join(f, ["file", "SNP"]).drop("file")


LD_SCHEMA = "CHR int, SNP string, BP long, CM double, MAF double, L2 double"


def read_ld_scores(spark: SparkSession, root: str, suffix: str = ".l2.ldscore.gz", chromosomes: list[int] | None = None, schema: str | None = LD_SCHEMA) -> DataFrame:
    """LD scores of the chromosomes, without CM and MAF; files may lack columns, which are null then."""
    paths = [f"{root}/{c}{suffix}" for c in (chromosomes or range(1, 23))]
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA")
    if schema:
        return reader.schema(schema).csv(paths).drop("CM", "MAF")
    return union_chromosomes([reader.option("inferSchema", True).csv(p) for p in paths]).drop("CM", "MAF")


def union_chromosomes(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def read_m(spark: SparkSession, root: str, suffix: str = ".l2.M_5_50", chromosomes: list[int] | None = None) -> list[float]:
    """Variant counts by annotation, summed over chromosomes."""
    rows = spark.read.option("sep", "\t").csv([f"{root}/{c}{suffix}" for c in (chromosomes or range(1, 23))])
    return [float(x) for x in rows.agg(*(F.sum(F.col(c).cast("double")) for c in rows.columns)).first()]


def chromosomes(select, top: int = 22) -> list[int]:
    """All chromosomes for False or None, ``ODD``, ``EVEN``, or those listed."""
    if select in (None, False):
        return list(range(1, top + 1))
    if isinstance(select, str):
        if select.upper() not in ("ODD", "EVEN"):
            raise ValueError("select is ODD, EVEN or a list of numbers")
        return [c for c in range(1, top + 1) if c % 2 == (select.upper() == "ODD")]
    return [int(c) for c in select]


def write_munged(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Tab-separated gzip files, one for each partition."""
    df.select("SNP", "N", "Z", "A1", "A2").write.mode("overwrite" if overwrite else "errorifexists").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_simulated(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Simulated traits as tab-separated gzip files, a folder ``replicate=r/trait=t`` for each replicate and trait.

    Null replicates and traits have a folder of their own; an empty table writes no files. Columns but ``replicate`` and ``trait`` are kept.
    """
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("replicate", "trait").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_covariance(spark: SparkSession, cov, traits: list[str], path: str, overwrite: bool = True) -> None:
    """A population covariance matrix as Parquet rows ``trait1, trait2, value``, both triangles and the diagonal."""
    rows = [(a, b, float(cov[i][j])) for i, a in enumerate(traits) for j, b in enumerate(traits)]
    spark.createDataFrame(rows, "trait1 string, trait2 string, value double").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_fusion(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """TWAS files: FILE, ID, TWAS.Z, HSQ and the permutation columns; names keep their dots as underscores."""
    out = []
    for p in paths:
        x = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(p)
        x = x.toDF(*(c.upper().replace(".", "_") for c in x.columns))
        out.append(x.withColumns({c: F.col(c).try_cast("double") for c in ("TWAS_Z", "HSQ", "PERM_PV", "PERM_N") if c in x.columns}))
    return out
