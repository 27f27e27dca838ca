"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from helixspark.llm._common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier calls toxic go, each by its own text; labels are learnt from the rows that may be.

    Null and empty texts score 0 and stay, as do rows with a null id that score low; of repeated rows all go or all stay. Without
    labels nothing goes. An empty table gives an empty one.
    """
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, located=False, keep=tuple(docs.columns)).where("predicted = 0")
    return scored.select(*(F.col(f"kept{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred before, or nearly, go from the texts; every document stays.

    Null texts and rows with a null id stay as they are; rows that repeat id and text are one document, rows that share an id
    alone are several. An empty table gives an empty one.
    """
    return line_dedup.dedup_lines(docs, short=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id stays, of rows with one id and text one.

    Null and empty texts have no copies. Rows that share an id are one document, which stays or goes whole; rows with a null id
    stay, once for each text. An empty table gives an empty one.
    """
    found = ngram_join.near_copies(docs, 5, 80)
    kept = docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return kept.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select(*(F.col(c if c in ("doc_id", "text") else f"rest.{c}") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains below their target occur again; each occurs at least once. Targets of absent domains don't count.

    A text without words (null, empty) has rate 1 and occurs once; a null id takes part. Without labels every row occurs once.
    An empty table gives an empty one.
    """
    return mixing.mixed_rows(docs, table(spark, sf_dir, "labels"), mixing.TARGETS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts; a null text has no tokens, repeated rows repeat."""
    return bpe.bpe(docs, keep=())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_copies), ("mixing", mix_sources), ("bpe", tokenize)]
#: Trained models and edit distances decide what stays: SQL can't express that. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
