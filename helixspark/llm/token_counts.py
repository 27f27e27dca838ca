"""Exact token-length histogram: suffix sums answer totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.llm._common import id_text, stored, table
from helixspark.llm.bpe import CHUNKS, SEPARATORS, ranks, vocabulary

#: Chunks of text whose token count a worker remembers; lengths that share a block of the suffix sums.
REMEMBERED, BLOCK = 500_000, 1024


@cache
def counter(path: str, pattern: str):
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary

    class Lengths(dict):
        def __missing__(self, chunk: str) -> int:
            if len(self) >= REMEMBERED:
                self.clear()
            n = self[chunk] = len(encode(chunk))
            return n

    known = Lengths()
    return lambda text: len(encode(text)) if SEPARATORS.search(text) else sum(map(known.__getitem__, CHUNKS(text)))


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` for each row; a null text has none, repeated rows count each time."""
    path, pattern = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(x or "") for x in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """A row for each length that occurs, with suffix sums over all lengths.

    ``length, n_docs, docs_from`` (documents at least that long), ``tokens_from`` (their tokens), ``tokens_upto`` (tokens of
    documents at most that long), ``truncated_total`` (all tokens left when every document is cut at ``length``) and
    ``quantile`` (share of documents at most that long). Null lengths count as 0; an empty table gives an empty result.
    Sums run within blocks of lengths, then over the blocks, so that no task holds the histogram.
    """
    counts = lengths.groupBy(F.coalesce(F.col(col).cast("long"), F.lit(0)).alias("length")).agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn("block", F.col("length").cast("decimal(20,0)").cast("long") / BLOCK).withColumn("block", F.floor("block"))
    counts = stored(counts, "lengths")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("length")).alias("bt"))
    # One row per block of lengths: the longest text bounds their number.
    up = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(up), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("bt").over(up), F.lit(0)).alias("later_tokens"), F.sum("bd").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_docs"), F.sum("bt").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_tokens"))
    down = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("n_docs") * F.col("length")
    x = counts.withColumns({"d": F.sum("n_docs").over(down), "t": F.sum(own).over(down)}).join(blocks, "block")
    x = x.withColumns({"docs_from": F.col("d") + F.col("later_docs"), "tokens_from": F.col("t") + F.col("later_tokens")})
    upto = F.col("all_tokens") - F.col("tokens_from") + own
    return x.select("length", "n_docs", "docs_from", "tokens_from", upto.alias("tokens_upto"), (upto + F.col("length") * (F.col("docs_from") - F.col("n_docs"))).alias("truncated_total"), ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, total_tokens, truncated_total, n_truncated`` of each limit, from the suffix sums.

    A limit between two lengths is answered by the next lower one, exactly; one below all lengths cuts every document. The
    limits are few: each is a column of one aggregation. An empty histogram gives 0 tokens.
    """
    zero = F.lit(0).cast("bigint")
    answers = []
    for c in map(int, limits):
        upto = F.coalesce(F.max_by("tokens_upto", F.when(F.col("length") <= c, F.col("length"))), zero)
        cut = F.coalesce(F.min_by("docs_from", F.when(F.col("length") > c, F.col("length"))), zero)
        answers.append(F.struct(F.lit(c).cast("bigint").alias("context_limit"), F.coalesce(F.max("tokens_from"), zero).alias("total_tokens"), (upto + F.lit(c) * cut).alias("truncated_total"), cut.alias("n_truncated")))
    return histogram.agg(F.array(*answers).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that at least the share ``q`` of the documents does not exceed; no row if there are none, or q is over 1."""
    return histogram.where(F.col("quantile") >= q).agg(F.min("length").alias("length")).where("length is not null")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))


QUERIES = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
