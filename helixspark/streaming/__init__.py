"""Association files that arrive over time: each micro-batch runs the same cleaning plan as a batch read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixspark.operators.prep import munge


def munge_arrivals(spark: SparkSession, source: DataFrame, ref: DataFrame, path: str, checkpoint: str):
    """A query that appends cleaned rows of each arriving batch of ``trait, SNP, A1, A2, effect, P, N``.

    A batch is written to a folder of its own number, so a repeated batch replaces itself.
    """

    def step(batch: DataFrame, number: int) -> None:
        munge(batch, ref, ("trait",)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
