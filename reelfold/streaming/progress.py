"""Conversion progress as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from reelfold.operators.routing import progress_latest


def progress_stream(stream: DataFrame) -> DataFrame:
    """Latest percent per conversion and the end marker, for update or complete mode."""
    return progress_latest(stream)


def maintain_progress(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep a progress table without a state store: nothing has to be released at 100 %.

    Every micro-batch is folded by itself, one row per conversion, into its own folder, which a
    batch that runs again overwrites. :func:`read_progress` merges them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("progress_id").agg(
            F.max_by("permil", "event_seq").alias("permil"), F.max("event_seq").alias("event_seq"),
            F.max("permil").alias("most"),
        )
        newest.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per conversion: its last percent and whether 100 was reached."""
    parts = spark.read.parquet(path)
    last = parts.select("progress_id", "event_seq", "permil")
    # the largest value, put first, keeps an end that a later event has replaced
    most = parts.select("progress_id", F.lit(-1).cast("bigint").alias("event_seq"), F.col("most").alias("permil"))
    return progress_latest(last.unionByName(most))
