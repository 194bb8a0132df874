"""Tagged projection of the journal: read, de-duplicate, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from reelfold import schemas as S

COMMIT_DELAY = "2 seconds"  # how long an event stays unseen, so that slower writers can catch up


def journal_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """New journal files as a stream; the query's checkpoint is the stored offset."""
    reader = spark.readStream.schema(S.struct_type(S.JOURNAL))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def commit_delay(stream: DataFrame, delay: str = COMMIT_DELAY) -> DataFrame:
    """Events once they are ``delay`` old, each once, with the day bucket added.

    An event is held in state until the stream has seen one that is ``delay`` newer; the newest
    ones stay out until then. Replays within that time fall together. Events that arrive later
    than ``delay`` behind the newest are dropped, so a replay of old days needs a delay that spans
    them. State holds the events of one delay.
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    key = ["ts", "persistence_id", "seq_nr"]
    rest = [c for c in timed.columns if c not in key]
    held = timed.groupBy(*key).agg(F.first(F.struct(*rest)).alias("_event"))
    return held.select(*key, "_event.*").select(*timed.columns).withColumn(
        "event_date", F.to_date("ts")
    )


def dedupe_replays(stream: DataFrame, delay: str | None) -> DataFrame:
    """Drop events delivered again: at-least-once in, once out.

    ``delay`` bounds the state and is the caller's promise that nothing arrives that late: a
    *first* delivery further behind the newest event is dropped as well. None keeps every key
    for ever and drops replays only.
    """
    key = ["persistence_id", "seq_nr"]
    if delay is None:
        return stream.dropDuplicates(key)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def project_by_tag(stream: DataFrame) -> DataFrame:
    """Events as published rows ``(tag, persistence_id, seq_nr, event, ts)``.

    One query serves all tags. The tag stays a column: a shuffle on it would leave one task per
    tag however large the journal is.
    """
    event = F.to_json(F.struct("event_type", "file", "status"))
    return stream.select("tag", "persistence_id", "seq_nr", event.alias("event"), "ts")


def publish_events(
    published: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write published rows to a table with one folder per micro-batch and tag.

    A micro-batch that runs again after a failure overwrites its own folder, so the table holds
    every event once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.write.mode("overwrite").partitionBy("tag")
            .parquet(f"{path}/batch_id={batch_id}")
        )

    return (
        published.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")
