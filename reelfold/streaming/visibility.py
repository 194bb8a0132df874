"""Delayed visibility: events of a tag are seen once the tag is a delay ahead of them."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from reelfold.operators.skew import bounded_side

DELAY_SECONDS = 2.0  # how long an event stays unseen, so that slower writers can catch up
VISIBLE, HELD, LATE = "visible", "held", "late"
_KEY = ["persistence_id", "seq_nr"]


def _remove(path: str) -> None:
    system, name = pafs.FileSystem.from_uri(path)
    if system.get_file_info(name).type != pafs.FileType.NotFound:
        system.delete_dir(name)


def sort_out(
    held: DataFrame, new: DataFrame, before: DataFrame, clock: DataFrame, delay_seconds: float = DELAY_SECONDS
) -> DataFrame:
    """``held`` and ``new`` events with their ``kind``.

    ``before`` and ``clock`` are a row ``(tag, newest)`` for each tag, before and after ``new``. A new event
    whose moment had passed before it came is late; the others are visible once the clock of their tag is
    ``delay_seconds`` ahead of them, and held till then. An event that is held already is not taken twice.
    """
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay_seconds).cast("decimal(18,6)"))
    # a row for each tag; beyond what may be broadcast, the join shuffles
    before, _ = bounded_side(before.select(F.col("tag").alias("_tag"), F.col("newest").alias("_before")))
    clock, _ = bounded_side(clock.select(F.col("tag").alias("_tag"), F.col("newest").alias("_clock")))
    columns = held.columns
    known = new.withColumn("_new", F.lit(True)).unionByName(held.withColumn("_new", F.lit(False)))
    timed = known.join(before, F.col("tag").eqNullSafe(F.col("_tag")), "left").drop("_tag")
    timed = timed.withColumn(
        "kind", F.when(F.col("_new") & (F.col("ts") <= F.col("_before") - delay), LATE).otherwise(HELD)
    )
    once = timed.dropDuplicates(["tag", *_KEY, "ts", "kind"])
    due = once.join(clock, F.col("tag").eqNullSafe(F.col("_tag")), "left")
    passed = F.coalesce(F.col("ts") <= F.col("_clock") - delay, F.lit(True))  # without a time: at once
    kind = F.when((F.col("kind") == HELD) & passed, VISIBLE).otherwise(F.col("kind"))
    return due.select(*columns, kind.alias("kind"))


def publish_delayed(
    stream: DataFrame, path: str, checkpoint: str, delay_seconds: float = DELAY_SECONDS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Journal events into a table at ``path`` by ``kind``: visible, held or late (:func:`sort_out`).

    Every tag has its own clock, the newest time seen of it, so a tag that lags holds up no other and
    loses nothing to one that leads. Nothing is dropped: an event that comes after its moment goes to the
    late ones. A micro-batch reads the clocks and held events of the one before and overwrites its own
    folders, so a re-run leaves the same rows; held events of older batches are removed. Events are
    spread as the batch brings them, not by tag. Tags are few: their clocks are broadcast if they are.
    """
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch_id == 0:
            held = session.createDataFrame([], schema)
            before = session.createDataFrame([], "tag string, newest timestamp")
        else:
            held = _of_kind(session, f"{path}/events/batch_id={batch_id - 1}", schema, HELD)
            before = session.read.parquet(f"{path}/clock/batch_id={batch_id - 1}")
        times = batch.select("tag", F.col("ts").alias("newest")).unionByName(before)
        where = f"{path}/clock/batch_id={batch_id}"
        times.groupBy("tag").agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(where)
        rows = sort_out(held, batch, before, session.read.parquet(where), delay_seconds)
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/events/batch_id={batch_id}")
        # a re-run of this batch needs the one before, nothing older
        _remove(f"{path}/events/batch_id={batch_id - 2}/kind={HELD}")
        _remove(f"{path}/clock/batch_id={batch_id - 2}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _of_kind(spark: SparkSession, path: str, schema, kind: str) -> DataFrame:
    whole = T.StructType([*schema, T.StructField("kind", T.StringType())])
    rows = spark.read.schema(whole).parquet(path)
    return rows.filter(F.col("kind") == kind).select(*schema.names)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/events")


def visible_events(spark: SparkSession, path: str) -> DataFrame:
    """What readers see, each event once: replays within the delay never come twice."""
    return _table(spark, path).filter(F.col("kind") == VISIBLE).drop("kind", "batch_id")


def held_events(spark: SparkSession, path: str) -> DataFrame:
    """What the newest micro-batch left unseen."""
    rows = _table(spark, path)
    newest = spark.read.parquet(f"{path}/clock").agg(F.max("batch_id")).first()[0]
    return rows.filter((F.col("kind") == HELD) & (F.col("batch_id") == newest)).drop("kind", "batch_id")


def late_events(spark: SparkSession, path: str) -> DataFrame:
    """First deliveries that came after their moment, each once; replays of visible events are left out."""
    rows = _table(spark, path).filter(F.col("kind") == LATE).drop("kind", "batch_id")
    seen = visible_events(spark, path).select(*_KEY)
    return rows.dropDuplicates(_KEY).join(seen, _KEY, "left_anti")
