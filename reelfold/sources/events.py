"""The journal table: append and scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelfold.functions.ids import event_tag
from reelfold.operators.journal import assign_seq
from reelfold.operators.skew import join_unique

JOURNAL_COLUMNS = [
    "persistence_id", "seq_nr", "ts", "event_date", "tag", "event_type", "file", "status",
    "source_file_id",
]


def number_after(events: DataFrame, journal: DataFrame | None = None, **options) -> DataFrame:
    """New events with sequence numbers that continue those of ``journal``, day and tag added."""
    numbered = assign_seq(events, **options)
    if journal is not None:
        heads = journal.groupBy("persistence_id").agg(F.max("seq_nr").alias("_head"))
        numbered = (
            join_unique(numbered, heads, "persistence_id")
            .withColumn("seq_nr", F.col("seq_nr") + F.coalesce("_head", F.lit(0)))
            .drop("_head")
        )
    return numbered.withColumns(
        {"event_date": F.to_date("ts"), "tag": event_tag("persistence_id")}
    ).select(*JOURNAL_COLUMNS)


def append_events(numbered: DataFrame, path: str) -> None:
    """Append numbered events, one folder per day.

    The rebalance lets AQE split a day that holds most of the batch and merge small ones; sorting
    by entity gives each file narrow id ranges for lookups.
    """
    (
        numbered.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "persistence_id", "seq_nr")
        .write.mode("append").partitionBy("event_date").parquet(path)
    )


def scan_events(
    journal: DataFrame, tag: str | None = None, from_seq: int = 0,
    from_date: dt.date | None = None, offsets: DataFrame | None = None,
) -> DataFrame:
    """Events after an offset, of one tag if given; ``from_date`` prunes whole day folders.

    ``from_seq`` holds for every entity. To resume a projection hand in ``offsets``, a row
    ``persistence_id, offset`` for each entity seen so far (``projection_progress`` of what was
    published): an entity without one is read from its first event.
    """
    if tag is not None:
        journal = journal.filter(F.col("tag") == tag)
    if from_date is not None:
        journal = journal.filter(F.col("event_date") >= F.lit(from_date))
    journal = journal.filter(F.col("seq_nr") > from_seq)
    if offsets is None:
        return journal
    seen = offsets.groupBy("persistence_id").agg(F.max("offset").alias("_offset"))
    ahead = join_unique(journal, seen, "persistence_id")
    return ahead.filter(F.col("seq_nr") > F.coalesce("_offset", F.lit(0))).drop("_offset")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
