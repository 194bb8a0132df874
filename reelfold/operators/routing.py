"""Messages to registered consumers, and conversion progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelfold.functions.guards import percent
from reelfold.operators.skew import join_unique

EVERYONE = "*"


def consumer_set(registrations: DataFrame) -> DataFrame:
    """Exact duplicates of (id, ref) collapse; duplicates meet map-side before the shuffle."""
    return registrations.dropDuplicates(["id", "ref"])


def consumer_add(consumers: DataFrame, added: DataFrame) -> DataFrame:
    return consumers.unionByName(added).distinct()


def consumer_remove(consumers: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop every registration of the removed refs."""
    return join_unique(consumers, removed.select("ref").distinct(), "ref", "left_anti")


def active_registrations(registered: DataFrame, terminated: DataFrame) -> DataFrame:
    """Registrations whose consumer has not terminated."""
    return consumer_remove(registered, terminated)


def active_at(ts: Column | str) -> Column:
    """Whether a registration with ``registered_at, terminated_at`` is active at ``ts``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    ended = F.col("terminated_at").isNotNull() & (ts >= F.col("terminated_at"))
    return (F.col("registered_at") <= ts) & ~ended


def route_to(messages: DataFrame, registrations: DataFrame) -> DataFrame:
    """One delivery per message and registration of the same id.

    A plain equi join: AQE splits the partition of a hot id, and nothing after the join relies on
    its partitioning.
    """
    return messages.join(consumer_set(registrations).select("id", "ref"), "id")


def broadcast_messages(messages: DataFrame, registrations: DataFrame) -> DataFrame:
    """Messages for everyone: one row each, with the audience and its size.

    Writing every message once per consumer would multiply both tables; a message for everyone is
    stored once and :func:`inbox` gives a consumer its copy.
    """
    size = consumer_set(registrations).agg(F.count(F.lit(1)).alias("recipients"))
    return messages.select("*", F.lit(EVERYONE).alias("ref")).withColumn(
        "recipients", size.scalar()
    )


def inbox(deliveries: DataFrame, ref: str) -> DataFrame:
    """What one consumer receives: messages routed to it and messages for everyone."""
    return deliveries.filter(F.col("ref").isin(ref, EVERYONE)).withColumn("ref", F.lit(ref))


def progress_percent(progress: DataFrame) -> DataFrame:
    return progress.withColumn("percent", percent("permil"))


def progress_latest(progress: DataFrame) -> DataFrame:
    """Last percent of each conversion, and whether 100 was reached."""
    done = progress_percent(progress)
    return done.groupBy("progress_id").agg(
        F.max_by("percent", "event_seq").alias("percent"),
        F.max(F.col("percent") == 100.0).alias("finished"),
    )


def projection_progress(published: DataFrame) -> DataFrame:
    """Newest offset and time per tag and entity."""
    return published.groupBy("tag", "persistence_id").agg(
        F.max("seq_nr").alias("offset"), F.max("ts").alias("last_updated")
    )


def tag_progress(published: DataFrame) -> DataFrame:
    """Newest time and event count per tag."""
    return published.groupBy("tag").agg(
        F.max("ts").alias("last_updated"), F.count(F.lit(1)).alias("events")
    )
