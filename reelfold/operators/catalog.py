"""The catalogue: one row per upload and per status update, searched and looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelfold import schemas as S
from reelfold.functions.ids import parse_uuid
from reelfold.functions.names import file_type
from reelfold.operators.skew import join_unique

CATALOG_COLUMNS = ["file", "status", "commit_ts", "persistence_id", "seq_nr"]
SEARCHED = ("file.file_id", "file.file_name", "file.content_type", "file.full_path", "status")


def _entry(journal: DataFrame, status: Column) -> DataFrame:
    return journal.select(
        "file", status.alias("status"), F.col("ts").alias("commit_ts"), "persistence_id", "seq_nr"
    )


def added_entries(journal: DataFrame) -> DataFrame:
    return _entry(journal.filter(F.col("event_type") == S.FILE_ADDED), F.lit(S.STATUS_NONE))


def updated_entries(journal: DataFrame) -> DataFrame:
    return _entry(journal.filter(F.col("event_type") == S.UPDATED_STATUS), F.col("status"))


def catalog_union(added: DataFrame, updated: DataFrame) -> DataFrame:
    """Both producers' rows, duplicates kept."""
    return added.unionByName(updated)


def build_catalog(journal: DataFrame) -> DataFrame:
    """``catalog_union(added_entries, updated_entries)`` in a single scan of the journal."""
    kept = journal.filter(F.col("event_type").isin(S.FILE_ADDED, S.UPDATED_STATUS))
    added = F.col("event_type") == S.FILE_ADDED
    return _entry(kept, F.when(added, F.lit(S.STATUS_NONE)).otherwise(F.col("status")))


def in_commit_order(catalog: DataFrame) -> DataFrame:
    """Append order as an explicit total order; its range partitions split on all three keys."""
    return catalog.orderBy("commit_ts", "persistence_id", "seq_nr")


def search(catalog: DataFrame, key: str) -> DataFrame:
    """Rows with ``key`` in any searched column: case-sensitive, no wildcards, duplicates kept."""
    hit = F.lit(False)
    for column in SEARCHED:
        hit = hit | F.col(column).contains(key)
    return catalog.filter(hit)


def list_all(catalog: DataFrame) -> DataFrame:
    return catalog


def lookup(state: DataFrame, file_id: str) -> DataFrame:
    """State of one file; entities that never had a file are not found."""
    return state.filter((F.col("persistence_id") == file_id) & F.col("file.file_id").isNotNull())


def journal_json(df: DataFrame, *keep: str) -> DataFrame:
    """File record under its published names."""
    return df.select(
        *keep,
        F.col("file.file_name").alias("file_name"),
        F.col("file.full_path").alias("file_path"),
        F.col("file.content_type").alias("contentType"),
        F.col("file.status").alias("file_status"),
        F.col("file.file_id").alias("file_id"),
    )


def catalog_json(catalog: DataFrame) -> DataFrame:
    """Catalogue row under its published names; here ``file_status`` is the string state."""
    return catalog.select(
        F.col("file.file_id").alias("file_id"),
        F.col("file.file_name").alias("file_name"),
        file_type("file.full_path").alias("file_type"),
        F.col("file.content_type").alias("contentType"),
        F.col("status").alias("file_status"),
    )


def lookup_result(ids: DataFrame, state: DataFrame, id_column: str = "id") -> DataFrame:
    """One JSON document per asked id: the file and its status, or the not-found answer."""
    found = state.filter(F.col("file.file_id").isNotNull()).select(
        F.col("persistence_id").alias("_id"), "file", "status", F.lit(True).alias("_found")
    )
    asked = ids.withColumn("_id", parse_uuid(id_column))
    joined = join_unique(asked, found, "_id", spread_by=[id_column])
    journal = F.struct(
        F.col("file.file_name").alias("file_name"),
        F.col("file.full_path").alias("file_path"),
        F.col("file.content_type").alias("contentType"),
        F.col("file.status").alias("file_status"),
        F.col("file.file_id").alias("file_id"),
    )
    hit = F.to_json(F.struct(journal.alias("journal"), F.col("status").alias("status")))
    miss = F.to_json(
        F.struct(F.col(id_column).alias("id"), F.lit(S.FILE_NOT_FOUND).alias("reason"))
    )
    return joined.select(
        F.col(id_column).alias("id"),
        F.col("_found").isNotNull().alias("found"),
        F.when(F.col("_found").isNotNull(), hit).otherwise(miss).alias("body"),
    )


def event_log_line(journal: DataFrame) -> DataFrame:
    """The line logged for every consumed event."""
    return journal.select(
        "persistence_id", "seq_nr",
        F.format_string(
            S.EVENT_LOG_LINE, "tag", "event_type", "persistence_id", "seq_nr"
        ).alias("line"),
    )
