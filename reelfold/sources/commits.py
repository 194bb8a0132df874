"""Idempotent appends: a journal with a commit log and a table of heads.

Below a journal's path lie ``events/commit=…/event_date=…`` (rows), ``heads/commit=…`` (the last number of
each entity that a commit touched) and ``log/…`` (one small file for each commit). An append belongs to a
writer's batch. Its rows and heads go to folders named after the two, which another attempt overwrites;
they count from the moment the log entry is there. So an append that failed leaves nothing, one that is
tried again changes nothing, and new numbers follow from the heads alone, without reading the journal.

Appends to one entity must follow one another, as its owner's do; those to different entities need not.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from reelfold import schemas as S
from reelfold.functions.ids import event_tag
from reelfold.operators.journal import assign_seq
from reelfold.operators.skew import join_unique
from reelfold.sources.events import JOURNAL_COLUMNS

HEADS = "persistence_id string, head bigint"
MERGE_AFTER = 32  # heads of so many commits are merged into one table


def commit_name(writer: str, batch: int) -> str:
    if not re.fullmatch("[A-Za-z0-9_-]+", writer):
        raise ValueError("a writer's name has letters, digits, _ and - only")
    return f"{writer}.{batch}"


def _log(path: str) -> tuple[pafs.FileSystem, str]:
    system, base = pafs.FileSystem.from_uri(path)
    return system, posixpath.join(base, "log")


def committed(path: str) -> list[dict]:
    """The log's entries: ``name`` of the commit, and ``heads`` where its heads are merged with older ones."""
    system, folder = _log(path)
    entries = []
    for info in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with system.open_input_file(info.path) as source:
                entries.append(json.loads(source.read()))
    return sorted(entries, key=lambda e: (e["number"], e["name"]))


def _write_entry(path: str, entry: dict) -> None:
    """One file, visible whole or not at all."""
    system, folder = _log(path)
    system.create_dir(folder, recursive=True)
    temp = posixpath.join(folder, f".{uuid.uuid4().hex}")
    with system.open_output_stream(temp) as out:
        out.write(json.dumps(entry).encode())
    system.move(temp, posixpath.join(folder, f"{entry['name']}.json"))


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """(persistence_id, head) of every entity: from the last merged heads and the commits after them."""
    found = _head_paths(path)
    if not found:
        return spark.createDataFrame([], HEADS)
    return spark.read.schema(HEADS).parquet(*found).groupBy("persistence_id").agg(F.max("head").alias("head"))


def _head_paths(path: str) -> list[str]:
    entries = committed(path)
    merged = max((k for k, e in enumerate(entries) if e["merged"]), default=None)
    # a commit that was under way while others were merged is not in the merge
    covered = set(entries[merged]["merged"]) if merged is not None else set()
    return [f"{path}/heads/commit={e['name']}" for e in entries if e["name"] not in covered]


def append_once(
    events: DataFrame, path: str, writer: str, batch: int, merge_after: int = MERGE_AFTER, **options
) -> bool:
    """Number ``events`` after the journal's heads and append them as ``batch`` of ``writer``.

    True if they were appended, False if that batch had been before. Reads the log, the heads and the
    events; what is written is the events and the heads of their entities (every ``merge_after``
    commits the heads of all).
    """
    name = commit_name(writer, batch)
    entries = committed(path)
    if any(e["name"] == name for e in entries):
        return False
    spark = events.sparkSession
    numbered = number_after_heads(events, read_heads(spark, path), **options)
    where = f"{path}/events/commit={name}"
    (
        numbered.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "persistence_id", "seq_nr")
        .write.mode("overwrite").partitionBy("event_date").parquet(where)
    )
    written = spark.read.schema(S.struct_type(S.JOURNAL)).parquet(where)
    heads = written.groupBy("persistence_id").agg(F.max("seq_nr").alias("head"))
    merged: list[str] = []
    if len(_head_paths(path)) >= merge_after:
        merged = [e["name"] for e in entries]
        heads = heads.unionByName(read_heads(spark, path)).groupBy("persistence_id").agg(F.max("head").alias("head"))
    heads.write.mode("overwrite").parquet(f"{path}/heads/commit={name}")
    number = max((e["number"] for e in entries), default=0) + 1
    _write_entry(path, {"name": name, "number": number, "merged": merged})
    return True


def number_after_heads(events: DataFrame, heads: DataFrame, **options) -> DataFrame:
    """Events with the numbers that follow ``heads`` (persistence_id, head), day and tag added."""
    known = heads.select("persistence_id", F.col("head").alias("_head"))
    return (
        join_unique(assign_seq(events, **options), known, "persistence_id")
        .withColumn("seq_nr", F.col("seq_nr") + F.coalesce("_head", F.lit(0)))
        .withColumns({"event_date": F.to_date("ts"), "tag": event_tag("persistence_id")})
        .select(*JOURNAL_COLUMNS)
    )


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all commits in the log, and no others."""
    names = [e["name"] for e in committed(path)]
    if not names:
        return spark.createDataFrame([], S.struct_type(S.JOURNAL))
    folders = [f"{path}/events/commit={n}" for n in names]
    rows = spark.read.schema(S.struct_type(S.JOURNAL)).option("basePath", f"{path}/events").parquet(*folders)
    return rows.select(*JOURNAL_COLUMNS)
