"""Per-file jobs around a function supplied by the caller: conversion and probing.

The media codec itself is a per-file library call; Spark spreads the files, retries lost tasks and
collects one row per file.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from reelfold import schemas as S

_HELD = 5000  # results and their progress events that a task hands on together
CONVERTED = (
    "file_id string, new_name string, progress_id string, status string, error string, "
    "permils array<int>"
)
PROBED = (
    f"file {S.FILE_JOURNAL}, duration bigint, format string, "
    "audio_track struct<bit_rate:int,channels:int,decoder:string,sampling_rate:int>, "
    "video_track struct<bit_rate:int,frame_rate:double,decoder:string,width:int,height:int>, "
    "error string"
)


def run_conversions(
    plan: DataFrame, convert_fn: Callable[[dict, BinaryIO, Callable[[int], None]], None],
    out_dir: str, tasks: int | None = None,
) -> DataFrame:
    """Run ``convert_fn(plan_row, output, on_permil)`` per file; one result row each.

    ``output`` is an open binary stream below ``out_dir``, a URI or path that all executors share.
    It has a name of this attempt and is renamed when done, so a retried or speculative task never
    leaves half a file under the real name. Any exception, or a plan that is already wrong, gives
    ``failed`` with the error text and no file.
    """
    fields = to_arrow_schema(S.struct_type(CONVERTED))
    complete, failed = S.STATUS_COMPLETE, S.STATUS_FAILED

    def convert(row: dict, system: pafs.FileSystem, base: str) -> dict:
        permils: list[int] = []
        status, error = complete, row["plan_error"]
        if error is None:
            temp = posixpath.join(base, f".{uuid.uuid4().hex}")
            try:
                with system.open_output_stream(temp) as output:
                    convert_fn(row, output, permils.append)
                system.move(temp, posixpath.join(base, row["new_name"]))
            except Exception as exc:  # the caller's function may raise anything
                error = f"{type(exc).__name__}: {exc}"
                if system.get_file_info(temp).type != pafs.FileType.NotFound:
                    system.delete_file(temp)
        if error is not None:
            status = failed
        return {
            "file_id": row["file_id"], "new_name": row["new_name"],
            "progress_id": row["progress"], "status": status, "error": error, "permils": permils,
        }

    def run(batches):
        system, base = pafs.FileSystem.from_uri(out_dir)
        system.create_dir(base, recursive=True)
        for batch in batches:
            done, held = [], 0
            for row in batch.to_pylist():
                done.append(convert(row, system, base))
                held += 1 + len(done[-1]["permils"])
                if held >= _HELD:
                    yield pa.RecordBatch.from_pylist(done, schema=fields)
                    done, held = [], 0
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=fields)

    # a row is a file's work, however few its bytes, and many rows may name one source: dealt by the whole
    # row to a number of tasks that is not lowered by size
    keys = [c.name for c in plan.schema if c.dataType.typeName() in ("string", "long", "integer")]
    return plan.repartition(tasks or _tasks(plan.sparkSession), *keys).mapInArrow(run, CONVERTED)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def progress_rows(results: DataFrame) -> DataFrame:
    """Progress events ``(progress_id, event_seq, permil)`` of finished conversions."""
    return results.select("progress_id", F.posexplode("permils").alias("event_seq", "permil")).select(
        "progress_id", F.col("event_seq").cast("bigint").alias("event_seq"), "permil"
    )


def probe_files(files: DataFrame, probe_fn: Callable[[dict], dict]) -> DataFrame:
    """Run ``probe_fn(row) -> {duration, format, audio_track, video_track}`` per file.

    ``files`` has the ``file`` record and whatever the function needs (a path, or the content).
    A probe that raises gives an error row.
    """
    fields = to_arrow_schema(S.struct_type(PROBED))

    def probe(row: dict) -> dict:
        try:
            return {"file": row["file"], "error": None, **probe_fn(row)}
        except Exception as exc:  # the caller's function may raise anything
            return {"file": row["file"], "error": f"{type(exc).__name__}: {exc}"}

    def run(batches):
        for batch in batches:
            rows = [probe(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(
                [{name: r.get(name) for name in fields.names} for r in rows], schema=fields
            )

    return files.mapInArrow(run, PROBED)
