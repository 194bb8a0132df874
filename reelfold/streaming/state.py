"""Continuously updated state."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from reelfold import schemas as S
from reelfold.operators.journal import current_state, fold_columns, restore
from reelfold.streaming.visibility import _remove

STATE, WAITING = "state", "waiting"  # rows of an entity between micro-batches
_ROWS = 10_000


def state_stream(stream: DataFrame) -> DataFrame:
    """The current-state fold as a streaming aggregate, for update or complete mode.

    ``max_by`` is idempotent, so replayed and late events leave the state as it is.
    """
    return current_state(stream)


def maintain_state(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
    compact_every: int = 100,
) -> StreamingQuery:
    """Keep a state table without a state store.

    Every micro-batch is folded by itself and written as partial states with their winning
    sequence numbers, one folder per batch, overwritten when the batch runs again. Every
    ``compact_every`` batches the states of all batches so far are merged into one folder, which
    readers take in place of those; older folders may be deleted then. :func:`read_state` merges
    what is left.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        folded = batch.groupBy("persistence_id").agg(
            F.max("seq_nr").alias("seq_nr"), *fold_columns()
        )
        folded.write.mode("overwrite").parquet(f"{path}/kind=part/batch_id={batch_id}")
        if batch_id and batch_id % compact_every == 0:
            known = _partials(batch.sparkSession, path, batch_id)
            _merged(known).write.mode("overwrite").parquet(f"{path}/kind=merged/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _partials(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Partial states of all batches, or of those up to ``upto``: the newest merged folder that was
    finished before, and the parts after it."""
    found = spark.read.parquet(path)
    merged = found.filter(F.col("kind") == "merged")
    if upto is not None:  # a batch that runs again does not read its own result
        found, merged = found.filter(F.col("batch_id") <= upto), merged.filter(F.col("batch_id") < upto)
    last = merged.agg(F.max("batch_id")).first()[0]
    if last is None:
        kept = found.filter(F.col("kind") == "part")
    else:
        newest = (F.col("kind") == "merged") & (F.col("batch_id") == last)
        kept = found.filter(newest | ((F.col("kind") == "part") & (F.col("batch_id") > last)))
    return kept.select("persistence_id", "seq_nr", "file", "file_seq", "status", "status_seq")


def _merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("persistence_id").agg(
        F.max("seq_nr").alias("seq_nr"),
        F.max_by("file", "file_seq").alias("file"), F.max("file_seq").alias("file_seq"),
        F.max_by("status", "status_seq").alias("status"),
        F.max("status_seq").alias("status_seq"),
    )


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Current state from the partial states of all micro-batches."""
    no_tail = spark.createDataFrame([], S.struct_type(S.JOURNAL))
    return restore(_partials(spark, path), no_tail)


def compact_state(spark: SparkSession, path: str, out: str) -> None:
    """Merge all partial states into one table at ``out`` (a new path), same layout."""
    merged = _merged(_partials(spark, path))
    merged.write.mode("errorifexists").parquet(f"{out}/kind=merged/batch_id=-1")


def fold_stream(
    stream: DataFrame, init: dict, fn: Callable[[dict, dict], dict], state_schema: str, path: str,
    checkpoint: str, key: str = "persistence_id", seq: str = "seq_nr", trigger: dict | None = None,
) -> StreamingQuery:
    """Streaming form of the caller's ordered fold, with its states in a table.

    An entity's rows are the fold so far with the number of its last event, and the events that came
    before their predecessors; these wait until the gap is closed. So events may arrive in any
    order over any micro-batches, and replays change nothing. Numbers are gap-free from 1 per
    entity. ``fn`` gets an event as its JSON form (timestamps are texts). A micro-batch reads the rows that
    the one before it left, sorts them and its events by entity and number, and writes all states anew into
    its own folder, which a re-run overwrites; older folders are removed. :func:`read_fold` gives the newest
    state of every entity.
    """
    fields = S.struct_type(state_schema).fieldNames()
    kept = f"{state_schema}, {key} string, _last bigint, _json string, _row string"
    out = to_arrow_schema(S.struct_type(kept))
    start = json.dumps(init)

    def folded(batches):
        rows: list[tuple] = []
        entity, last, state, waiting = None, 0, dict(init), {}

        def keep() -> None:
            rows.append((*(state[f] if last else None for f in fields), entity, last, json.dumps(state), STATE))
            rows.extend((*[None] * len(fields), entity, n, e, WAITING) for n, e in waiting.items())

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
            rows.clear()
            return found

        for batch in batches:
            for to, number, event, order in zip(*(c.to_pylist() for c in batch.columns)):
                if to != entity:
                    if entity is not None:
                        keep()
                        if len(rows) >= _ROWS:
                            yield flush()
                    entity, last, state, waiting = to, 0, json.loads(start), {}
                if order == 0:
                    last, state = number, json.loads(event)
                elif number > last:
                    waiting[number] = event
                    while order == 2 and last + 1 in waiting:
                        state = fn(state, json.loads(waiting.pop(last + 1)))
                        last += 1
        if entity is not None:
            keep()
        if rows:
            yield flush()

    def write(batch: DataFrame, batch_id: int) -> None:
        events = batch.select(
            F.col(key).cast("string").alias(key), F.col(seq).cast("bigint").alias("_seq"),
            F.to_json(F.struct("*")).alias("_event"), F.lit(2).alias("_order"),
        ).filter(F.col(key).isNotNull() & F.col("_seq").isNotNull())
        if batch_id:
            held = batch.sparkSession.read.schema(kept).parquet(f"{path}/batch_id={batch_id - 1}")
            order = F.when(F.col("_row") == STATE, 0).otherwise(1)
            events = events.unionByName(held.select(
                key, F.col("_last").alias("_seq"), F.col("_json").alias("_event"), order.alias("_order")
            ))
        sorted_rows = events.repartition(key).sortWithinPartitions(key, "_order", "_seq")
        sorted_rows.mapInArrow(folded, kept).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        _remove(f"{path}/batch_id={batch_id - 2}")  # a re-run of this batch needs the one before

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_fold(spark: SparkSession, path: str, state_schema: str, key: str = "persistence_id") -> DataFrame:
    """Newest state of every entity of :func:`fold_stream`."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("batch_id")).first()[0]
    states = rows.filter((F.col("batch_id") == newest) & (F.col("_row") == STATE) & (F.col("_last") > 0))
    return states.select(key, *S.struct_type(state_schema).fieldNames())
