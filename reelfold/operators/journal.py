"""The event journal and its folds."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from reelfold import schemas as S
from reelfold.operators.skew import HOT_ROWS, carry_forward, join_unique, number_rows

SLICE_EVENTS = 1_000_000


def assign_seq(
    events: DataFrame, key: str = "persistence_id", order: tuple[str, ...] = ("ts", "event_id"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``seq_nr``, gap-free from 1 within each entity."""
    return number_rows(events, key, list(order), "seq_nr", hot_rows)


def event_is_handled() -> Column:
    """Whether the fold knows the event type."""
    return F.col("event_type").isin(*S.HANDLED_EVENTS)


def split_handled(journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Handled events, and the rest for quarantine."""
    handled = F.coalesce(event_is_handled(), F.lit(False))
    return journal.filter(handled), journal.filter(~handled)


def _sets_file() -> Column:
    return F.col("event_type").isin(S.FILE_ADDED, S.CONVERTED_FILE)


def _sets_status() -> Column:
    return F.col("event_type").isin(S.CONVERTED_FILE, S.UPDATED_STATUS)


def _new_status() -> Column:
    started = F.col("event_type") == S.CONVERTED_FILE
    return F.when(started, F.lit(S.STATUS_INPROGRESS)).otherwise(F.col("status"))


def fold_columns() -> list[Column]:
    """The fold as order-independent aggregates, with the sequence numbers that won."""
    file_seq = F.when(_sets_file(), F.col("seq_nr"))
    status_seq = F.when(_sets_status(), F.col("seq_nr"))
    return [
        F.max_by("file", file_seq).alias("file"),
        F.max(file_seq).alias("file_seq"),
        F.max_by(_new_status(), status_seq).alias("status"),
        F.max(status_seq).alias("status_seq"),
    ]


def current_state(journal: DataFrame) -> DataFrame:
    """State of every entity: newest file and newest status.

    ``max_by`` is associative and idempotent, so partial aggregation applies (a hot entity leaves
    each map task as one row), input order is free, and replayed events change nothing.
    """
    return (
        journal.groupBy("persistence_id")
        .agg(*fold_columns())
        .select(
            "persistence_id", "file",
            F.coalesce("status", F.lit(S.STATUS_NONE)).alias("status"),
        )
    )


def running_state(
    journal: DataFrame, slice_events: int = SLICE_EVENTS, longest: int | None = None
) -> DataFrame:
    """State after each handled event; the last row of an entity is its current state."""
    marked = split_handled(journal)[0].select(
        "persistence_id", "seq_nr", "event_type",
        F.when(_sets_file(), F.col("file")).alias("file"),
        F.when(_sets_status(), _new_status()).alias("status"),
    )
    run = carry_forward(
        marked, "persistence_id", "seq_nr", ["file", "status"], slice_events, longest=longest
    )
    return run.withColumn("status", F.coalesce("status", F.lit(S.STATUS_NONE)))


def snapshot(
    journal: DataFrame, every: int = S.SNAPSHOT_EVERY, keep: int = S.SNAPSHOT_KEEP,
    slice_blocks: int = 10_000, longest: int | None = None,
) -> DataFrame:
    """State at each ``every``-th event, newest ``keep`` per entity.

    Events are folded into one row per block of ``every`` first, so the running part sees a
    hundredth of the rows.
    """
    block = F.floor((F.col("seq_nr") - 1) / every)
    blocks = (
        journal.groupBy("persistence_id", block.alias("block"))
        .agg(F.max("seq_nr").alias("seq_nr"), *fold_columns())
    )
    if longest is not None:
        longest = (longest - 1) // every
    state = carry_forward(
        blocks, "persistence_id", "block", ["file", "file_seq", "status", "status_seq"],
        slice_blocks, first=0, longest=longest,
    )
    complete = state.filter(F.col("seq_nr") == (F.col("block") + 1) * every).select(
        "persistence_id", "seq_nr", "file", "file_seq",
        F.coalesce("status", F.lit(S.STATUS_NONE)).alias("status"), "status_seq",
    )
    return keep_latest(complete, keep)


def keep_latest(snapshots: DataFrame, keep: int = S.SNAPSHOT_KEEP) -> DataFrame:
    """Newest ``keep`` snapshots per entity.

    Spark limits each group before the shuffle as well, so at most ``keep`` rows per entity leave
    a map task.
    """
    newest_first = Window.partitionBy("persistence_id").orderBy(F.desc("seq_nr"))
    return (
        snapshots.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") <= keep)
        .drop("_rank")
    )


def tail_events(
    journal: DataFrame, snapshots: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Events newer than the entity's newest snapshot; all of them where it has none."""
    heads = snapshots.groupBy("persistence_id").agg(F.max("seq_nr").alias("_head"))
    return (
        join_unique(journal, heads, "persistence_id", hot_rows=hot_rows)
        .filter(F.col("seq_nr") > F.coalesce("_head", F.lit(0)))
        .drop("_head")
    )


def restore(snapshots: DataFrame, tail: DataFrame) -> DataFrame:
    """Current state from snapshots and later events.

    Snapshots carry the sequence numbers of their file and status, so both sides meet in one
    ``max_by``. A tail that overlaps the snapshots (a whole day partition, say) is harmless.
    """
    from_tail = tail.select(
        "persistence_id",
        F.when(_sets_file(), F.col("file")).alias("file"),
        F.when(_sets_file(), F.col("seq_nr")).alias("file_seq"),
        F.when(_sets_status(), _new_status()).alias("status"),
        F.when(_sets_status(), F.col("seq_nr")).alias("status_seq"),
    )
    both = snapshots.select(*from_tail.columns).unionByName(from_tail)
    return (
        both.groupBy("persistence_id")
        .agg(
            F.max_by("file", "file_seq").alias("file"),
            F.max_by("status", "status_seq").alias("status"),
        )
        .withColumn("status", F.coalesce("status", F.lit(S.STATUS_NONE)))
    )


def fold_events(
    journal: DataFrame, init: dict, fn: Callable[[dict, dict], dict], state_schema: str,
    merge: Callable[[dict, dict], dict] | None = None, key: str = "persistence_id",
    seq: str = "seq_nr", slice_events: int = SLICE_EVENTS,
) -> DataFrame:
    """Ordered fold of each entity's events with the caller's ``fn(state, event) -> state``.

    For folds that have no ``max_by`` form. Rows arrive sorted and are folded batch by batch, so
    memory holds one Arrow batch and one state however long an entity is. Without more knowledge a
    fold is sequential in its entity; with an associative ``merge(earlier, later)`` of two partial
    states (``init`` being neutral) long entities are cut into slices that fold in parallel.
    """
    key_type = journal.schema[key].dataType.simpleString()
    state_cols = [f.name for f in S.struct_type(state_schema)]
    if merge is None:
        schema = f"{key} {key_type}, {state_schema}"
        runner = _fold_runner([key], state_cols, init, fn, schema)
        return (
            journal.repartition(key).sortWithinPartitions(key, seq).mapInArrow(runner, schema)
        )
    schema = f"{key} {key_type}, _slice bigint, {state_schema}"
    partial = (
        journal.withColumn("_slice", F.floor((F.col(seq) - 1) / slice_events))
        .repartition(key, "_slice")
        .sortWithinPartitions(key, "_slice", seq)
        .mapInArrow(_fold_runner([key, "_slice"], state_cols, init, fn, schema), schema)
    )
    return fold_events(
        partial, init,
        lambda state, part: merge(state, {c: part[c] for c in state_cols}),
        state_schema, key=key, seq="_slice",
    )


def _fold_runner(keys, state_cols, init, fn, ddl):
    arrow_schema = to_arrow_schema(S.struct_type(ddl))

    def run(batches):
        current, state = None, None
        for batch in batches:
            done = []
            for event in batch.to_pylist():
                group = tuple(event[k] for k in keys)
                if group != current:
                    if current is not None:
                        done.append((current, state))
                    current, state = group, dict(init)
                state = fn(state, event)
            if done:
                yield _state_batch(done)
        if current is not None:
            yield _state_batch([(current, state)])

    def _state_batch(done):
        rows = [
            {**dict(zip(keys, group)), **{c: state.get(c) for c in state_cols}}
            for group, state in done
        ]
        return pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    return run
