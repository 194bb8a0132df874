"""Bounded outgoing buffers: messages wait for their consumer, and one that falls behind is failed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from reelfold import schemas as S
from reelfold.streaming.visibility import _remove

CAPACITY = 10  # messages that a consumer may have waiting
MESSAGE, READ, LEAVE = "message", "read", "leave"  # what an event does to a consumer's buffer
DELIVERED, OVERFLOW = "delivered", "overflow"
EVENTS = "ref string, seq bigint, kind string, id string, msg string, ts timestamp, take int"
DELIVERIES = "ref string, seq bigint, outcome string, id string, msg string, ts timestamp"
# a consumer's buffer between micro-batches: a row for how far it got, and one for each waiting message
MARK, WAITING, DELIVERY, FAILED = "mark", "waiting", "delivery", "failed"
STEPS = f"{DELIVERIES}, row string"
_ROWS = 10_000


def _steps(batches: Iterator[pa.RecordBatch], capacity: int, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Deliveries and the buffers left over, from rows sorted by consumer: its buffer, then its events.

    Rows are taken as they come, so memory holds an Arrow batch and one buffer, whatever a consumer gets.
    """
    out: list[tuple] = []
    ref, last, failed, waiting = None, None, False, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        columns[5] = pa.array(columns[5], pa.int64()).cast(fields.field(5).type)
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields
        )

    def keep() -> None:
        out.append((ref, last, FAILED if failed else None, None, None, None, MARK))
        out.extend((ref, seq, None, i, msg, ts, WAITING) for seq, i, msg, ts in waiting)

    for batch in batches:
        times = batch.column(5).cast(pa.int64())
        columns = [times if n == 5 else batch.column(n) for n in range(7)]
        for to, seq, kind, i, msg, ts, take in zip(*(c.to_pylist() for c in columns)):
            if to != ref:
                if ref is not None:
                    keep()
                    if len(out) >= _ROWS:
                        yield flush()
                ref, last, failed, waiting = to, None, False, []
            if kind == MARK:
                last, failed = seq, take == 1
                continue
            if kind == WAITING:
                waiting.append((seq, i, msg, ts))
                continue
            if last is not None and seq <= last:
                continue  # delivered again
            last = seq
            if kind == LEAVE:
                waiting, failed = [], False
            elif failed:
                continue
            elif kind == READ:
                count = len(waiting) if take is None else max(0, take)
                out += [(ref, n, DELIVERED, w, m, t, DELIVERY) for n, w, m, t in waiting[:count]]
                waiting = waiting[count:]
                if len(out) >= _ROWS:
                    yield flush()
            elif kind == MESSAGE and len(waiting) == capacity:
                waiting, failed = [], True
                out.append((ref, last, OVERFLOW, i, msg, ts, DELIVERY))
            elif kind == MESSAGE:
                waiting.append((seq, i, msg, ts))
    if ref is not None:
        keep()
    if out:
        yield flush()


def step_buffers(held: DataFrame, events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What one micro-batch of ``EVENTS`` does to the buffers ``held``: ``DELIVERIES`` rows with a ``row``,
    a delivery or a part of the buffers as they are then, in the form of ``held``.

    ``seq`` orders a consumer's events: a ``message`` for it, its ``read`` of the next ``take`` messages
    (null: all that wait), and ``leave``, which empties its buffer and ends a failure. A message that
    finds ``capacity`` others waiting fails the consumer: one ``overflow`` row, what waits is dropped and
    nothing more is delivered. An event at or below the last seen ``seq`` of its consumer is a replay and
    changes nothing. Events without consumer or ``seq`` are left out. The buffer of a consumer never
    exceeds ``capacity`` messages; others are not touched by a failure.
    """
    names = S.struct_type(EVENTS).fieldNames()
    known = events.filter(F.col("ref").isNotNull() & F.col("seq").isNotNull()).select(*names, F.lit(2).alias("_order"))
    kept = held.select(
        "ref", "seq", F.col("row").alias("kind"), "id", "msg", "ts",
        F.when(F.col("outcome") == FAILED, 1).cast("int").alias("take"),
        F.when(F.col("row") == MARK, 0).otherwise(1).alias("_order"),
    )
    fields = to_arrow_schema(S.struct_type(STEPS))
    rows = kept.unionByName(known).repartition("ref").sortWithinPartitions("ref", "_order", "seq")
    return rows.drop("_order").mapInArrow(lambda batches: _steps(batches, capacity, fields), STEPS)


def buffer_stream(
    events: DataFrame, path: str, checkpoint: str, capacity: int = CAPACITY, trigger: dict | None = None
) -> StreamingQuery:
    """Run :func:`step_buffers` into a table with a folder for each micro-batch, which a re-run overwrites.

    The buffers are rows of that table, not of a state store, which is asked several times for each
    consumer: a micro-batch reads those that the one before it left and writes all of them anew. Older ones
    are removed.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch_id == 0:
            held = session.createDataFrame([], STEPS)
        else:
            held = session.read.schema(STEPS).parquet(f"{path}/batch_id={batch_id - 1}").filter(F.col("row") != DELIVERY)
        steps = step_buffers(held, batch, capacity)
        steps.write.mode("overwrite").partitionBy("row").parquet(f"{path}/batch_id={batch_id}")
        for row in (MARK, WAITING):  # a re-run of this batch needs the one before, nothing older
            _remove(f"{path}/batch_id={batch_id - 2}/row={row}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"{STEPS}, batch_id bigint").parquet(path)
    return rows.filter(F.col("row") == DELIVERY).select(*S.struct_type(DELIVERIES).fieldNames())
