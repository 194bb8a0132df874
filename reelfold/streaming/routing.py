"""Message routing on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from reelfold.operators.routing import broadcast_messages, route_to


def route_stream(
    messages: DataFrame, registrations: Callable[[], DataFrame], path: str, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Deliveries of a message stream ``(id, msg, ts)``; a null id is for everyone.

    Registrations are read afresh for every micro-batch (``registrations`` is a function), so
    consumers come and go without state in the query. Each batch overwrites its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        active = registrations()
        routed = route_to(batch.filter(F.col("id").isNotNull()), active)
        everyone = broadcast_messages(batch.filter(F.col("id").isNull()), active)
        deliveries = routed.select("id", "ref", "msg", "ts").unionByName(
            everyone.select("id", "ref", "msg", "ts")
        )
        deliveries.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def route_streams(
    messages: DataFrame, registrations: DataFrame, delay: str, valid_for: str
) -> DataFrame:
    """Stream-stream form: registrations ``(id, ref, registered_at)`` hold for ``valid_for``.

    Both sides are watermarked and the match is bounded in time, so old rows leave the state.
    """
    sent = messages.withWatermark("ts", delay)
    known = registrations.withColumnRenamed("id", "_id").withWatermark("registered_at", delay)
    in_time = (F.col("ts") >= F.col("registered_at")) & (
        F.col("ts") < F.col("registered_at") + F.expr(f"INTERVAL {valid_for}")
    )
    return sent.join(known, (F.col("id") == F.col("_id")) & in_time).select("id", "ref", "msg", "ts")
