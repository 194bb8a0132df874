"""Progress and routing messages as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reelfold import schemas as S
from reelfold.functions import variants as V
from reelfold.functions.ids import parse_uuid


def message_json(message_id: Column | str, msg: Column | str) -> Column:
    """``{"id":…,"msg":…}`` with proper quoting."""
    message_id = F.col(message_id) if isinstance(message_id, str) else message_id
    msg = F.col(msg) if isinstance(msg, str) else msg
    return F.to_json(F.struct(message_id.alias("id"), msg.alias("msg")))


def parse_command(v: Column) -> Column:
    """Struct ``(id, msg, error)`` of an incoming command held as VARIANT.

    Both fields must be strings and the id a UUID; otherwise only ``error`` is set.
    """
    uuid = parse_uuid(V.extract(v, "$.id", V.STRING, None).value)
    msg = V.extract(v, "$.msg", V.STRING, None).value
    valid = F.coalesce(uuid.isNotNull() & msg.isNotNull(), F.lit(False))
    return F.struct(
        F.when(valid, uuid).alias("id"),
        F.when(valid, msg).alias("msg"),
        F.when(~valid, F.lit(S.INVALID_COMMAND)).alias("error"),
    )
