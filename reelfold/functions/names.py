"""File names, paths and extensions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reelfold.functions.ids import uuid_shaped


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _dotted(name: Column) -> tuple[Column, Column]:
    """Name without trailing dots, and its dot-separated parts."""
    stripped = F.regexp_replace(name, r"\.+$", "")
    return stripped, F.split(stripped, r"\.")


def get_ext(name: Column | str) -> Column:
    """Text after the last dot; ``tmp`` where there is no second part."""
    _, parts = _dotted(_col(name))
    return F.when(F.size(parts) <= 1, F.lit("tmp")).otherwise(F.element_at(parts, -1))


def get_extension(name: Column | str) -> Column:
    """As :func:`get_ext`, but a name without a dot is its own extension; only dots give null."""
    name = _col(name)
    stripped, parts = _dotted(name)
    only_dots = (stripped == "") & (name != "")
    return F.when(~only_dots, F.element_at(parts, -1))


def generate_name(key: Column | str, ts: Column | str, ext: Column | str) -> Column:
    """``<uuid>-<epoch seconds>.<ext>`` with the uuid derived from ``key``.

    A name drawn at random would change when a lost task is run again, so the row's own key gives it.
    """
    seconds = F.unix_seconds(_col(ts).cast("timestamp"))
    return F.concat(
        uuid_shaped(F.concat(F.lit("name:"), _col(key).cast("string"))),
        F.lit("-"),
        seconds.cast("string"),
        F.lit("."),
        _col(ext),
    )


def file_type(path: Column | str) -> Column:
    """Last ``/`` segment of a path, trailing slashes dropped."""
    path = _col(path)
    stripped = F.regexp_replace(path, "/+$", "")
    only_slashes = (stripped == "") & (path != "")
    return F.when(~only_slashes, F.element_at(F.split(stripped, "/"), -1))


def file_path(base: Column | str, folder: Column | str, name: Column | str) -> Column:
    return F.concat_ws("/", _col(base), _col(folder), _col(name))
