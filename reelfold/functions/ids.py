"""Identifiers: UUID parsing, derived ids, event tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reelfold import schemas as S

CANONICAL_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
LOOSE_UUID = "^[0-9a-fA-F]+(-[0-9a-fA-F]+){4}$"
UUID_GROUPS = (8, 4, 4, 4, 12)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def uuid_shaped(key: Column | str) -> Column:
    """A stable id in UUID form, derived from ``key``."""
    text = F.md5(_col(key).cast("string"))
    # dashes are inserted one by one so that the digest is computed once
    for position in (9, 14, 19, 24):
        text = F.overlay(text, F.lit("-"), position, 0)
    return text


def parse_uuid(text: Column | str) -> Column:
    """Canonical UUID text, or null when ``text`` is not five dash-separated hex groups.

    Short groups are left-padded with zeros and long ones keep their low digits.
    """
    text = _col(text)
    parts = F.split(text, "-")
    groups = [
        F.lower(F.right(F.lpad(F.get(parts, F.lit(i)), 36, "0"), F.lit(width)))
        for i, width in enumerate(UUID_GROUPS)
    ]
    loose = text.rlike(LOOSE_UUID) & (F.length(text) <= 36)
    # nearly all ids are canonical and need no padding
    return F.when(text.rlike(CANONICAL_UUID), F.lower(text)).when(loose, F.concat_ws("-", *groups))


def route_id_valid(text: Column | str) -> Column:
    """Whether ``text`` is a full canonical UUID (stricter than :func:`parse_uuid`)."""
    return _col(text).rlike(CANONICAL_UUID)


def java_hash(text: Column | str) -> Column:
    """32-bit ``31*h + char`` hash of ASCII text, as a signed bigint."""
    unsigned = F.aggregate(
        F.split(_col(text), ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: (acc * 31 + F.ascii(ch)) % 4294967296,
    )
    return F.when(unsigned >= 2147483648, unsigned - 4294967296).otherwise(unsigned)


def event_tag(entity_id: Column | str, n: int = S.TAG_COUNT, prefix: str = "file") -> Column:
    """``<prefix>-<|hash % n|>``: remainder first, then the absolute value."""
    return F.concat(F.lit(prefix + "-"), F.abs(java_hash(entity_id) % n).cast("string"))
