"""JSON-lines output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row, in a single ``value`` column."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    to_json_lines(df).write.mode("overwrite").text(path)
