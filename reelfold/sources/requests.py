"""Request bodies, one JSON document per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelfold.operators.validate import parse_body


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """``raw`` and the parsed ``body``; a line that is not JSON has a null body and is kept."""
    return parse_body(spark.read.text(path).withColumnRenamed("value", "raw"))
