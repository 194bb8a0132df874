"""Tables between two passes of an operator, and running totals over partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from reelfold.session import scratch_path

BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of ``BATCH_ROWS`` rows.

    A task holds a batch several times over (in the JVM, in Arrow, as Python strings), and rows here
    are whole texts, so Spark's default of 10,000 is too many. A session that sets a smaller number
    keeps it.
    """
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH_KEY)) > BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Later passes read the same rows whatever executors are lost meanwhile, and only the columns they
    need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def totals_before(df: DataFrame, key: str, amounts: dict[str, str]) -> DataFrame:
    """One row for each ``key``: for every ``{name: column}``, the column's sum over smaller keys.

    Meant for keys that number partitions: a row for each, so the ordered window over them is small
    (12 MB for a million partitions) and may be broadcast.
    """
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in amounts.items()])
    return sums.select(
        key, *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast("bigint").alias(n) for n in amounts]
    )
