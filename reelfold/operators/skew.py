"""Ordered per-key work that stays balanced when one key holds much of the data.

A window partitioned by the key alone puts a whole key into one task. The helpers here cut long
keys into slices, work on each slice by itself and carry only slice totals across.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelfold.session import reliable_checkpoint

# A window task sorts this many rows of one key without trouble.
HOT_ROWS = 2_000_000
# Above this share of all rows a key may count as hot, so fewer than 100,000 keys ever do and the
# hot list (an id per row) stays a few megabytes whatever the size of the table.
HOT_SHARE = 100_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int] | None:
    """Keys with more than ``hot_rows`` rows and their row total, or None when there are none.

    One narrow pass: only the key column is read, and counts are combined before the shuffle.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    threshold = max(hot_rows, (total or 0) // HOT_SHARE)
    if largest is None or largest <= threshold:
        return None
    hot = reliable_checkpoint(sizes.filter(F.col("_rows") > threshold))
    return hot.select(key), hot.agg(F.sum("_rows")).first()[0]


def bounded_side(df: DataFrame, max_rows: int = HOT_SHARE) -> tuple[DataFrame, int]:
    """A join side with its row count, marked for broadcast only when at most ``max_rows`` long.

    A longer side comes back unmarked and is joined by shuffle.
    """
    kept = reliable_checkpoint(df)
    rows = kept.count()
    return (F.broadcast(kept) if rows <= max_rows else kept), rows


def join_unique(
    left: DataFrame, right: DataFrame, key: str, how: str = "left",
    spread_by: list[str] | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left`` joined with a side of one row per key, whatever share of ``left`` one key holds.

    AQE splits a skewed join only where both sides arrive straight from a shuffle, which an
    aggregated side does not. So the keys are counted first (one narrow pass): rows of hot keys
    meet their few partner rows by broadcast and never shuffle, the others join as Spark sees fit.
    Null keys match nothing; ``spread_by`` names columns to scatter them by, where there may be
    many.
    """
    if spread_by:
        scattered = F.concat(F.lit("\0"), F.xxhash64(*spread_by).cast("string"))
        left = left.withColumn("_join", F.coalesce(F.col(key), scattered))
        right = right.withColumnRenamed(key, "_join")
        return join_unique(left, right, "_join", how, None, hot_rows).drop("_join")
    found = hot_keys(left.filter(F.col(key).isNotNull()), key, hot_rows)
    if found is None:
        return left.join(right, key, how)
    hot = F.broadcast(found[0])  # fewer than HOT_SHARE ids, and one partner row for each
    partners = F.broadcast(right.join(hot, key, "left_semi"))
    cold = left.join(hot, key, "left_anti").join(right, key, how)
    return cold.unionByName(left.join(hot, key, "left_semi").join(partners, key, how))


def number_rows(
    df: DataFrame, key: str, order: list[str], out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Gap-free numbers from 1 per key in ``order`` (a total order within the key).

    Ordinary keys take one hash shuffle on the key. Rows of hot keys are range-partitioned on key
    and order instead, so one key spreads over many slices; each slice is numbered by itself and
    shifted by the row counts of the slices before it.
    """
    found = hot_keys(df, key, hot_rows)
    local = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")
    if found is None:
        return df.withColumn(out, local)
    hot, hot_total = found
    hot = F.broadcast(hot.select(F.col(key).alias("_hot")))  # fewer than HOT_SHARE ids
    is_hot = F.col(key).eqNullSafe(F.col("_hot"))  # rows without a key may be many as well
    cold_rows = df.join(hot, is_hot, "left_anti").withColumn(out, local)

    slices = max(2, math.ceil(2 * hot_total / hot_rows))
    # Range bounds come from a sample, so the slices must be fixed before they are read twice.
    sliced = reliable_checkpoint(
        df.join(hot, is_hot, "left_semi")
        .repartitionByRange(slices, key, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(key, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            F.col(key).alias("_of"), F.col("_slice").alias("_at"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        )
    )
    same = F.col(key).eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_at"))
    within = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order))
    hot_rows_df = (
        # a key spans neighbouring slices only: at most hot keys + slices offset rows
        sliced.withColumn(out, within)
        .join(F.broadcast(offsets), same)
        .withColumn(out, (F.col(out) + F.col("_before")).cast("bigint"))
        .drop("_slice", "_before", "_of", "_at")
    )
    return cold_rows.unionByName(hot_rows_df)


def carry_forward(
    df: DataFrame, key: str, position: str, columns: list[str], slice_len: int, first: int = 1,
    longest: int | None = None,
) -> DataFrame:
    """Replace each column by its last non-null value up to and including the row.

    ``position`` counts from ``first`` within the key. Keys are cut into slices of ``slice_len``
    positions: rows shuffle once, on key and slice, and each slice starts from the values its
    predecessors ended with (one row per slice). When no key reaches a second slice
    (``longest``, looked up if not given) the carried values are left out of the plan.
    """
    if longest is None:
        longest = df.agg(F.max(position)).first()[0]
    if longest is None or longest - first < slice_len:
        return _run_within(df, columns, [key], position)

    sliced = df.withColumn("_slice", F.floor((F.col(position) - first) / slice_len))
    ends = sliced.groupBy(key, "_slice").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_in_{c}")
            for c in columns
        ]
    )
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        key, "_slice",
        *[F.last(f"_in_{c}", ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns],
    ).filter(reduce(or_, [F.col(f"_in_{c}").isNotNull() for c in columns]))
    run = _run_within(sliced, columns, [key, "_slice"], position)
    joined = run.join(carried, [key, "_slice"], "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.col(f"_in_{c}")))
    return joined.select(*df.columns)


def _run_within(df: DataFrame, columns: list[str], keys: list[str], position: str) -> DataFrame:
    upto = (
        Window.partitionBy(*keys).orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running: dict[str, Column] = {
        c: F.last(c, ignorenulls=True).over(upto) for c in columns
    }
    return df.withColumns(running)
