"""Contiguous shards of near equal bytes, cut by a prefix sum over all rows.

Rows are ordered by id (a range shuffle of id, size and CRC; texts stay where they are) and numbered by
partition. Totals of the partitions, summed up in order, give every partition its place in the corpus; a
running sum inside it gives every row its own. The byte axis is cut at equal targets and a row belongs
to the shard that holds its middle byte, so shards are contiguous and differ by about a row's size.

Rows: a null text has no bytes besides the fixed ones; null ids come first, repeated ids follow each
other by size and CRC, equal rows in any order; other columns are not read. Fewer rows than shards leave
some shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reelfold.llm.tables import stored, totals_before

ROW_BYTES = 16  # counted for every row besides its text


def shard_by_bytes(
    docs: DataFrame, shards: int, row_bytes: int = ROW_BYTES, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): ``slot`` counts a shard's rows from 0 in order of id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the tie-break keeps rows of one id from having to share a partition
    order = ["_id", "size", "text_crc32", "_tie"]
    rows = stored(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + row_bytes).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("_tie"),
        )
        .repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id()),
        "row-sizes",
    )
    bases = totals_before(
        rows.withColumn("_one", F.lit(1)), "_part", {"_base": "size", "_rows": "_one"}
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    upto = Window.partitionBy("_part").orderBy(*order)
    before = F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.col("_base") + before - F.ceil(F.col("size") / 2).cast("bigint")
    # whole numbers throughout: a cut lies at shard * total / shards
    shard = F.expr(f"cast((cast(_middle as decimal(38,0)) * {shards}) div {max(total, 1)} as int)")
    placed = (
        rows.join(F.broadcast(bases), "_part")
        .select(
            "_id", "size", "text_crc32", middle.alias("_middle"),
            (F.col("_rows") + F.row_number().over(upto) - 1).alias("_rank"),
        )
        .withColumn("shard", shard)
    )
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard",
        (F.col("_rank") - F.col("_first")).alias("slot"),
    )
