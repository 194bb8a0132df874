"""Bounded samples of labelled rows, the only rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ROWS = 2000  # of each class
BYTES = 16_000_000  # of texts of each class


def labelled_sample(
    docs: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text",
    per_class: int = ROWS, bytes_per_class: int = BYTES, marks: DataFrame | None = None,
) -> list[tuple[object, str, object]]:
    """Up to ``per_class`` (id, text, label) rows of every label, in the order of a hash of the id, for as
    long as their texts fit ``bytes_per_class`` (one text is taken in any case).

    The label is a column of ``docs``, or of ``marks`` (one row for each id). Rows without id, label or
    text are no candidates. Rows are chosen by id and size, so no text is shuffled; Spark keeps the first
    rows of a label in each task, so no label's rows meet in one place.
    """
    known = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    size = F.octet_length(text_col).alias("_size")
    if marks is None:
        slim = known.select(id_col, label, size)
    else:
        slim = known.select(id_col, size).join(marks.select(id_col, label), id_col)
    order = Window.partitionBy(label).orderBy(F.xxhash64(id_col), id_col, "_size")
    slim = (
        slim.filter(F.col(label).isNotNull())
        .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_class)
    )
    chosen, used = {}, {}
    for row in slim.orderBy(label, "_rank").collect():
        total = used.get(row[label], 0) + row["_size"]
        if total <= bytes_per_class or row[label] not in used:
            used[row[label]] = total
            chosen[row[id_col]] = row[label]
    if not chosen:
        return []
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen], f"{id_col} {kind}"))
    of_docs = [label] if marks is None else []
    found = known.join(ids, id_col, "left_semi").select(id_col, text_col, *of_docs).collect()
    rows = {(r[0], r[1], r[2] if of_docs else chosen[r[0]]) for r in found}
    return sorted((r for r in rows if r[2] is not None), key=lambda r: (str(r[0]), str(r[2]), r[1]))
