"""Substring search that reads only files of the catalogue that can hold the key.

Below a path lie ``rows/append=…`` (the catalogue as Parquet files) and ``grams/append=…``: for each file
the three-letter pieces that its searched values have, once each. Values are marked at both ends first, so
that keys of one or two letters are inside some piece as well. A search looks up the pieces of its key,
opens the files that have all of them and confirms with the plain search. Files that no index covers yet
are read, so a search is right at any moment.
"""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelfold.operators.catalog import SEARCHED, search

SIZE = 3
_START, _END = "\x02", "\x03"


def _appends(path: str, kind: str, complete: bool) -> set[str]:
    system, base = pafs.FileSystem.from_uri(path)
    found = system.get_file_info(pafs.FileSelector(posixpath.join(base, kind), allow_not_found=True))
    names = {i.base_name for i in found if i.type == pafs.FileType.Directory and i.base_name.startswith("append=")}
    if not complete:
        return names
    marks = {n: posixpath.join(base, kind, n, "_SUCCESS") for n in names}
    return {n for n, mark in marks.items() if system.get_file_info(mark).type == pafs.FileType.File}


def grams(value: Column) -> Column:
    """The pieces of a marked value, each once; null for null."""
    marked = F.concat(F.lit(_START), value, F.lit(_END))
    last = F.length(marked) - (SIZE - 1)
    pieces = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(marked, i, SIZE))
    return F.array_distinct(F.when(last >= 1, pieces))


def append_catalog(catalog: DataFrame, path: str, files: int | None = None) -> None:
    """Add rows, near names in one file, and index them. ``files`` is the number of files at most."""
    name = f"append={uuid.uuid4().hex}"
    ordered = catalog.repartitionByRange(files, "file.file_name") if files else catalog.repartitionByRange("file.file_name")
    ordered.write.parquet(f"{path}/rows/{name}")
    index_appends(catalog.sparkSession, path)


def index_appends(spark: SparkSession, path: str) -> int:
    """Index every append that has none, or none that was finished; how many there were."""
    missing = sorted(_appends(path, "rows", True) - _appends(path, "grams", True))
    for name in missing:
        rows = spark.read.parquet(f"{path}/rows/{name}")
        of_row = F.array_distinct(F.flatten(F.filter(
            F.array(*[grams(F.col(c)) for c in SEARCHED]), lambda g: g.isNotNull()
        )))
        found = rows.select(F.col("_metadata.file_name").alias("in_file"), F.explode(of_row).alias("gram")).distinct()
        # sorted, so that a look-up reads the row groups of its pieces
        found.repartitionByRange("gram", "in_file").sortWithinPartitions("gram", "in_file").write.mode(
            "overwrite"
        ).parquet(f"{path}/grams/{name}")
    return len(missing)


def candidate_files(spark: SparkSession, path: str, key: str) -> list[str] | None:
    """Files that can hold ``key``, unindexed ones among them; None for all. One name a file comes to the
    driver, as in Spark's own listing."""
    if not key:
        return None
    rows, indexed = _appends(path, "rows", True), _appends(path, "grams", True)
    found = [f"{path}/rows/{name}" for name in sorted(rows - indexed)]
    known = sorted(rows & indexed)
    if known:
        index = spark.read.option("basePath", f"{path}/grams").parquet(*[f"{path}/grams/{n}" for n in known])
        if len(key) < SIZE:
            hits = index.filter(F.col("gram").contains(key)).select("append", "in_file").distinct()
        else:
            pieces = sorted({key[i : i + SIZE] for i in range(len(key) - SIZE + 1)})
            hits = index.filter(F.col("gram").isin(pieces)).groupBy("append", "in_file").agg(F.count(F.lit(1)).alias("n"))
            hits = hits.filter(F.col("n") == len(pieces))
        found += [f"{path}/rows/append={r['append']}/{r['in_file']}" for r in hits.orderBy("append", "in_file").collect()]
    return found


def search_indexed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """:func:`search` over the catalogue at ``path``: case-sensitive, no wildcards, duplicates kept."""
    files = candidate_files(spark, path, key)
    whole = spark.read.parquet(f"{path}/rows")
    columns = [c for c in whole.columns if c != "append"]
    if files is None:
        return search(whole.select(*columns), key)
    if not files:
        return whole.select(*columns).limit(0)
    return search(spark.read.schema(whole.select(*columns).schema).parquet(*files), key)
