"""File bytes: intake, size limit, chunks and output."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from reelfold import schemas as S
from reelfold.operators.skew import bounded_side
from reelfold.sources import file_source as SRC

# Bytes of one file that may meet in one row; larger files stay chunk rows.
ASSEMBLE_BYTES = 256 * 1024 * 1024
ASSEMBLE_CHUNKS = 100_000
PART_CHUNKS = 1024  # chunks of a file that one task writes
_BATCH_BYTES = 4 * 1024 * 1024


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below ``path``, those of no bytes included; content is read only where it is selected.

    The files are listed when this is called, folder by folder in tasks, and the list is a table on shared
    storage: the driver holds no file, however many there are (Spark's own listing keeps all of them there,
    gives about thirty small files to a task and leaves out empty ones). ``path`` is a URI, or a path of the
    local file system.
    """
    found, tasks = SRC.list_files(spark, path, glob)
    return found.repartition(tasks).withColumn("content", SRC.contents(path))


def scan_chunks(
    spark: SparkSession, path: str, chunk_bytes: int, range_bytes: int = SRC.RANGE_BYTES,
    keep_empty: bool = False, glob: str | None = None,
) -> DataFrame:
    """``path, chunk_no, length, data`` of the files below ``path``, without a whole file in a row.

    Contiguous ranges of about ``range_bytes`` are planned from the listing: each is opened once, by one
    task, and nothing is shuffled.
    """
    SRC.register(spark)
    reader = spark.read.format(SRC.FILE_RANGES).option("path", path).option("chunk_bytes", str(chunk_bytes))
    reader = reader.option("range_bytes", str(range_bytes)).option("keep_empty", str(keep_empty).lower())
    return (reader.option("glob", glob) if glob else reader).load()


def limit_size(df: DataFrame, max_bytes: int = S.MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected files; one of unknown length is rejected.

    The filter reaches the scan, so rejected bytes stay unread.
    """
    accepted = df.filter(F.col("length") <= max_bytes)
    rejected = df.filter(F.col("length").isNull() | (F.col("length") > max_bytes))
    return accepted, rejected.drop("content") if "content" in df.columns else rejected


def chunk_files(
    files: DataFrame, chunk_bytes: int = S.PLAYBACK_CHUNK_BYTES, keep_empty: bool = False
) -> DataFrame:
    """Split ``(file_id, content)`` into pieces ``(file_id, chunk_no, data)``.

    An empty file has no piece, or one empty piece with ``keep_empty``.
    """
    length = F.length("content")
    last = F.ceil(length / F.lit(chunk_bytes)).cast("int") - 1
    if keep_empty:
        last = F.greatest(last, F.lit(0))
    numbers = F.when(last >= 0, F.sequence(F.lit(0), last))
    return files.select("file_id", "content", F.explode(numbers).alias("chunk_no")).select(
        "file_id", "chunk_no",
        F.substring("content", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"),
    )


def read_chunks(
    listing: DataFrame, chunk_bytes: int, tasks: int | None = None, range_bytes: int = SRC.RANGE_BYTES
) -> DataFrame:
    """Chunk rows of files given as ``(file_id, path, length)`` without a whole file in a row.

    Ranges of consecutive chunks are planned from the lengths and spread over tasks, so one huge file is
    read by many; each range is opened once. What is shuffled is the ranges, not the bytes.
    """
    step = max(1, range_bytes // chunk_bytes)
    last = (F.ceil(F.col("length") / F.lit(chunk_bytes)) - 1).cast("bigint")
    ranges = listing.select(
        "file_id", "path", last.alias("last"),
        F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last, F.lit(step).cast("bigint"))))
        .alias("first"),
    )
    keys = ["path", "first"]
    spread = ranges.repartition(tasks, *keys) if tasks else ranges.repartition(*keys)
    fields = to_arrow_schema(S.struct_type(S.CHUNKS))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, name = pafs.FileSystem.from_uri(row["path"])
                rows, held = [], 0
                with system.open_input_file(name) as source:
                    source.seek(row["first"] * chunk_bytes)
                    for number in range(row["first"], min(row["last"], row["first"] + step - 1) + 1):
                        rows.append({"file_id": row["file_id"], "chunk_no": number, "data": source.read(chunk_bytes)})
                        held += chunk_bytes
                        if held >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return spread.mapInArrow(run, S.CHUNKS)


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk: a chunk that was sent again repeats bytes it already has."""
    return chunks.groupBy("file_id", "chunk_no").agg(F.max("data").alias("data"))


def file_sizes(chunks: DataFrame, chunk_bytes: int | None = None) -> DataFrame:
    """``file_id, n_chunks, length, complete`` per file; complete means no chunk is missing.

    With ``chunk_bytes``, the size no chunk exceeds, ``length`` is an upper bound and the data
    column is not read.
    """
    size = F.lit(chunk_bytes) if chunk_bytes else F.length("data")
    return (
        chunks.groupBy("file_id", "chunk_no").agg(F.max(size).cast("bigint").alias("_bytes"))
        .groupBy("file_id")
        .agg(
            F.count(F.lit(1)).alias("n_chunks"),
            F.sum("_bytes").alias("length"),
            (F.count(F.lit(1)) == F.max("chunk_no") + 1).alias("complete"),
        )
    )


def oversize_files(
    chunks: DataFrame, max_bytes: int = ASSEMBLE_BYTES, chunk_bytes: int | None = None
) -> DataFrame:
    """Files with too many bytes or chunks for one row."""
    return file_sizes(chunks, chunk_bytes).filter(
        (F.col("length") > max_bytes) | (F.col("n_chunks") > ASSEMBLE_CHUNKS)
    )


def reassemble_chunks(
    chunks: DataFrame, max_bytes: int = ASSEMBLE_BYTES, chunk_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Whole files ``(file_id, data, n_chunks, complete)``, and chunk rows of oversize ones.

    Only files up to ``max_bytes`` are put together, so a group that meets in one task is bounded;
    a larger file keeps its chunk rows, which ``write_files`` turns into a file in order.
    """
    large, count = bounded_side(oversize_files(chunks, max_bytes, chunk_bytes).select("file_id"))
    if count == 0:
        return _assemble(chunks), distinct_chunks(chunks.filter(F.lit(False)))
    return (
        _assemble(chunks.join(large, "file_id", "left_anti")),
        distinct_chunks(chunks.join(large, "file_id", "left_semi")),
    )


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """``file_id, digest, length, n_chunks, complete``: the MD5 of each file, from its chunks in order.

    Rows arrive sorted and are added as they come, so memory holds one batch, whatever a file's size.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        names = ["file_id", "digest", "length", "n_chunks", "complete"]

        def row(held):
            file_id, md5, length, n, last = held
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file_id], kind), pa.array([md5.hexdigest()]), pa.array([length], pa.int64()),
                    pa.array([n], pa.int64()), pa.array([n == last + 1]),
                ],
                names=names,
            )

        held = kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for file_id, no, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held is None or held[0] != file_id:
                    if held is not None:
                        yield row(held)
                    held = [file_id, hashlib.md5(), 0, 0, no]
                held[1].update(data or b"")
                held[2] += len(data or b"")
                held[3] += 1
                held[4] = no
        if held is not None:
            yield row(held)

    kind = chunks.schema["file_id"].dataType.simpleString()
    rows = distinct_chunks(chunks).repartition("file_id").sortWithinPartitions("file_id", "chunk_no")
    return rows.select("file_id", "chunk_no", "data").mapInArrow(
        run, f"file_id {kind}, digest string, length bigint, n_chunks bigint, complete boolean"
    )


def _assemble(chunks: DataFrame) -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct("chunk_no", "data")))
    # joined as hex in one pass: appending piece by piece would copy the file once per piece
    joined = F.array_join(F.transform(F.col("_pieces"), lambda p: F.hex(p["data"])), "")
    return (
        # one shuffle on the file serves both groupings
        distinct_chunks(chunks.repartition("file_id"))
        .groupBy("file_id")
        .agg(
            pieces.alias("_pieces"),
            F.count(F.lit(1)).alias("n_chunks"),
            (F.count(F.lit(1)) == F.max("chunk_no") + 1).alias("complete"),
        )
        .select("file_id", F.unhex(joined).alias("data"), "n_chunks", "complete")
    )


def write_files(
    chunks: DataFrame, out_dir: str, tasks: int | None = None, chunks_per_part: int | None = PART_CHUNKS
) -> DataFrame:
    """Write files below ``out_dir`` in chunk order, all or none; result ``(file_id, path, length)``.

    A file becomes a folder ``<file_id>`` of numbered parts of ``chunks_per_part`` chunks, which different
    tasks write; with None it becomes one file, written by one task. Bytes are shuffled once; a chunk that
    was sent again is dropped as its task writes, so memory holds one batch. Everything is in a new folder
    ``run-…`` that appears when all tasks are done: a failed job leaves nothing to list. ``out_dir`` is a
    URI or path that all executors share.
    """
    spark = chunks.sparkSession
    SRC.register(spark)
    run = uuid.uuid4().hex
    part = F.floor(F.col("chunk_no") / chunks_per_part) if chunks_per_part else F.lit(0)
    rows = chunks.select(
        F.col("file_id").cast("string").alias("file_id"), part.cast("bigint").alias("part"),
        F.col("chunk_no").cast("int").alias("chunk_no"), "data",
    )
    keys = ["file_id", "part"]
    spread = rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)
    (
        spread.sortWithinPartitions("file_id", "part", "chunk_no")
        .write.format(SRC.FILE_PARTS).mode("append")
        .option("path", out_dir).option("run", run).option("parts", str(bool(chunks_per_part)).lower())
        .save()
    )
    found = spark.read.schema("file_id string, part bigint, path string, length bigint").json(f"{out_dir}/_files/run-{run}")
    return found.select("file_id", F.concat(F.lit(f"{out_dir.rstrip('/')}/run-{run}/"), "path").alias("path"), "length")
