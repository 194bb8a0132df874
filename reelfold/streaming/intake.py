"""Upload intake as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelfold import schemas as S
from reelfold.sources.file_source import contents
from reelfold.sources.inventory import ARRIVALS, FOUND, PORTION, Arrivals, open_inventory

# Spark looks up the files of a micro-batch one by one, in up to 10,000 tasks, and counts 4 MB for opening each,
# so that about 30 small files make a task: for many portions nearly all of the time would go into tasks.
SMALL_FILES = {
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": ("10000", "200"),
    "spark.sql.files.openCostInBytes": ("4194304", "65536"),
}


def _for_small_files(spark: SparkSession) -> None:
    """Settings of the session, since a stream reads them when it starts; one that was set is kept."""
    for key, (usual, ours) in SMALL_FILES.items():
        if spark.conf.get(key).removesuffix("b") == usual:
            spark.conf.set(key, ours)


def intake_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int = 1000, glob: str | None = None, log: str | None = None
) -> DataFrame:
    """New files below ``path``, those of no bytes included; ``max_files_per_trigger`` is the back-pressure.

    The stream's source is an inventory (``sources.inventory``) that is brought up to date at each trigger: files
    in portions, so the driver holds portions and the names of some folders. Contents are read by a column
    function only where they are selected, dealt to as many tasks as a shuffle has. The inventory is in ``log``,
    or else in a hidden folder below ``path``, which must be writable then; it belongs to the checkpoints of the
    queries that read it, and without it they stop. Portions have ``max_files_per_trigger`` files, 1,000 at most,
    and are taken whole: a lower limit counts for files that are found after it was set. A file is taken as it is
    found, so uploads should be written under another name (a leading ``_`` or ``.``) and renamed when they are
    complete.
    """
    portion = max(1, min(max_files_per_trigger, PORTION))
    each = max(1, max_files_per_trigger // portion)
    log, portions = open_inventory(path, glob, log)
    spark.dataSource.register(Arrivals)
    _for_small_files(spark)
    arrivals = spark.readStream.format(ARRIVALS).option("path", path).option("log", log)
    arrivals = arrivals.option("portion", str(portion)).option("each", str(each))
    if glob:
        arrivals = arrivals.option("glob", glob)
    found = spark.readStream.schema(FOUND).option("maxFilesPerTrigger", str(each)).parquet(portions)
    # a portion is a small table, its files may be large
    spread = arrivals.load().unionByName(found).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.withColumn("content", contents(path))


def chunk_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Chunk rows arriving as Parquet files."""
    return (
        spark.readStream.schema(S.struct_type(S.CHUNKS))
        .option("maxFilesPerTrigger", str(max_files_per_trigger)).parquet(path)
    )
