"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings the operators are designed for. All of them are ordinary public options; AQE and its
# skew-join split are Spark's defaults and are repeated so a cluster default cannot turn them off.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # the JVM never compiles methods above 8000 bytes, so let wide projections be generated in parts
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def build_session(app_name: str = "reelfold", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    A machine-local folder is set up only in local mode with the option unset (tests); on a cluster
    a missing option is an error, since lost executors would take local files with them.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="reelfold-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created there."""
    return os.path.join(shared_dir(spark).rstrip("/"), "reelfold", f"{label}-{uuid.uuid4().hex}")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = shared_dir(spark)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once as Parquet on shared storage and read back.

    For frames that several passes read: later passes prune columns and push filters into the
    copy, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
