"""Documents to training sequences: five stages, each an operator of ``reelfold.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and reads it back as the next stage's ``docs``. All but the last return the columns of
documents.

1. language: rows whose language can't be told (no letter in the text) go.
2. near_duplicates: one document of each group stays whose SimHash fingerprints (three-word shingles) are
   linked at two or fewer bits.
3. decontamination: documents that hold ten consecutive words of a benchmark item go.
4. secrets: every secret in a text is replaced by its kind.
5. packing: pieces of documents in sequences of 2048 token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelfold.llm import decontaminate, language, packing, secrets, simhash
from reelfold.llm.tables import stored
from reelfold.llm.tokens import vocabulary_path
from reelfold.session import scratch_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, shingle=3, radius=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, benchmark)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, scratch_path(spark, "blob-ledger"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"), end_id=1, with_ids=False)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

# tokenising and fingerprints can't be written in SQL; tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
