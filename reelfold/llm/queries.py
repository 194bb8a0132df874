"""The operators of this package on the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelfold.llm import (
    ann, decontaminate, jaccard, language, negatives, packing, pages, repair, secrets, sharding, simhash,
    toxicity, whitening,
)
from reelfold.llm.tokens import vocabulary_path
from reelfold.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 40
NEIGHBOURS = 20


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_blob_ledger(spark, d):
    found = secrets.scan_versions(table(spark, d, "documents"), scratch_path(spark, "blob-ledger"))
    return secrets.digest(found)


@query
def op3_byte_shards(spark, d):
    return sharding.shard_by_bytes(table(spark, d, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_block_join(spark, d):
    vectors = table(spark, d, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, NEIGHBOURS)


ORACLES["op4_block_join"] = f"""
    WITH usable AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
        FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM scored
    ) WHERE rank <= {NEIGHBOURS}
"""


@query
def op5_tag_paths(spark, d):
    return pages.extract(table(spark, d, "pages"))


@query
def op6_family_duels(spark, d):
    docs = table(spark, d, "documents")
    return language.identify(docs, language.fit(docs))


@query
def op7_dictionary_distance(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, d, "labels")))


@query
def op8_concat_cut(spark, d):
    return packing.pack(
        table(spark, d, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=1, with_ids=False
    )


@query
def op9_repair_files(spark, d):
    files = repair.write_files(
        table(spark, d, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=0
    )
    return repair.read_documents(files, with_ids=False)


@query
def op2_gray_index(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"), shingle=3, radius=2)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op10_fm_index(spark, d):
    found = decontaminate.contamination(
        table(spark, d, "documents"), table(spark, d, "benchmark")
    )
    return decontaminate.digest(found)


@query
def op11_cholesky_jacobi(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))


@query
def op12_signature_trees(spark, d):
    return jaccard.similar_sets(table(spark, d, "documents"))


ORACLES["op12_signature_trees"] = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), sets AS (
        SELECT doc_id, list_distinct(CASE
            WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
            WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
            END) AS s
        FROM words
    ), shingles AS (
        SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets
    ), links AS MATERIALIZED (
        SELECT a.doc_id AS u, b.doc_id AS v
        FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n
        HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ), reached(doc_id, r) AS (
        SELECT doc_id, doc_id FROM sets
        UNION
        SELECT reached.doc_id, links.v FROM reached JOIN links ON links.u = reached.r
    ), least AS (
        SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id
    )
    SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
    FROM sets JOIN least ON least.doc_id = sets.doc_id
"""


@query
def op13_box_tree(spark, d):
    vectors = table(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, label)


ORACLES["op13_box_tree"] = """
    WITH usable AS (
        SELECT vec_id,
            CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
            CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
        FROM usable a JOIN usable c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
    ), positives AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place
            FROM scored WHERE same
        ) WHERE place <= 5
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM (
        SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id,
            p.score AS positive_score, n.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
            AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    ) WHERE rank <= 3
"""
