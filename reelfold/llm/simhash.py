"""Near duplicates by SimHash and a Gray-order hierarchical index.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Fingerprints are
made distinct, so copies cost one row. Two that differ in at most ``radius`` of 64 bits agree on all but
``radius`` of any ``2 * radius`` blocks, so each fingerprint goes into a group for every choice of half of
the blocks, and linked ones meet in a group. Within a group fingerprints are sorted by Gray rank, which
puts those that share bits side by side. Runs of them form nodes: the bits that all members agree on are
factored into the node (a mask and a pattern), nodes form larger nodes the same way. A search goes down
from the top with pairs of nodes, adds up the differing bits of their common masks level by level, and
drops a pair, with everything below, as soon as the sum exceeds the radius. What is left are links; a
group hands on one link for each member it connects, never all pairs.

Groups of more than ``GROUP`` fingerprints are dealt again by three quarters of ``4 * radius`` blocks:
48 bits agree, so such a group holds 65,536 fingerprints at most, whatever the data.

Rows: a null or empty text, or one of white space only, has fingerprint zero and is linked as any other;
a text of fewer words than a shingle has one shingle. Repeated rows fall together with their copies. Rows
without id get a fingerprint, and the component of rows with the same one, if these have ids. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reelfold.llm.graph import components
from reelfold.llm.tables import in_batches, stored

SEED = 42
GROUP = 16_384
_FAN = 16
_PAIRS_AT_ONCE = 4096
_SMALL = 8  # groups up to this size are compared without an index
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# --- fingerprints -------------------------------------------------------------------------------


def shingle_digests(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included, as rows of eight bytes."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    n = len(words)
    if not n:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    if n <= shingle:
        digests = [xxh64_digest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - shingle + 1].tolist()
        digests = [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)


def majority(digests: np.ndarray) -> int:
    """64 bits, unsigned: those set in more than half of the digests."""
    bits = np.concatenate(
        [np.bincount(digests[:, i], minlength=256) @ _BYTE_BITS for i in range(8)]
    )
    return int.from_bytes(np.packbits(2 * bits > len(digests)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int) -> int:
    return majority(shingle_digests(text, shingle))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["doc_id", "fp"],
            )

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())]
    )
    return docs.select(id_col, text_col).transform(in_batches, compute, schema)


# --- index of one group -------------------------------------------------------------------------


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            again = labels[labels]
            if (again == labels).all():
                break
            labels = again
    return labels


def group_labels(fps: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints in Gray order: the index of the first that each is connected with."""
    n = len(fps)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(np.full(n, full), fps)]  # mask and pattern of each node, from the leaves up
    while len(levels[-1][0]) > 1:
        mask, pattern = levels[-1]
        starts = np.arange(0, len(mask), _FAN)
        shared = np.bitwise_and.reduceat(mask, starts)
        shared &= ~(np.bitwise_and.reduceat(pattern, starts) ^ np.bitwise_or.reduceat(pattern, starts))
        levels.append((shared, pattern[starts] & shared))
    labels = np.arange(n)
    step = np.arange(_FAN)
    # pairs of nodes still to look into: level, left, right, differing bits so far
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, left, right, differ = todo.pop()
        if level == 0:
            apart = left != right
            labels = _union(labels, left[apart], right[apart])
            continue
        if len(left) > _PAIRS_AT_ONCE:
            half = len(left) // 2
            todo += [(level, left[h], right[h], differ[h]) for h in (slice(half), slice(half, None))]
            continue
        above = levels[level][0][left] & levels[level][0][right]
        mask, pattern = levels[level - 1]
        i = np.repeat(left[:, None] * _FAN + step, _FAN, axis=1).ravel()
        j = np.tile(right[:, None] * _FAN + step, _FAN).ravel()
        parent = np.repeat(np.arange(len(left)), _FAN * _FAN)
        real = (i < len(mask)) & (j < len(mask)) & (i <= j)
        i, j, parent = i[real], j[real], parent[real]
        added = mask[i] & mask[j] & ~above[parent]  # bits factored out further up count there
        differ = differ[parent] + np.bitwise_count((pattern[i] ^ pattern[j]) & added)
        near = differ <= radius
        if near.any():
            todo.append((level - 1, i[near], j[near], differ[near]))
    return labels


# --- index of all -------------------------------------------------------------------------------


def _choices(blocks: int, kept: int) -> list[np.uint64]:
    """For every choice of ``kept`` of ``blocks`` blocks, the mask of their bits."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [np.uint64(sum(masks[b] for b in chosen)) for chosen in combinations(range(blocks), kept)]


def _grouped(fps: DataFrame, radius: int, blocks: int, kept: int) -> DataFrame:
    """(choice, bits, gray, fp, node): ``fps`` (fp, node) once for every choice of blocks."""
    choices = _choices(blocks, kept)
    kind = fps.schema["node"].dataType

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, mask in enumerate(choices):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(fp), number, np.int16)),
                        pa.array((fp & mask).view(np.int64)),
                        # of the bits outside the group's: those inside are the same for all
                        pa.array(gray_rank(fp & ~mask).view(np.int64)),
                        batch.column(0), batch.column(1),
                    ],
                    names=["choice", "bits", "gray", "fp", "node"],
                )

    schema = T.StructType([
        T.StructField("choice", T.ShortType()), T.StructField("bits", T.LongType()),
        T.StructField("gray", T.LongType()), T.StructField("fp", T.LongType()),
        T.StructField("node", kind),
    ])
    return fps.select("fp", "node").transform(in_batches, deal, schema)


def _group_links(grouped: DataFrame, radius: int) -> DataFrame:
    """(u, v): links that connect what is connected within each group."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            key = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("choice", "bits")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0  # the last group may go on in the next batch
            if last:
                yield from links(rows.slice(0, last), np.r_[0, cuts])
            held = rows.slice(last).combine_chunks()
        if held is not None:
            yield from links(held, np.array([0, held.num_rows]))

    def links(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = rows["fp"].to_numpy().view(np.uint64)
        sizes = np.diff(cuts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        left, right = [], []
        small = np.repeat(sizes <= _SMALL, sizes)
        for off in range(1, _SMALL):
            if off < len(fp):
                near = (group[off:] == group[:-off]) & small[off:]
                near &= np.bitwise_count(fp[off:] ^ fp[:-off]) <= radius
                at = np.flatnonzero(near)
                left.append(at)
                right.append(at + off)
        for g in np.flatnonzero(sizes > _SMALL):
            start = int(cuts[g])
            labels = group_labels(fp[start : int(cuts[g + 1])], radius)
            at = np.flatnonzero(labels != np.arange(len(labels)))
            left.append(start + at)
            right.append(start + labels[at])
        u, v = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
        if len(u):
            node = rows["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(u)), node.take(pa.array(v))], names=["u", "v"])

    kind = grouped.schema["node"].dataType
    return (
        grouped.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "gray")
        .select("choice", "bits", "fp", "node")
        .transform(in_batches, search, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))
    )


def links(fps: DataFrame, radius: int, group: int = GROUP) -> DataFrame:
    """(u, v) nodes of ``fps`` (fp distinct, node): their components are those of all pairs of
    fingerprints that differ in at most ``radius`` bits."""
    radius = max(radius, 1)
    coarse = _grouped(fps, radius, 2 * radius, radius)
    key = ["choice", "bits"]
    large = stored(coarse.groupBy(*key).count().filter(F.col("count") > group).select(*key), "large-groups")
    if large.isEmpty():
        return _group_links(coarse, radius)
    small = coarse.join(large, key, "left_anti")
    again = coarse.join(large, key, "left_semi").select("fp", "node").distinct()
    fine = _grouped(again, radius, 4 * radius, 3 * radius)
    return _group_links(small, radius).unionByName(_group_links(fine, radius))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text",
    group: int = GROUP,
) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id of all documents that links lead to, itself included."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    found = components(links(fps.filter(F.col("node").isNotNull()), radius, group))
    named = stored(
        fps.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")),
        "fingerprint-components",
    )
    # a fingerprint of many copies is split by Spark: both sides of this join come from a shuffle
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each group that links connect: the one of smallest ``doc_id``, once.

    Of several texts of that id in a group the one of smallest fingerprint stays, so rows of one id in
    different groups are different documents. Rows without id stay. Columns come back as they were.
    """
    found = near_duplicates(docs.filter(F.col("doc_id").isNotNull()), shingle, radius)
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "fp")).alias("first"))
    mark = "fp"
    while mark.lower() in {c.lower() for c in docs.columns}:
        mark = "_" + mark
    first = stored(first.select("first.doc_id", F.col("first.fp").alias(mark)), "first-of-groups")
    at = docs.columns.index("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.array(fps, np.uint64).view(np.int64))], names=schema.names
            )

    schema = T.StructType([*docs.schema, T.StructField(mark, T.LongType())])
    marked = docs.filter(F.col("doc_id").isNotNull()).transform(in_batches, compute, schema)
    kept = marked.join(first, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return kept.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
