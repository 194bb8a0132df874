"""Hard negatives by an R-tree over embeddings.

Vectors become integers and are dealt to blocks by label and first component. A block is packed by
sort-tile-recursive: sorted by label and sliced by its widest components in turn, until tiles of ``LEAF``
vectors are left. Tiles are the leaves of an R-tree; each node has the smallest and largest value of every
component and of the label below it. From such a box follow the largest and smallest inner product that an
anchor can have with anything in it.

An anchor searches a tree best-first: boxes leave a queue in the order of their largest possible score, and
a box is dropped where its label can't fit, where its scores lie outside the window asked for, or where its
largest is strictly below the k-th best found (a tie may still win by its id). Anchors are dealt to blocks,
too; a block of anchors and a block of vectors make a cell, searched by one task. First every anchor gets
its nearest rows of the same label; the window of each of these is then searched for rows of other labels.
The best of all cells are the result, so it is exact.

Rows: those with a null id or label, or whose vector is null, empty or holds null or non-finite
components, take no part; nor do those with a component of 2**40 or more in size. Vectors of different
lengths don't meet. An anchor leaves out the rows of its own id; repeated rows are repeated candidates,
repeated anchors get a list each. Scores are exact; those beyond 64 bits are given as the nearest 64-bit
number. A positive with no row in its window gives no rows. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from reelfold.llm.tables import in_batches, stored
from reelfold.llm.whitening import usable

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)  # per cent of the positive's score
LEAF = 128
_FAN = 8
_SLICED = 3  # components that slice a block
BLOCK_BYTES = 32_000_000
ANCHORS = 4096
_ANCHORS_AT_ONCE = 256
_EXACT = 1 << 53  # integers up to here are exact as floats
_LONG = (-(1 << 63), (1 << 63) - 1)


# --- the tree of one block ----------------------------------------------------------------------


def str_order(labels: np.ndarray, data: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows in sort-tile-recursive order: by label, then sliced by the widest components."""
    n = len(labels)
    widest = np.argsort(data.min(axis=0) - data.max(axis=0), kind="stable")[:_SLICED]
    order = np.argsort(labels, kind="stable")
    slices = max(1, math.ceil((n / leaf) ** (1 / (len(widest) + 1))))
    parts = np.array_split(order, slices)  # by label, which is one more coordinate
    for at, column in enumerate(widest):
        last = at == len(widest) - 1
        split = []
        for part in parts:
            part = part[np.argsort(data[part, column], kind="stable")]
            split += [part] if last else np.array_split(part, slices)
        parts = split
    return np.concatenate(parts)


class Tree:
    """Vectors in the order of ``str_order``, and boxes over runs of them, over runs of boxes, and so on."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, data: np.ndarray, leaf: int = LEAF):
        self.ids, self.labels, self.data, self.leaf = ids, labels, data, leaf
        low, high, first, last, step = data, data, labels, labels, leaf
        self.levels = []
        while True:
            at = np.arange(0, len(first), step)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((low, high, first, last))
            if len(first) == 1:
                break
            step = _FAN

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Largest and smallest inner product of every anchor with anything in each box, by level."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [
            (up @ high.T + down @ low.T, up @ low.T + down @ high.T) for low, high, _, _ in self.levels
        ]

    def search(
        self, bounds: list[tuple[np.ndarray, np.ndarray]], anchor: np.ndarray, own: int, label: int,
        same: bool, windows: list[tuple[float, float]], k: int,
    ) -> list[list[tuple]]:
        """For each window the first k of (-score, id) of rows with the anchor's label, or of all others."""
        best: list[list[tuple]] = [[] for _ in windows]
        top = len(self.levels) - 1
        queue = [(-bounds[top][0][0], top, 0)]
        while queue:
            most, level, at = heapq.heappop(queue)
            most, least = -most, bounds[level][1][at]
            open_ = [
                w for w, (low, high) in enumerate(windows)
                if low <= most and least <= high and (len(best[w]) < k or most >= -best[w][-1][0])
            ]
            if not open_:
                continue
            if level:
                first, last = self.levels[level - 1][2:]
                for child in range(at * _FAN, min(len(first), (at + 1) * _FAN)):
                    fits = first[child] <= label <= last[child] if same else not first[child] == last[child] == label
                    if fits:
                        heapq.heappush(queue, (-bounds[level - 1][0][child], level - 1, child))
                continue
            rows = slice(at * self.leaf, (at + 1) * self.leaf)
            score = self.data[rows] @ anchor
            fits = ((self.labels[rows] == label) == same) & (self.ids[rows] != own)
            for w in open_:
                low, high = windows[w]
                reach = max(low, -best[w][-1][0]) if len(best[w]) == k else low
                good = np.flatnonzero(fits & (score >= reach) & (score <= high))
                if len(good):
                    found = zip((-score[good]).tolist(), self.ids[rows][good].tolist())
                    best[w] = heapq.nsmallest(k, [*best[w], *found])
        return best


# --- blocks and cells ---------------------------------------------------------------------------


def _packed(vectors: DataFrame, size, scale: int, tiled: bool) -> DataFrame:
    """(part, number, dims, ids, labels, data) blocks of ``size(dims)`` rows of (id, label, vector)."""

    def block(part: int, number: int, dims: int, rows: list) -> pa.RecordBatch:
        ids, labels, data = (np.concatenate(c) for c in zip(*rows))
        if tiled:
            order = str_order(labels, data)
            ids, labels, data = ids[order], labels[order], data[order]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([dims], pa.int32()),
                *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (ids, labels, data)),
            ],
            names=["part", "number", "dims", "ids", "labels", "data"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            flat = np.floor(scale * flat).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dims)
                while len(rows):
                    have = held.setdefault(dims, [])
                    now, rows = np.split(rows, [size(dims) - sum(len(h[0]) for h in have)])
                    have.append((ids[now], labels[now], flat[starts[now][:, None] + np.arange(dims)]))
                    if sum(len(h[0]) for h in have) >= size(dims):
                        number += 1
                        yield block(part, number, dims, held.pop(dims))
        for dims, have in held.items():
            number += 1
            yield block(part, number, dims, have)

    return in_batches(
        vectors, pack, "part int, number int, dims int, ids binary, labels binary, data binary"
    )


def _arrays(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dims = row["dims"][0].as_py()
    ids, labels, data = (np.frombuffer(row[c][0].as_py(), "<i8") for c in ("ids", "labels", "data"))
    return ids, labels, data.reshape(-1, dims)


def _comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where every inner product is exact in them, as Python's integers otherwise."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    kind = np.float64 if most < _EXACT else object
    return a.astype(kind), b.astype(kind)


def _long(x) -> int:
    return min(max(int(x), _LONG[0]), _LONG[1])


def _cells(asked: DataFrame, held: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` of every block of anchors with every block of vectors of the same length."""
    key = F.struct("part", "number")
    # what is broadcast is a key for each block: 16 bytes for thousands of vectors
    left = asked.withColumn("q", key).join(F.broadcast(held.select("dims", key.alias("c"))), "dims")
    right = held.withColumn("c", key).join(F.broadcast(asked.select("dims", key.alias("q"))), "dims")
    cell = ["dims", "q", "c"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(fn, schema)


_ANCHOR = "anchor_part int, anchor_number int, anchor_row int"
_ANCHOR_COLUMNS = ["anchor_part", "anchor_number", "anchor_row"]


def _nearest_of_label(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(anchor, positive_rank, positive_id, positive_score): the k best rows of each anchor's label."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            part, number = left["part"][0].as_py(), left["number"][0].as_py()
            anchor_ids, anchor_labels, anchors = _arrays(left)
            ids, labels, data = _arrays(right)
            anchors, data = _comparable(anchors, data)
            tree = Tree(ids, labels, data)
            for at in range(0, len(anchors), _ANCHORS_AT_ONCE):
                bounds = tree.bounds(anchors[at : at + _ANCHORS_AT_ONCE])
                for i in range(at, min(len(anchors), at + _ANCHORS_AT_ONCE)):
                    of_anchor = [(most[i - at], least[i - at]) for most, least in bounds]
                    (best,) = tree.search(
                        of_anchor, anchors[i], int(anchor_ids[i]), int(anchor_labels[i]), True,
                        [(-math.inf, math.inf)], k,
                    )
                    rows += [(part, number, i, int(anchor_ids[i]), other, _long(-s)) for s, other in best]
        return _table(rows, out)

    out = f"{_ANCHOR}, anchor_id bigint, positive_id bigint, positive_score bigint"
    found = _cells(asked, held, search, out)
    order = Window.partitionBy(*_ANCHOR_COLUMNS).orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("positive_rank", F.row_number().over(order)).filter(F.col("positive_rank") <= k)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _in_windows(asked: DataFrame, held: DataFrame, k: int, window: tuple[int, int]) -> DataFrame:
    """The k best rows of another label in the window of every positive; ``asked`` has the positives of
    its rows."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            part, number = left["part"][0].as_py(), left["number"][0].as_py()
            anchor_ids, anchor_labels, anchors = _arrays(left)
            ids, labels, data = _arrays(right)
            anchors, data = _comparable(anchors, data)
            tree = Tree(ids, labels, data)
            wanted: dict[int, list[tuple]] = {}
            for p in left["positives"][0].as_py():
                score = p["positive_score"]
                low, high = -(-window[0] * score // 100), window[1] * score // 100
                if low <= high:
                    wanted.setdefault(p["anchor_row"], []).append((p, low, high))
            asked_rows = sorted(wanted)
            for at in range(0, len(asked_rows), _ANCHORS_AT_ONCE):
                some = asked_rows[at : at + _ANCHORS_AT_ONCE]
                bounds = tree.bounds(anchors[some])
                for place, i in enumerate(some):
                    of_anchor = [(most[place], least[place]) for most, least in bounds]
                    found = tree.search(
                        of_anchor, anchors[i], int(anchor_ids[i]), int(anchor_labels[i]), False,
                        [(low, high) for _, low, high in wanted[i]], k,
                    )
                    for (p, _, _), best in zip(wanted[i], found):
                        rows += [
                            (part, number, i, int(anchor_ids[i]), p["positive_rank"], p["positive_id"],
                             p["positive_score"], other, _long(-s))
                            for s, other in best
                        ]
        return _table(rows, out)

    out = (
        f"{_ANCHOR}, anchor_id bigint, positive_rank int, positive_id bigint, positive_score bigint, "
        "negative_id bigint, negative_score bigint"
    )
    found = _cells(asked, held, search, out)
    of_positive = Window.partitionBy(*_ANCHOR_COLUMNS, "positive_rank")
    order = of_positive.orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES,
    negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES,
    anchors: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that
    ``is_anchor`` and each of its ``positives`` nearest rows of the same ``label``, the ``negatives``
    nearest rows of other labels whose score is in the ``window``."""
    clean = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull())
    clean = clean.select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
        F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).filter(F.col("label").isNotNull())
    count, asks, numbers = clean.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))
    ).first()
    # blocks of near vectors of a label; the id parts vectors that are all the same
    parts = max(1, math.ceil(8 * numbers / block_bytes))
    rows = clean.repartitionByRange(parts, "label", F.col("vector")[0], F.xxhash64("id"))
    held = stored(
        _packed(rows.select("id", "label", "vector"), lambda d: max(LEAF, block_bytes // (8 * d)), scale, True),
        "vector-blocks",
    )
    wanted = clean.filter("asks").repartition(max(1, math.ceil(asks / anchors)))
    asked = stored(
        _packed(wanted.select("id", "label", "vector"), lambda d: anchors, scale, False), "anchor-blocks"
    )
    found = stored(_nearest_of_label(asked, held, positives), "positives")
    # at most ``positives`` for each row of a block
    of_block = found.groupBy(F.col("anchor_part").alias("part"), F.col("anchor_number").alias("number")).agg(
        F.collect_list(F.struct("anchor_row", "positive_rank", "positive_id", "positive_score")).alias("positives")
    )
    windows = _in_windows(asked.join(of_block, ["part", "number"]), held, negatives, window)
    return windows.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
