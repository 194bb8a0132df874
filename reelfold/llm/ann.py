"""Nearest neighbours by inner product as a block matrix join.

Vectors are packed into blocks where they are read. A block of queries and a block of candidates make a
tile; every tile is one cell of a join on (query block, candidate block), so the work spreads over
tiles and no task holds more than two blocks. In a tile the product of 8-bit quantised vectors gives
every inner product up to an error bound; only pairs whose upper bound reaches the k-th best lower bound
of their query are computed again, from the original components in double precision. The k best of each
tile are merged to the k best of all tiles. No candidate is skipped otherwise, so the result is exact.

Rows: vectors that are null, zero, or hold null or non-finite components take no part, neither as query
nor as candidate, nor do rows without id; vectors of different lengths don't meet. Ties go to the smaller
id. Repeated rows are repeated candidates, and a repeated query row gets a list each time; a query leaves
out the rows of its own id. Fewer candidates than k give fewer rows. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from reelfold.llm.tables import in_batches, stored

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
_EXACT_DIMS = 1024  # products of so many 8-bit numbers add up exactly in 32-bit floats
_ROWS_AT_ONCE = 128


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def blocks(vectors: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    """(part, number, dims, ids, data): up to ``size`` vectors of one length, as 64-bit integers and
    64-bit floats."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}  # by length: ids and components that don't fill a block yet

        def block(dims: int, ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                    pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                    pa.array([data.tobytes()], pa.binary()),
                ],
                names=["part", "number", "dims", "ids", "data"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                data = flat[(ends[rows] - dims)[:, None] + np.arange(dims)]
                old = held.get(dims)
                now, data = (
                    (np.r_[old[0], ids[rows]], np.vstack([old[1], data])) if old else (ids[rows], data)
                )
                while len(now) >= size:
                    yield block(dims, now[:size], data[:size])
                    now, data = now[size:], data[size:]
                held[dims] = [now, data]
        for dims, (ids, data) in held.items():
            if len(ids):
                yield block(dims, ids, data)

    return vectors.select(id_col, vector_col).transform(in_batches, 
        packed, "part int, number int, dims int, ids binary, data binary"
    )


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit components, scale, length of what they stand for and length of the error, by row."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # smaller than the smallest float can be divided
    small = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    stands = small * scale[:, None]
    return small, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of 8-bit integers, exact."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], _EXACT_DIMS):
        part = slice(at, at + _EXACT_DIMS)
        out += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * c[:, d]
    return total


def tile_best(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in one tile: query index, candidate index, score."""
    q8, q_scale, q_size, q_error = _quantised(queries)
    c8, c_scale, c_size, c_error = _quantised(vectors)
    # |<x, y> - <x', y'>| <= |x - x'| |y| + |x'| |y - y'|, and a little for rounding
    c_whole = c_size + c_error
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(queries), _ROWS_AT_ONCE):
        rows = slice(at, at + _ROWS_AT_ONCE)
        near = _product(q8[rows], c8) * q_scale[rows, None] * c_scale
        bound = q_error[rows, None] * c_whole + q_size[rows, None] * c_error
        bound += 1e-12 * (q_size[rows, None] + q_error[rows, None]) * c_whole + 1e-300
        own = query_ids[rows, None] == ids
        low = np.where(own, -np.inf, near - bound)
        if low.shape[1] > k:
            reach = np.partition(low, -k, axis=1)[:, -k]
        else:
            reach = np.full(len(low), -np.inf)
        alive = (near + bound >= reach[:, None]) & ~own
        i, j = np.nonzero(alive)
        score = np.empty(len(i))
        for part in range(0, len(i), 1 << 16):
            s = slice(part, part + (1 << 16))
            score[s] = _exact(queries[at + i[s]], vectors[j[s]])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = rank < k
        out_q.append(at + i[best])
        out_c.append(j[best])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def nearest(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest candidates of every query row."""
    clean = vectors.select(id_col, vector_col).filter(usable(vector_col) & F.col(id_col).isNotNull())

    def packed(rows: DataFrame, size: int, label: str) -> DataFrame:
        dealt = rows.repartition(max(1, math.ceil(rows.count() / size)))  # full blocks, one a task
        return stored(blocks(dealt, size, id_col, vector_col), label)

    asked = packed(clean.filter(is_query), query_block, "query-blocks")
    held = packed(clean, candidate_block, "candidate-blocks")

    def tile(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            dims = keys[0].as_py()
            query_ids = np.frombuffer(left["ids"][0].as_py(), np.int64)
            ids = np.frombuffer(right["ids"][0].as_py(), np.int64)
            q = np.frombuffer(left["data"][0].as_py()).reshape(-1, dims)
            c = np.frombuffer(right["data"][0].as_py()).reshape(-1, dims)
            i, j, score = tile_best(query_ids, q, ids, c, k)
            found = {"query_id": query_ids[i], "query_row": i, "vec_id": ids[j], "score": score}
        block = keys[1].as_py()
        return pa.table(
            {
                "query_id": pa.array(found["query_id"], pa.int64()),
                "query_part": pa.array([block["part"]] * len(found["score"]), pa.int32()),
                "query_number": pa.array([block["number"]] * len(found["score"]), pa.int32()),
                "query_row": pa.array(found["query_row"], pa.int64()),
                "vec_id": pa.array(found["vec_id"], pa.int64()),
                "score": pa.array(found["score"], pa.float64()),
            }
        )

    # every block meets every block of the other side; what is copied is blocks, not rows
    q_keys = asked.select("dims", F.struct("part", "number").alias("q"))
    c_keys = held.select("dims", F.struct("part", "number").alias("c"))
    # (a key for each block: 16 bytes for thousands of vectors)
    left = asked.withColumn("q", F.struct("part", "number")).join(F.broadcast(c_keys), "dims")
    right = held.withColumn("c", F.struct("part", "number")).join(F.broadcast(q_keys), "dims")
    cell = ["dims", "q", "c"]
    tiles = (
        left.select(*cell, "ids", "data").groupBy(*cell)
        .cogroup(right.select(*cell, "ids", "data").groupBy(*cell))
        .applyInArrow(
            tile,
            "query_id bigint, query_part int, query_number int, query_row bigint, vec_id bigint, "
            "score double",
        )
    )
    # Spark keeps the k best of a query in each task before it shuffles, as a heap would
    asked_row = ["query_id", "query_part", "query_number", "query_row"]
    order = Window.partitionBy(*asked_row).orderBy(F.desc("score"), "vec_id")
    return (
        tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
