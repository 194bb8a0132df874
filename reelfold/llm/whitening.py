"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Every component c of a vector becomes the integer ``x = floor(scale * c) + shift``. Two passes gather what
the covariance needs: sums of every dimension, then sums of products of ``x`` less the integer nearest to
its mean. Both are sums of integers, exact and the same in any order; the rest of the mean, half a unit at
most, is taken off exactly afterwards. So nothing cancels, however far the mean is from zero.

The covariance, dims x dims, is factored on the driver by Cholesky with the largest remaining variance as
pivot; what is left when that falls to rounding has no rank. One-sided Jacobi then rotates the columns of
the triangular factor itself until they are orthogonal: their squared norms are the eigenvalues, the
normalised columns the components. Projections are computed where the vectors are read.

Rows: vectors that are null, empty, or hold null or non-finite components take no part; nor do those with
a component of 2**40 or more in size (64-bit integers could not hold its scaled form exactly) and those of
another length than most vectors (the longer of two equally common lengths counts). A component whose
variance is zero to rounding has no direction and is not returned, so vectors that are all equal give no
rows. ``deviation`` is null where 64 bits can't hold it. Repeated rows and rows without id count like any
other. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reelfold.llm.tables import in_batches, stored

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
_LARGEST = float(1 << 40)
_SAFE = 1 << 62


def usable(vector: str) -> Column:
    """Whether the vector has components, all finite and of a size that 64-bit integers can hold."""
    v = F.col(vector)
    good = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < _LARGEST, F.lit(False)))
    return F.coalesce((F.size(v) > 0) & good, F.lit(False))


def common_length(vectors: DataFrame, vector_col: str) -> int | None:
    """The length that most usable vectors have."""
    sizes = vectors.filter(usable(vector_col)).groupBy(F.size(vector_col).alias("dims")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("dims")).first()
    return first["dims"] if first else None


def _matrix(lists: pa.Array, scale: int, shift: int) -> np.ndarray:
    """Vectors of one length as rows of integers."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(scale * flat).astype(np.int64) + shift).reshape(len(lists), -1)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def products(y: np.ndarray) -> np.ndarray:
    """y.T @ y of integers, exact."""
    if len(y) * _largest(y) ** 2 >= _SAFE:
        y = y.astype(object)
    return y.T @ y


def _summed(df: DataFrame, fn, width: int) -> list[list[int]]:
    """Sums, over all batches, of the integer rows that ``fn`` makes of a batch: (place, values)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                now = fn(batch.column(0)).astype(object)
                total = now if total is None else total + now
        if total is not None:
            for place, values in enumerate(total):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([place] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()),
                        pa.array([str(int(v)) for v in values], pa.string()),
                    ],
                    names=["row", "col", "value"],
                )

    # one row a cell and task; Spark adds them up, so the driver gets the cells alone
    cells = in_batches(df, partial, "row int, col int, value string")
    sums = cells.groupBy("row", "col").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found = [[0] * width for _ in range(width)]
    for r in sums.collect():  # dims * dims cells
        found[r["row"]][r["col"]] = int(r["value"])
    return found


def covariance(
    vectors: DataFrame, vector_col: str, dims: int, scale: int = SCALE, shift: int = SHIFT
) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums of every dimension, covariance (divisor n) of the integer vectors."""
    rows = vectors.select(vector_col)

    def sums(lists: pa.Array) -> np.ndarray:
        x = _matrix(lists, scale, shift)
        total = x.astype(object).sum(axis=0) if len(x) * _largest(x) >= _SAFE else x.sum(axis=0)
        return np.vstack([total, np.full(dims, len(x))])

    found = _summed(rows, sums, max(dims, 2))
    n, total = found[1][0], found[0][:dims]
    if not n:
        return 0, total, np.zeros((dims, dims))
    centre = [round(Fraction(s, n)) for s in total]
    shifted = np.array([shift - c for c in centre], np.int64)

    def scatter(lists: pa.Array) -> np.ndarray:
        return products(_matrix(lists, scale, 0) + shifted)

    product = _summed(rows, scatter, max(dims, 2))
    rest = [s - n * c for s, c in zip(total, centre)]  # of the sums, less than n in size
    exact = [
        [float(Fraction(n * product[i][j] - rest[i] * rest[j], n * n)) for j in range(dims)]
        for i in range(dims)
    ]
    return n, total, np.array(exact)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L @ L.T, its rows in the order of v's, a column for each pivot: the largest variance
    that is left."""
    left, rows = v.astype(float).copy(), []
    floor = len(v) * np.finfo(float).eps * max(v.diagonal().max(initial=0.0), 0.0)
    for _ in range(len(v)):
        p = int(np.argmax(left.diagonal()))
        if left[p, p] <= floor:
            break
        column = left[:, p] / np.sqrt(left[p, p])
        rows.append(column)
        left -= np.outer(column, column)
        left[p, :] = left[:, p] = 0.0  # eliminated, but for rounding
    return np.array(rows).reshape(-1, len(v)).T


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor`` rotated, pair by pair, until all are orthogonal.

    A sweep meets every pair of columns once; pairs that share no column are rotated together.
    """
    g = factor.copy()
    k = g.shape[1]
    if k < 2:
        return g
    seats = list(range(k)) + ([-1] if k % 2 else [])  # -1 sits out
    half = len(seats) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:])) if a >= 0 and b >= 0]
            i, j = (np.array(side) for side in zip(*pairs))
            a, b = g[:, i], g[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            sizes = np.sqrt(aa * bb)
            apart = np.abs(ab) > 1e-16 * sizes
            worst = max(worst, float((np.abs(ab[apart]) / sizes[apart]).max(initial=0.0)))
            zeta = (bb - aa) / np.where(apart, 2 * ab, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(apart, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, i], g[:, j] = c * a - c * t * b, c * t * a + c * b
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst < 1e-15:
            break
    return g


@dataclass(frozen=True)
class Whitening:
    """What is fitted: n, sums and trace of the integer vectors, components (rows) and eigenvalues."""

    n: int
    sums: tuple[int, ...]
    trace: float
    components: np.ndarray
    eigenvalues: np.ndarray


def fit(
    vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding", scale: int = SCALE,
    shift: int = SHIFT,
) -> Whitening | None:
    """The leading ``components`` of all usable vectors, fewer where the covariance has no more rank."""
    dims = common_length(vectors, vector_col)
    if dims is None:
        return None
    rows = vectors.filter(usable(vector_col) & (F.size(vector_col) == dims))
    n, sums, v = covariance(rows, vector_col, dims, scale, shift)
    rotated = one_sided_jacobi(pivoted_cholesky(v))
    norms = np.linalg.norm(rotated, axis=0)
    order = np.argsort(-norms, kind="stable")[:components]
    order = order[norms[order] > 0]
    return Whitening(
        n, tuple(sums), float(v.trace()), (rotated[:, order] / norms[order]).T, norms[order] ** 2
    )


def project(
    vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """(vec_id, deviation, whitened): ``whitened`` has one number for each component."""
    schema = T.StructType([
        T.StructField("vec_id", vectors.schema[id_col].dataType), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType(), False)),
    ])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, dims = model.n, len(model.sums)
    sums = np.array(model.sums, object)
    weights = model.components / np.sqrt(model.eigenvalues)[:, None]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), scale, shift).reshape(batch.num_rows, dims)
            most = n * _largest(x) + int(max(map(abs, sums)))
            if dims * most * most < _SAFE:
                apart = n * x - sums.astype(np.int64)
                deviation = (apart * apart).sum(axis=1).tolist()
            else:
                # centred by an integer first, so that 64 bits reach further; Python's integers beyond
                apart = n * x.astype(object) - sums
                deviation = [d if d < 1 << 63 else None for d in (apart * apart).sum(axis=1).tolist()]
            # the division is of exact numbers, so each centred component is rounded once
            centred = (apart / n).astype(np.float64)
            # (row by row, so that a row's numbers don't depend on its batch)
            white = np.array([weights @ row for row in centred]).reshape(len(x), len(weights))
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(weights)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(deviation, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel())),
                ],
                names=["vec_id", "deviation", "whitened"],
            )

    rows = vectors.filter(usable(vector_col) & (F.size(vector_col) == dims)).select(id_col, vector_col)
    return in_batches(rows, compute, schema)


def identity_error(white: DataFrame, count: int) -> float:
    """Largest entry of the covariance of ``whitened``'s ``count`` numbers less the identity."""
    w = [F.col("whitened")[k] for k in range(count)]
    sums = white.agg(
        F.count(F.lit(1)),
        *[F.sum(x) for x in w],
        *[F.sum(w[i] * w[j]) for i in range(count) for j in range(i, count)],
    ).first()
    n, means = sums[0], [s / sums[0] for s in sums[1 : count + 1]]
    found, at = 0.0, count + 1
    for i in range(count):
        for j in range(i, count):
            found = max(found, abs(sums[at] / n - means[i] * means[j] - (i == j)))
            at += 1
    return found


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
    vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector."""
    model = fit(vectors, components, vector_col, scale, shift)
    white = project(vectors, model, id_col, vector_col, scale, shift)
    count = len(model.eigenvalues) if model else 0
    error, shares = 0.0, []
    if count:
        white = stored(white, "whitened")  # read for the error and for the rows
        error = identity_error(white, count)
        shares = [float(e / model.trace) for e in model.eigenvalues]
    number = F.col("place") + 1
    share = F.get(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("place"))
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "value"))
    return rows.select(
        "vec_id", number.cast("int").alias("component"), F.lit(model.n if model else 0).cast("bigint").alias("n"),
        "deviation", F.col("value").alias("whitened"), share.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
