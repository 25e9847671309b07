"""Whitening of embeddings by cyclic Jacobi rotations (operator 13).

Entries become integers, ``x = floor(scale * c) + offset``, so sums are exact.  Two passes over the
table gather what the driver needs, both reduced by Spark and bounded by the square of the
dimensions, whatever the rows: the number of rows and the sum of each dimension; then the scatter
``sum((x - mean)(x - mean)')``, centred before it is multiplied, since the offset is far larger than
what the vectors differ by.  The driver turns the covariance by *cyclic Jacobi*: each sweep goes over
all pairs of dimensions and rotates each so that its entry vanishes, until nothing off the diagonal
is left.  Rotations are orthogonal and applied to both sides, so small eigenvalues keep their digits.
Eigenvectors by falling eigenvalue, divided by its root, are the whitening matrix, which is broadcast
(``MAX_DIMS`` bounds it) and applied in a map.  A third pass measures the covariance of the result.

Defined results: vectors that are null or empty, or hold null or non-finite entries, are dropped, and
so are those of another length than most vectors have (of equally many the longer); rows that share
an id, and repeated rows, each count; where there are fewer dimensions than ``components`` there are
as many components as dimensions; a component without variance (constant or dependent dimensions) has
whitened 0 and explained 0 (and identity_error says so); a table without vectors gives no rows; ids keep their type; other columns
are ignored.  Integers that do not fit 64 bits (entries beyond ``MAX_ENTRY``, or so many rows that a
``deviation`` passes 2**63) are refused with an ArithmeticError rather than wrapped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The whitening matrix and the scatter are of this order at most: 2048**2 doubles are 32 MB.
MAX_DIMS = 2048
#: Entries whose scaled integers, and a million million of them summed, fit 64 bits.
MAX_ENTRY = float(1 << 22)
#: Rows that are multiplied at once.
CHUNK = 4096


# ---------------------------------------------------------------- tasks
def usable(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that hold finite entries only (of ``dims`` of them, if given), their lengths, and all entries end to end with 0 for null."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten()  # of null rows nothing is left
    size = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ok = (size > 0) & (broken[start[1:]] == broken[start[:-1]])
    if dims is not None:
        ok &= size == dims
    return ok, size, values


def integers(batch: pa.RecordBatch, dims: int, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch are used, and their vectors of integers."""
    ok, size, values = usable(batch.column(batch.schema.get_field_index("embedding")), dims)
    values = values[np.repeat(ok, size)].reshape(-1, dims)
    if len(values) and np.abs(values).max() > MAX_ENTRY:
        raise ArithmeticError(f"an entry is beyond {MAX_ENTRY:.0f}")
    return ok, np.floor(scale * values).astype(np.int64) + offset


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok, size, _ = usable(batch.column(0))
        dims, many = np.unique(size[ok], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int64()), pa.array(many, pa.int64())], names=["dims", "n"])


def _sums(batches: Iterator[pa.RecordBatch], dims: int, scale: float, offset: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(dims, dtype=np.int64)
    for batch in batches:
        total += integers(batch, dims, scale, offset)[1].sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total, pa.int64())], names=["at", "total"])


def _scatter(batches: Iterator[pa.RecordBatch], dims: int, scale: float, offset: int, mean: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of products of a task's vectors, centred and then multiplied by ``matrix``."""
    wide = matrix.shape[1]
    total = np.zeros((wide, wide))
    for batch in batches:
        x = integers(batch, dims, scale, offset)[1]
        for at in range(0, len(x), CHUNK):
            y = (x[at : at + CHUNK] - mean) @ matrix
            total += y.T @ y
    rows, columns = np.triu_indices(wide)
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(total[rows, columns])], names=["a", "b", "total"])


def _project(batches: Iterator[pa.RecordBatch], dims: int, scale: float, offset: int, fit) -> Iterator[pa.RecordBatch]:
    n, sums, matrix, explained, error = fit.value
    wide = matrix.shape[1]
    mean = sums / n
    for batch in batches:
        ok, x = integers(batch, dims, scale, offset)
        ids = batch.column(0).filter(pa.array(ok))
        for at in range(0, len(x), CHUNK):
            some = x[at : at + CHUNK]
            rows = len(some)
            far = np.abs(some).max() * float(n) + np.abs(sums).max()
            if far * far * dims < 2.0**62:
                deviation = np.square(n * some - sums).sum(1).tolist()
            else:
                deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist(), strict=True)) for row in some.tolist()]
                if max(deviation) >= 1 << 63:
                    raise ArithmeticError("a deviation does not fit 64 bits")
            y = (some - mean) @ matrix
            which = pa.array(np.repeat(np.arange(rows), wide))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, rows).take(which),
                    pa.array(np.tile(np.arange(1, wide + 1), rows), pa.int32()),
                    pa.array(np.full(rows * wide, n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(which),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * wide, error)),
                ],
                names=[batch.schema.names[0], "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


# ---------------------------------------------------------------- the driver
def cyclic_jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    vectors = np.eye(n)
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                # an entry is gone when it no longer counts beside either diagonal one
                if abs(a[p, q]) <= 1e-17 * np.sqrt(abs(a[p, p] * a[q, q])) or a[p, q] == 0.0:
                    continue
                turned = True
                half = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.copysign(1.0, half) / (abs(half) + np.hypot(1.0, half))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                shift = t * a[p, q]
                left, right = a[p].copy(), a[q].copy()
                a[p], a[q] = c * left - s * right, s * left + c * right
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q] = left[p] - shift, right[q] + shift
                a[p, q] = a[q, p] = 0.0
                left, right = vectors[:, p].copy(), vectors[:, q]
                vectors[:, p], vectors[:, q] = c * left - s * right, s * left + c * right
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _gather(vectors: DataFrame, dims: int, scale: float, offset: int, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The scatter of all vectors; what reaches the driver is as large as the matrix."""
    wide = matrix.shape[1]
    partial_sums = vectors.mapInArrow(partial(_scatter, dims=dims, scale=scale, offset=offset, mean=mean, matrix=matrix), "a int, b int, total double")
    out = np.zeros((wide, wide))
    for a, b, total in partial_sums.groupBy("a", "b").agg(F.sum("total")).collect():
        out[a, b] = out[b, a] = total
    return out


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024.0, offset: int = 100_000, key: str = "vec_id") -> DataFrame:
    """A row for each vector of ``vectors`` (``key``, embedding) and component.

    Columns: the key, component (from 1), n, deviation (sum over dimensions of (n x - S)**2, exact), whitened, explained (the
    eigenvalue's share of all variance) and identity_error (the largest entry by which whitened's covariance misses the identity).
    """
    spark = vectors.sparkSession
    rows = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    only = rows.select("embedding")
    lengths = only.mapInArrow(_lengths, "dims long, n long").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).head(1)
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dims, n = lengths[0]
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} dimensions; at most {MAX_DIMS} are whitened")
    how = {"dims": dims, "scale": scale, "offset": offset}
    sums = np.zeros(dims, dtype=np.int64)
    for at, total in only.mapInArrow(partial(_sums, **how), "at int, total long").groupBy("at").agg(F.sum("total")).collect():
        sums[at] = total
    mean = sums / n
    values, axes = cyclic_jacobi(_gather(only, **how, mean=mean, matrix=np.eye(dims)) / n)
    wide = min(components, dims)
    alive = values[:wide] > max(values[0], 0.0) * 1e-13  # what is below is rounding
    matrix = np.where(alive, axes[:, :wide] / np.sqrt(np.where(alive, values[:wide], 1.0)), 0.0)
    explained = np.where(alive, values[:wide] / values.sum() if values.sum() > 0 else 0.0, 0.0)
    error = float(np.abs(_gather(only, **how, mean=mean, matrix=matrix) / n - np.eye(wide)).max())
    fit = spark.sparkContext.broadcast((n, sums, matrix, explained, error))
    return rows.mapInArrow(partial(_project, **how, fit=fit), schema)
