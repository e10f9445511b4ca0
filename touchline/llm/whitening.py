"""Whitening of embeddings by cyclic Jacobi rotations.

Vectors become integer vectors x, floor(SCALE * entry). The fit list is each distinct x once. Its scatter is summed over all
tasks about the rounded mean, in integers, so sums are exact, don't depend on the order of tasks and need no repeat of
a pass; the remainder of the centring (less than one half an entry) is taken off exactly on the driver. The driver holds
numbers of the order of the squared width of a vector, whatever the number of rows. It applies symmetric Jacobi rotations
to the covariance, each pair of dimensions once a sweep, until every off-diagonal entry is below the rounding error of its
two diagonal entries (not of the largest one), which keeps small eigenvalues accurate. Components and mean go to all tasks.

Defined results: a vector that is null or holds null or non-finite entries is dropped; a shorter vector counts as padded
with zeros to the longest; equal vectors count once in the fit and have a row each in the result; repeated or null ids are
kept; an entry beyond the range of a long takes its bound. A component without variance (constant or dependent dimensions,
one distinct vector) has explained 0 and whitened null, and identity_error leaves it out (null if none is left); a
deviation that no long can hold is null. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import store

SCALE = 256
#: Bits of a limb of an exact sum; a sum is sent as LIMBS of them, so that longs hold the sums of millions of tasks.
LIMB, LIMBS = 40, 5
MOST = (1 << 63) - 1
#: Sweeps after which rotations that don't end are an error; some ten are usual.
SWEEPS = 60


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)).cast("long"))


def padded(x: Column, width: int) -> Column:
    return F.when(F.size(x) < width, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(width) - F.size(x), F.lit(0))))).otherwise(x)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def exact_sums(df: DataFrame, width: int, terms: Callable[[np.ndarray], np.ndarray], bound: int, cells: int) -> list[int]:
    """Sums over all rows' x of terms(batch), which gives cells numbers (integers) for a batch; bound: of a row's part of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, room = np.zeros(cells, dtype=object), np.zeros(cells, dtype=np.int64), MOST
        for batch in batches:
            x = matrix(batch.column("x"), width)
            if bound * len(x) >= MOST:
                total += terms(x.astype(object))
                continue
            if room < bound * len(x):
                total, held, room = total + held, np.zeros(cells, dtype=np.int64), MOST
            held += terms(x)
            room -= bound * len(x)
        total = total + held
        limbs = [pa.array([int(v) >> LIMB * k & (1 << LIMB) - 1 if k < LIMBS - 1 else int(v) >> LIMB * k for v in total], pa.int64()) for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int64()), *limbs], ["cell", *(f"l{k}" for k in range(LIMBS))])

    parts = df.select("x").mapInArrow(run, "cell long, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    sums = parts.groupBy("cell").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).toArrow().to_pydict()
    out = [0] * cells
    for i, *limbs in zip(sums["cell"], *(sums[f"l{k}"] for k in range(LIMBS)), strict=True):
        out[i] = sum(v << LIMB * k for k, v in enumerate(limbs))
    return out


def _scatter(centre: list[int], bound: int) -> Callable[[np.ndarray], np.ndarray]:
    """Products of all pairs of centred dimensions, then the centred dimensions; bound: of a centred entry."""
    upper = np.triu_indices(len(centre))

    def terms(x: np.ndarray) -> np.ndarray:
        y = x - np.array(centre, dtype=x.dtype)
        if y.dtype == object or bound * bound * len(y) < 1 << 53:  # else doubles would round
            products = y.T.dot(y) if y.dtype == object else (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
        else:
            products = y.T @ y
        return np.concatenate([products[upper], y.sum(axis=0)])

    return terms


def covariance(df: DataFrame, width: int, n: int, sums: list[int], most: int) -> np.ndarray:
    """Of the rows' x, divisor n, each entry rounded once. most: of the absolute entries."""
    centre = [(2 * s + n) // (2 * n) for s in sums]
    bound = most + max(map(abs, centre))
    pairs = width * (width + 1) // 2
    found = exact_sums(df, width, _scatter(centre, bound), bound * bound, pairs + width)
    rest, out = found[pairs:], np.empty((width, width))
    for (i, j), p in zip(zip(*np.triu_indices(width), strict=True), found, strict=False):
        out[i, j] = out[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    return out


def cyclic_jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, whose entry of the largest size is positive.

    A sweep meets all pairs in rounds of disjoint pairs, as a round-robin does, so that a round is one step on arrays.
    """
    a, size = np.array(matrix, dtype=np.float64), len(matrix)
    vectors, eps = np.eye(size), np.finfo(np.float64).eps
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(size), vectors
    seats = np.arange(size + size % 2)
    for _ in range(SWEEPS):
        rotated = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            real = (p < size) & (q < size)
            p, q = p[real], q[real]
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            on = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(dp * dq)), eps * eps * scale)
            if not on.any():
                continue
            rotated = True
            p, q, off, dp, dq = p[on], q[on], off[on], dp[on], dq[on]
            theta = (dq - dp) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = a[:, p] * c - a[:, q] * s, a[:, p] * s + a[:, q] * c
            a[p, p], a[q, q] = dp - t * off, dq + t * off
            a[p, q] = a[q, p] = 0
            vectors[:, p], vectors[:, q] = vectors[:, p] * c - vectors[:, q] * s, vectors[:, p] * s + vectors[:, q] * c
        if not rotated:
            break
    else:
        raise ArithmeticError(f"off-diagonal entries are left after {SWEEPS} sweeps")
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)
    return values, vectors


def whiten(df: DataFrame, components: int = 4, vector: str = "embedding", vec_id: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """One row for each usable row of df and component 1, 2, ... up to components."""
    schema = f"vec_id {df.schema[vec_id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).filter(usable(F.col("v"))).select("vec_id", scaled(F.col("v"), scale).alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:  # no rows, or only empty vectors
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.withColumn("x", padded(F.col("x"), width))
    fit = store(rows.select("x").distinct())
    n, low, high = fit.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    most = max(abs(low), abs(high))
    sums = exact_sums(fit, width, lambda x: x.sum(axis=0), most, width)
    cov = covariance(fit, width, n, sums, most)
    values, vectors = cyclic_jacobi(cov)
    trace = float(np.trace(cov))
    keep = min(components, width)
    live = [bool(e > width * np.finfo(np.float64).eps * trace) for e in values[:keep]]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - n * m) / n for s, m in zip(sums, centre, strict=True)])
    axes = vectors[:, :keep] / np.sqrt(np.where(live, values[:keep], 1.0))
    wide = most + max(map(abs, centre)) >= MOST

    def project(x: np.ndarray) -> np.ndarray:
        y = (x.astype(object) - np.array(centre, dtype=object)).astype(np.float64) if wide else (x - np.array(centre)).astype(np.float64)
        y, z = y - rest, np.zeros((len(x), keep))
        for j in range(width):  # in this order for every row, so equal vectors have equal results whatever their batch
            z += y[:, j : j + 1] * axes[j]
        return z

    error = _identity_error(fit, width, n, project, np.flatnonzero(live))
    small = width * (2 * n * most) ** 2 < MOST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            z, rowsn = project(x), len(x)
            kind = np.int64 if small else object
            deviation = ((x.astype(kind) * n - np.array(sums, dtype=kind)) ** 2).sum(axis=1)
            deviation = [int(v) if v <= MOST else None for v in deviation]
            for k in range(keep):
                explained = float(values[k]) / trace if live[k] else 0.0
                same = lambda value, kind: pa.array([value] * rowsn, kind)  # noqa: E731, B023
                whitened = pa.array(z[:, k]) if live[k] else pa.nulls(rowsn, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), same(k + 1, pa.int32()), same(n, pa.int64()), pa.array(deviation, pa.int64()), whitened, same(explained, pa.float64()), same(error, pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)


def _identity_error(fit: DataFrame, width: int, n: int, project: Callable[[np.ndarray], np.ndarray], live: np.ndarray) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity, measured on the list, to 12 places."""
    if not len(live):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(live) + 1, len(live) + 1))
        for batch in batches:
            z = project(matrix(batch.column("x"), width))[:, live]
            z = np.column_stack([z, np.ones(len(z))])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    sums = {r.cell: r.value for r in fit.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    total = np.array([sums[i] for i in range((len(live) + 1) ** 2)]).reshape(len(live) + 1, -1) / n
    mean = total[-1, :-1]
    return round(float(np.abs(total[:-1, :-1] - np.outer(mean, mean) - np.eye(len(live))).max()), 12)
