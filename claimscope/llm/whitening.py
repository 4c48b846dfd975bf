"""Whitening of embeddings: centred covariance by Spark, leading eigenpairs on the driver, projection by broadcast.

Vectors become fixed-point integers. The fit list holds each distinct one once; its sums are exact, so every covariance is
taken of centred values. A task sums up one matrix of centred products, the matrices are added per row of the matrix by a
shuffle. The symmetric matrix (of the vectors' width, whatever their number) is reduced to tridiagonal form by
Householder reflections; its leading eigenvalues come from bisection with Sturm counts, their vectors from inverse
iteration on the tridiagonal matrix, those of clustered eigenvalues being orthogonalised against each other in every
step, and the reflections carry them back. Components, at most 16 vectors, are broadcast for the projection.

Nulls: vectors that are null, empty, or hold null or non-finite entries have no rows (nor have those with an entry beyond
2 ** 52 in fixed point); vectors of another width than the most frequent one among the distinct vectors (the larger of
equally frequent ones) neither. A null ``vec_id`` is passed through. Repeated rows count once in the fit and come back as
often as they occur. Components without variance (to rounding) are left out, so one distinct vector alone, or an empty
table, gives no rows. Extra columns are ignored. Vectors may be as wide as a square matrix of their width fits the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues closer than this share of the matrix norm are a cluster.
CLUSTER = 1e-3
_LARGEST = float(1 << 52)
_EPS = np.finfo(float).eps


# --- eigenpairs of a symmetric matrix ---


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections): Householder reflection k acts on the entries from k + 1 on."""
    a = np.array(matrix, dtype=float)
    n, reflections = len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        v = np.zeros_like(x)
        if scale and np.abs(x[1:]).max() > 0:
            x /= scale
            v = x
            v[0] += math.copysign(float(np.sqrt(x @ x)), x[0])
            v /= np.sqrt(v @ v)
            block = a[k + 1 :, k + 1 :]
            p = block @ v
            w = p - (v @ p) * v
            block -= 2 * (np.outer(v, w) + np.outer(w, v))
            column = a[k + 1 :, k]
            column -= 2 * (v @ column) * v
        reflections.append(v)
    diagonal = np.diag(a).copy()
    return diagonal, np.array([a[k + 1, k] for k in range(n - 1)]), reflections


def carried_back(z: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    out = z.copy()
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        out[k + 1 :] -= 2 * (v @ out[k + 1 :]) * v
    return out


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each of the given places."""
    least = np.finfo(float).tiny / _EPS
    q, below = diagonal[0] - at, np.zeros(len(at), dtype=np.int64)
    squares = off * off
    for k in range(len(diagonal)):
        if k:
            q = diagonal[k] - at - squares[k - 1] / q
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The greatest eigenvalues, falling, by bisection of Gershgorin's interval to the last bit."""
    n = len(diagonal)
    reach = np.concatenate([np.abs(off), [0]]) + np.concatenate([[0], np.abs(off)])
    low, high = np.full(many, (diagonal - reach).min()), np.full(many, (diagonal + reach).max())
    slack = _EPS * max(np.abs(low[0]), np.abs(high[0]), np.finfo(float).tiny) * n
    low, high = low - slack, high + slack
    wanted = n - 1 - np.arange(many)  # the number of eigenvalues below
    for _ in range(200):
        middle = low + (high - low) / 2
        inside = (middle > low) & (middle < high)
        if not inside.any():
            break
        above = counts_below(diagonal, off, middle) <= wanted
        low, high = np.where(inside & above, middle, low), np.where(inside & ~above, middle, high)
    return low + (high - low) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, at: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - at) x = b by elimination with partial pivoting; pivots below ``least`` are raised to it."""
    n = len(diagonal)
    d, up, up2, low = (diagonal - at).tolist(), [*off.tolist(), 0.0], [0.0] * n, off.tolist()
    swapped, factor = [False] * n, [0.0] * n
    for k in range(n - 1):
        below = low[k]
        if abs(below) > abs(d[k]):
            swapped[k] = True
            row = (below, d[k + 1], up[k + 1])
            factor[k] = d[k] / below
            d[k + 1], up[k + 1] = up[k] - factor[k] * row[1], -factor[k] * row[2]
            d[k], up[k], up2[k] = row
        else:
            if abs(d[k]) < least:
                d[k] = math.copysign(least, d[k])
            factor[k] = below / d[k]
            d[k + 1] -= factor[k] * up[k]
    if abs(d[n - 1]) < least:
        d[n - 1] = math.copysign(least, d[n - 1])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for k in range(n - 1):
            if swapped[k]:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= factor[k] * x[k]
        for k in range(n - 1, -1, -1):
            rest = x[k]
            if k + 1 < n:
                rest -= up[k] * x[k + 1]
            if k + 2 < n:
                rest -= up2[k] * x[k + 2]
            x[k] = rest / d[k]
        return np.array(x)

    return solve


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a column, for falling eigenvalues."""
    n = len(diagonal)
    norm = float((np.abs(diagonal) + np.concatenate([np.abs(off), [0]]) + np.concatenate([[0], np.abs(off)])).max()) or 1.0
    out = np.zeros((n, len(values)))
    random, at, cluster = np.random.default_rng(0), math.inf, 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            cluster = j
        at = min(float(value), at - 10 * _EPS * norm)  # equal eigenvalues are taken a little apart
        solve, x = _solver(diagonal, off, at, _EPS * norm), random.standard_normal(n)
        x /= np.sqrt(x @ x)
        for _ in range(6):
            x = solve(x)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, cluster:j] @ (out[:, cluster:j].T @ x)
            x /= np.sqrt(x @ x)
        out[:, j] = x
    return out


def leading_pairs(matrix: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit eigenvectors as columns (largest entry positive)."""
    many = min(many, len(matrix))
    if not many:
        return np.empty(0), np.empty((len(matrix), 0))
    scale = float(np.abs(matrix).max()) or 1.0
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, many)
    found = vectors_of(diagonal, off, values)
    back = np.stack([carried_back(found[:, j], reflections) for j in range(many)], axis=1)
    back /= np.sqrt((back * back).sum(axis=0))
    back *= np.where(np.take_along_axis(back, np.abs(back).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    return values * scale, back


# --- the distributed part ---


class Fit(NamedTuple):
    """``n`` distinct vectors with exact sums; eigenvalues, components (columns), the covariance's trace, and the largest
    entry of the whitened vectors' covariance minus the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def _fixed_point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, x): fixed-point integers, little-endian 64-bit; unusable vectors are left out."""
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            ids, vectors = part.column(0).to_pylist(), part.column(1)
            keep, out = [], []
            values, offsets = vectors.values, vectors.offsets.to_numpy()
            null_entries = np.zeros(0, bool) if not values.null_count else values.is_null().to_numpy(zero_copy_only=False)
            raw = values.to_numpy(zero_copy_only=False).astype(float)
            with np.errstate(invalid="ignore", over="ignore"):
                fixed = np.floor(raw * SCALE)
                bad = ~(np.abs(fixed) < _LARGEST)
            if len(null_entries):
                bad |= null_entries
            x = (np.where(bad, 0, fixed).astype("<i8") + SHIFT)
            known = vectors.is_valid().to_numpy(zero_copy_only=False)
            broken = np.concatenate([[0], np.cumsum(bad)])
            for k in range(part.num_rows):
                a, b = offsets[k], offsets[k + 1]
                if known[k] and b > a and broken[a] == broken[b]:
                    keep.append(ids[k])
                    out.append(x[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "x"])


def fixed_point(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of every usable vector: floor(64 c) + 1,000,000 of each entry, as packed 64-bit integers."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_fixed_point, "vec_id long, x binary")


def _matrices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 4096) -> Iterator[np.ndarray]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            part = batch.column(column).slice(low, rows).to_pylist()
            yield np.frombuffer(b"".join(part), "<i8").reshape(len(part), -1)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: as 64-bit integers, or Python's where those could overflow."""
    most = max((abs(int(v)) for v in (x.min(), x.max(), sums.min(), sums.max())), default=0) if x.size else 0
    return n * x - sums if 2 * n * most < 1 << 62 else n * x.astype(object) - sums.astype(object)


def _added(rows: DataFrame) -> dict[int, np.ndarray]:
    """Arrays (i, part, row) of many tasks, added per i in the tasks' order."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(np.stack(pdf.sort_values("part")["row"].to_list()), axis=0)]})

    return {r["i"]: np.array(r["row"]) for r in rows.groupBy("i").applyInPandas(total, "i int, row array<double>").collect()}


def covariance(distinct: DataFrame, n: int, sums: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """The covariance (divisor n) of the centred vectors ``x``, or of their projections, which are centred by their own mean.

    Each task adds up its own matrix and sends one row per row of the matrix.
    """
    spark, width = distinct.sparkSession, len(sums) if project is None else project.shape[1]
    shared = spark.sparkContext.broadcast((n, sums, project))

    def centred(x: np.ndarray) -> np.ndarray:
        n, sums, project = shared.value
        y = deviations(x, n, sums).astype(float) / n
        return y if project is None else y @ project

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((centred(x).sum(axis=0) for x in _matrices(batches, 0)), np.zeros(width))
        yield _as_rows([total])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for x in _matrices(batches, 0):
            y = centred(x) - mean
            total += y.T @ y
        yield _as_rows(total)

    mean = np.zeros(width)
    schema = "i int, part int, row array<double>"
    if project is not None:
        mean = _added(distinct.select("x").mapInArrow(summed, schema)).get(0, mean) / n
    found = _added(distinct.select("x").mapInArrow(products, schema))
    out = np.array([found.get(i, np.zeros(width)) for i in range(width)]).reshape(width, width) / n
    return (out + out.T) / 2


def _as_rows(rows) -> pa.RecordBatch:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(rows)), pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["i", "part", "row"]
    )


def _sums(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors and their exact sums."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for x in _matrices(batches, 0):
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64())], ["n", "i", "s"])

    rows = distinct.select("x").mapInArrow(scan, "n long, i int, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    rows.sort(key=lambda r: r["i"])
    return (rows[0]["n"] if rows else 0), np.array([r["s"] for r in rows], dtype=np.int64)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit:
    """Fit on the distinct vectors of ``rows`` (x). Only sums, one matrix of their width and the result reach the driver."""
    distinct = stored(rows.select("x").distinct(), "vectors")
    widths = distinct.groupBy(F.length("x").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("w").desc()).limit(1).collect()
    distinct = distinct.where(F.length("x") == widths[0]["w"]) if widths else distinct
    n, sums = _sums(distinct)
    if not n:
        return Fit(0, sums, np.empty(0), np.empty((0, 0)), 0.0, 0.0)
    matrix = covariance(distinct, n, sums)
    values, vectors = leading_pairs(matrix, components)
    there = values > 100 * len(matrix) * _EPS * max(np.abs(matrix).max(), np.finfo(float).tiny)
    values, vectors = values[there], vectors[:, there]
    error = float(np.abs(covariance(distinct, n, sums, vectors / np.sqrt(values)) - np.eye(len(values))).max()) if len(values) else 0.0
    return Fit(n, sums, values, vectors, float(np.trace(matrix)), error)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    ``deviation`` is null where it exceeds 63 bits.
    """
    rows = fixed_point(vectors)
    model = fit(rows, components)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((model.n, model.sums, model.components / np.sqrt(model.values) if model.n else model.components))
    width = 8 * len(model.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, weights = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                x = next(_matrices(iter([part]), 1), np.empty((0, len(sums)), np.int64))
                y = deviations(x, n, sums)
                exact = y if y.dtype != object and float((y.astype(float) ** 2).sum(axis=1).max(initial=0)) < 1 << 62 else y.astype(object)
                squares = (exact * exact).sum(axis=1).tolist()
                out = (y.astype(float) / n) @ weights
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()), pa.array(out.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"]
                )

    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if len(model.values) else F.array().cast("array<double>")
    found = rows.where(F.length("x") == width).mapInArrow(project, "vec_id long, deviation long, whitened array<double>")
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(int(model.n)).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
