"""Embedding whitening by leading principal components.

Three passes over the vectors, each with sums that merge: exact column sums, the centred covariance, the
projection. Only tables of the dimension's size (d sums, d * d covariances) come to the driver, whatever the
number of vectors. There the covariance is made tridiagonal by Householder reflections, its largest
eigenvalues are bracketed by counting signs of the Sturm sequence, and the components come from inverse
iteration on the tridiagonal matrix, made orthogonal again inside clusters of close eigenvalues. The
components go back to the tasks, which project their own vectors.

Vectors are brought to integers first, ``floor(scale * entry) + offset``, so the sums are exact and do not
depend on the partitioning. Defined results:

* A vector that is null, empty, or holds a null or non-finite entry gives no row. Vectors of another length
  than most (the longer length on a tie) give none either.
* Entries beyond 2**42 count as 2**42, so that integers stay exact in doubles.
* An empty table, or one whose vectors are all equal, has no component with variance and gives no row; a
  component whose variance is no more than rounding is left out, since dividing by its root means nothing.
* Null ids and repeated rows stay: each row counts in all sums and has its own result. Columns beside the id
  and the vector play no part, whatever their names.
* ``deviation`` is exact; where it would pass 63 bits it is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcast.session import materialize

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
LARGEST = float(1 << 42)
EPS = np.finfo(np.float64).eps


# ---- the symmetric eigenproblem of one covariance matrix

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reduction: diagonal, off-diagonal, and the unit reflectors in the order applied."""
    a = np.array(matrix, dtype=np.float64)
    size, reflectors = len(a), []
    for k in range(size - 2):
        column = a[k + 1:, k].copy()
        length = np.sqrt(column @ column)
        v = column.copy()
        v[0] += np.copysign(length, column[0])
        norm = np.sqrt(v @ v)
        if norm == 0.0:  # nothing below the off-diagonal
            reflectors.append(np.zeros(size - k - 1))
            continue
        v /= norm
        reflectors.append(v)
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0.0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, column[0])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, pivot: float) -> np.ndarray:
    """Eigenvalues below each of ``at``: negative pivots of T - x I, counted for all x at once."""
    q = diagonal[0] - at
    q = np.where(np.abs(q) < pivot, -pivot, q)
    below = (q < 0).astype(np.int64)
    for entry, square in zip(diagonal[1:], squares, strict=True):
        q = entry - at - square / q
        q = np.where(np.abs(q) < pivot, -pivot, q)
        below += q < 0
    return below


def largest_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each bisected until its bracket has no double inside."""
    size, squares = len(diagonal), off * off
    reach = np.append(np.abs(off), 0.0) + np.append(0.0, np.abs(off))
    low, high = float(np.min(diagonal - reach)), float(np.max(diagonal + reach))
    spread = max(abs(low), abs(high), np.finfo(np.float64).tiny)
    pivot = max(np.finfo(np.float64).tiny * 4, EPS * EPS * spread)
    low, high = low - 4 * EPS * spread, high + 4 * EPS * spread
    wanted = size - 1 - np.arange(count)  # eigenvalue of rank r is below x once more than r are
    lows, highs = np.full(count, low), np.full(count, high)
    for _ in range(128):
        middle = lows + (highs - lows) / 2
        if not ((middle > lows) & (middle < highs)).any():
            break
        above = sturm_count(diagonal, squares, middle, pivot) <= wanted
        lows, highs = np.where(above, middle, lows), np.where(above, highs, middle)
    return lows + (highs - lows) / 2


@dataclass
class _Factors:
    """T - x I = P L U with row exchanges; U has two diagonals above its own."""

    upper: np.ndarray  # (size, 3)
    below: np.ndarray
    swapped: np.ndarray

    @staticmethod
    def of(diagonal: np.ndarray, off: np.ndarray, shift: float, pivot: float) -> _Factors:
        size = len(diagonal)
        upper, below, swapped = np.zeros((size, 3)), np.zeros(size), np.zeros(size, dtype=bool)
        row = [diagonal[0] - shift, off[0] if size > 1 else 0.0, 0.0]
        for k in range(size - 1):
            following = [off[k], diagonal[k + 1] - shift, off[k + 1] if k + 2 < size else 0.0]
            if abs(following[0]) > abs(row[0]):
                row, following, swapped[k] = following, row, True
            if abs(row[0]) < pivot:
                row[0] = pivot
            below[k] = following[0] / row[0]
            upper[k] = row
            row = [following[1] - below[k] * row[1], following[2] - below[k] * row[2], 0.0]
        upper[-1] = row if abs(row[0]) >= pivot else [pivot, 0.0, 0.0]
        return _Factors(upper, below, swapped)

    def solve(self, right: np.ndarray) -> np.ndarray:
        x = right.copy()
        for k in range(len(x) - 1):
            if self.swapped[k]:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= self.below[k] * x[k]
        for k in range(len(x) - 1, -1, -1):
            if k + 1 < len(x):
                x[k] -= self.upper[k, 1] * x[k + 1]
            if k + 2 < len(x):
                x[k] -= self.upper[k, 2] * x[k + 2]
            x[k] /= self.upper[k, 0]
            largest = np.abs(x[k:]).max()
            if largest > 1e200:  # only the direction counts
                x /= largest
        return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors of T for ``values`` (falling), as columns.

    Vectors of values closer than a thousandth of T's norm form a cluster. Inside a cluster every round takes
    the parts along the earlier vectors away again; equal values are shifted apart by some ulps, so that the
    solves differ.
    """
    size = len(diagonal)
    norm = max(float(np.max(np.abs(diagonal))) + 2 * float(np.max(np.abs(off), initial=0.0)), np.finfo(np.float64).tiny)
    pivot, vectors, start, shift = EPS * norm, np.zeros((size, len(values))), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        shift = min(float(value), shift - 4 * EPS * norm) if k > start else float(value)
        factors = _Factors.of(diagonal, off, shift, pivot)
        x = np.random.default_rng(k + 1).uniform(0.5, 1.0, size)
        for _ in range(rounds):
            for _ in range(2):  # twice is enough to be orthogonal to the last bit
                x -= vectors[:, start:k] @ (vectors[:, start:k].T @ x)
            x /= np.sqrt(x @ x)
            x = factors.solve(x)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= vectors[:, start:k] @ (vectors[:, start:k].T @ x)
        vectors[:, k] = x / np.sqrt(x @ x)
    return vectors


def leading_components(covariance: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the ``count`` largest, without those that are only rounding."""
    count = min(count, len(covariance))
    trace = float(np.trace(covariance))
    if count == 0 or not trace > 0.0:
        return np.zeros(0), np.zeros((0, len(covariance)))
    scaled = covariance / trace
    diagonal, off, reflectors = tridiagonal(scaled)
    values = largest_eigenvalues(diagonal, off, count)
    values = values[values > len(scaled) * 4 * EPS]
    vectors = inverse_iteration(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        part, v = vectors[k + 1:], reflectors[k]
        part -= 2.0 * np.outer(v, v @ part)
    return values * trace, vectors.T


# ---- passes over the vectors

def usable(vector: Column) -> Column:
    """The vector is there, not empty, and every entry is a finite number."""
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number), F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its vectors as one table of integers."""
    for batch in batches:
        if batch.num_rows:
            entries = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            entries = np.clip(entries.astype(np.float64), -LARGEST, LARGEST)
            yield batch, np.floor(entries * SCALE).astype(np.int64) + OFFSET


def _exact_sums(whole: np.ndarray) -> list[int]:
    wide = int(np.abs(whole).max()) * len(whole) >= 1 << 62
    return [int(s) for s in (whole.astype(object) if wide else whole).sum(axis=0)]


def column_sums(rows: DataFrame, width: int) -> list[int]:
    """Exact sum of each dimension."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for _, whole in _blocks(batches, width):
            total = [a + b for a, b in zip(total, _exact_sums(whole), strict=True)]
        if any(total):
            yield pa.record_batch({"i": pa.array(range(width), pa.int32()),
                                   "s": pa.array([str(t) for t in total], pa.string())})

    parts = rows.mapInArrow(partial, "i int, s string")
    sums = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return [sums.get(i, 0) for i in range(width)]


def _centred(whole: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, with the subtraction made on integers wherever they fit."""
    means = [divmod(s, n) for s in sums]
    floor, rest = np.array([m[0] for m in means], dtype=np.int64), np.array([m[1] / n for m in means])
    return (whole - floor).astype(np.float64) - rest


def centred_covariance(rows: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n: every task sends one triangle of products of centred entries."""
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for _, whole in _blocks(batches, width):
            centred = _centred(whole, n, sums)
            total += centred.T @ centred
            seen = True
        if seen:
            yield pa.record_batch({"i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()),
                                   "s": pa.array(total[upper])})

    parts = rows.mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    found = parts.toPandas()
    covariance = np.zeros((width, width))
    covariance[found["i"], found["j"]] = covariance[found["j"], found["i"]] = found["s"] / n
    return covariance


def _deviations(whole: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over the dimensions of (n x - S)^2; null beyond 63 bits."""
    largest = n * int(np.abs(whole).max()) + max(map(abs, sums))
    if largest < 1 << 62:
        off = n * whole - np.array(sums, dtype=np.int64)
        peak = int(np.abs(off).max())
        if peak * peak * len(sums) < 1 << 62:
            return (off * off).sum(axis=1).tolist()
    off = n * whole.astype(object) - np.array(sums, dtype=object)
    return [int(s) if s < 1 << 63 else None for s in (off * off).sum(axis=1)]


def projected(rows: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(id, deviation, w1, w2, ...): each centred vector on the components, over the root of their variance."""
    width, names = vectors.shape[1], [f"w{k + 1}" for k in range(len(values))]
    weights = (vectors / np.sqrt(values)[:, None]).T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, whole in _blocks(batches, width):
            whitened = _centred(whole, n, sums) @ weights
            yield pa.record_batch([batch.column("id"), pa.array(_deviations(whole, n, sums), pa.int64()),
                                   *[pa.array(whitened[:, k]) for k in range(len(names))]], ["id", "deviation", *names])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(project, f"id {kind}, deviation long, " + ", ".join(f"{c} double" for c in names))


def identity_error(wide: DataFrame, names: list[str]) -> float:
    """Largest absolute entry of the covariance of the whitened columns minus the identity."""
    means = wide.agg(*[F.avg(c).alias(c) for c in names]).first()
    centred = {c: F.col(c) - F.lit(means[c]) for c in names}
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    covariances = wide.agg(*[F.avg(centred[a] * centred[b]).alias(f"{a}_{b}") for a, b in pairs]).first()
    return max(abs(covariances[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def whitened_components(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                        count: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable vector and component.

    ``whitened`` has mean 0 and, over all vectors, the identity as its covariance; ``identity_error`` says
    how closely. See the module for nulls, lengths and empty tables.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        usable(F.col("vector")))
    length = (rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), F.desc("width")).limit(1).collect())
    kind = rows.schema["id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, "
                                      "explained double, identity_error double")
    if not length:
        return empty
    width, n = length[0]["width"], length[0]["n"]
    rows = rows.where(F.size("vector") == width)
    sums = column_sums(rows, width)
    covariance = centred_covariance(rows, width, n, sums)
    values, vectors = leading_components(covariance, count)
    if not len(values):
        return empty
    names = [f"w{k + 1}" for k in range(len(values))]
    wide = materialize(projected(rows, n, sums, values, vectors), "whitened")
    error, trace = identity_error(wide, names), float(np.trace(covariance))
    long = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(c).alias("whitened"),
                              F.lit(float(values[k]) / trace).alias("explained")) for k, c in enumerate(names)])
    return wide.select(F.col("id").alias(id_col), "deviation", F.inline(long)).select(
        id_col, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"))
