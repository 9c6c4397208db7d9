"""Whitening of embeddings along the eigenvectors of their covariance.

Sums and centred products are added up in tasks, as matrices of the vectors' dimension, and
only those reach the driver. Eigenvectors start from a float32 solution. Each iteration of
Ogita and Aishima corrects all of them at once by matrix products in extended precision;
eigenvalues that are too close for it, as judged by the current error, are clusters, in
which the matrix is shifted, scaled and solved anew, the same way.

Vectors enter as whole numbers, floor(scale * entry) + offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opquality.llm.common import map_arrow, write_parquet

SCALE, OFFSET = 64, 1_000_000
MOST_COMPONENTS = 32
# Vectors are multiplied in pieces of so many.
ROWS_AT_ONCE = 1 << 12
ITERATIONS = 24
LONG = 1 << 63
# The precision in which the iterations run; at least that of a double.
HIGH = np.longdouble


def _float32_start(a: np.ndarray) -> np.ndarray:
    return np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)


def _clusters(values: np.ndarray, width) -> list[np.ndarray]:
    """Places of values that lie within width of their neighbour in order."""
    order = np.argsort(values, kind="stable")
    return [c for c in np.split(order, np.flatnonzero(np.diff(values[order]) > width) + 1) if len(c) > 1]


def refined_eigenvectors(a: np.ndarray, depth: int = 0) -> np.ndarray:
    """Orthonormal eigenvectors, as columns, of a symmetric matrix, to extended precision.
    Those of equal eigenvalues are some basis of their space."""
    a = a.astype(HIGH)
    n, unit = len(a), np.finfo(HIGH).eps
    size = np.abs(a).max(initial=0)
    if n < 2 or size == 0 or not np.isfinite(size):
        return np.eye(n, dtype=HIGH)
    a = a / size
    x = _float32_start(a)
    identity = np.eye(n, dtype=HIGH)
    for _ in range(ITERATIONS):
        loss = identity - x.T @ x
        turned = x.T @ a @ x
        values = np.diagonal(turned) / (1 - np.diagonal(loss))
        off = turned - np.diag(values)
        width = 8 * (np.sqrt((off ** 2).sum()) + np.sqrt((a ** 2).sum()) * np.sqrt((loss ** 2).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > width
        step = np.where(apart, (turned + values[None, :] * loss) / np.where(apart, gap, 1), loss / 2)
        x = x + x @ step
        solved = False
        for cluster in _clusters(values, width):
            own = x[:, cluster]
            inner = own.T @ a @ own
            inner = (inner + inner.T) / 2
            inner = inner - np.trace(inner) / len(cluster) * np.eye(len(cluster), dtype=HIGH)
            # What is left of equal eigenvalues is rounding; there is nothing to turn.
            if np.abs(inner).max() > 64 * n * unit and np.abs(inner - np.diag(np.diagonal(inner))).max() > 4 * n * unit and depth < 4:
                x[:, cluster] = own @ refined_eigenvectors(inner, depth + 1)
                solved = True
        if not solved and np.abs(step).max() < 8 * n * unit:
            break
    # Turning inside a cluster leaves no time to correct what it lost; this does.
    for _ in range(ITERATIONS):
        loss = identity - x.T @ x
        if np.abs(loss).max() < 4 * n * unit:
            break
        x = x + x @ loss / 2
    return x


@dataclass(frozen=True)
class Whitening:
    """components: unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def _matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(lo, ROWS_AT_ONCE)


def whole_numbers(df: DataFrame, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """id and x, for the vectors that can be used. Left out are null vectors, those with
    null or non-finite entries or with entries whose number does not fit a long, empty
    ones, and those of another length than most (of equally many, the longer)."""
    usable = F.forall("vector", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit((LONG >> 1) / scale)), F.lit(False)))
    given = df.select("id", F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(usable)
    common = given.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).head()
    length = common.length if common else 0
    x = F.transform("vector", lambda c: F.floor(c * scale) + F.lit(offset).cast("long"))
    return given.where(F.size("vector") == length).select("id", x.alias("x"), F.lit(length).alias("length"))


def _exact(x: np.ndarray, factor: int = 1) -> np.ndarray:
    """As long if sums and multiples of it are sure to fit, else as Python's numbers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)
    return x if most * factor < LONG else x.astype(object)


def _sums(table: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each entry, from one row per entry a task."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimension, dtype=object)
        for batch in _pieces(batches):
            x = _matrix(batch.column(0), dimension)
            n, total = n + len(x), total + _exact(x, len(x) + 1).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension, dtype=np.int32)), pa.array([str(t) for t in total]), pa.array(np.full(dimension, n))], names=["i", "total", "n"])

    found = map_arrow(table.select("x"), tasks, "i int, total string, n long")
    rows = found.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    return (rows[0].n if rows else 0), [int(r.total) for r in sorted(rows, key=lambda r: r.i)]


def _covariance(table: DataFrame, column: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Of vectors with this mean: each task adds up the products of centred vectors, and
    gives one row per cell of the matrix."""
    dimension = len(mean)
    upper = np.triu_indices(dimension)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = None
        for batch in _pieces(batches):
            centred = _matrix(batch.column(0), dimension) - mean
            products = (0 if products is None else products) + centred.T @ centred
        if products is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(products[upper])], names=["cell", "total"])

    found = map_arrow(table.select(column), tasks, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    out = np.zeros((dimension, dimension))
    # One row per cell: bounded by the dimension.
    for cell, total in found.collect():
        out[upper[0][cell], upper[1][cell]] = out[upper[1][cell], upper[0][cell]] = total / n
    return out


def fit(table: DataFrame, dimension: int, most: int = MOST_COMPONENTS) -> Whitening:
    """From all rows of a table of x. Components whose eigenvalue is 0 to the precision of
    a double, next to the largest, are left out."""
    n, sums = _sums(table, dimension)
    if not n:
        return Whitening(0, (), np.zeros((dimension, 0)), np.zeros(0), 0.0)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    v = _covariance(table, "x", mean, n)
    vectors = refined_eigenvectors(v)
    values = ((v.astype(HIGH) @ vectors) * vectors).sum(axis=0) / (vectors * vectors).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > dimension * np.finfo(np.float64).eps * np.abs(values).max(initial=0)][:most]
    chosen = vectors[:, order]
    chosen = chosen / np.sqrt((chosen * chosen).sum(axis=0))
    # Either sign is right; the largest entry is made positive.
    chosen = chosen * np.where(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
    return Whitening(n, tuple(sums), chosen.astype(np.float64), values[order].astype(np.float64), float(np.trace(v)))


def apply(table: DataFrame, model: Whitening) -> DataFrame:
    """Per row: id, deviation, the exact sum of (n * x - sum)^2 over entries (null if it does
    not fit a long), and whitened, one double per component."""
    dimension = len(model.sums)
    id_type = table.schema["id"].dataType.simpleString()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn = model.mean, model.components / np.sqrt(model.eigenvalues)
        sums = np.array(model.sums, dtype=object)
        most_sum = max(map(abs, model.sums))
        for batch in _pieces(batches):
            x = _matrix(batch.column(1), dimension)
            most = max(abs(int(x.max())), abs(int(x.min())))
            if model.n * most + most_sum < 1 << 62:
                away = model.n * x - sums.astype(np.int64)
            else:
                away = model.n * x.astype(object) - sums
            furthest = max(abs(int(away.max())), abs(int(away.min())))
            if furthest * furthest * dimension < LONG:
                squares = (away.astype(np.int64) ** 2).sum(axis=1).tolist()
            else:
                squares = (away.astype(object) ** 2).sum(axis=1).tolist()
            whitened = (x - mean) @ turn
            edges = np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([s if s < LONG else None for s in squares], pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(whitened.reshape(-1))),
            ], names=["id", "deviation", "whitened"])

    return map_arrow(table.select("id", "x"), tasks, f"id {id_type}, deviation long, whitened array<double>")


def _identity_error(whitened: DataFrame, n: int, components: int) -> float:
    """Largest entry, by size, of the covariance of whitened vectors minus the identity."""
    means = whitened.select(F.posexplode("whitened")).groupBy("pos").agg((F.sum("col") / n).alias("mean")).collect()
    mean = np.array([r["mean"] for r in sorted(means, key=lambda r: r.pos)])
    return float(np.abs(_covariance(whitened, "whitened", mean, n) - np.eye(components)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST_COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, Whitening, float]:
    """A table of id, deviation and whitened (one entry per component), the fit, and the
    largest error of the whitened covariance.

    Fit on all usable vectors, see whole_numbers. Repeated rows and ids are rows of their
    own, null ids are kept, and columns beside these two do not matter. Without usable
    vectors, or if all are equal, there are no components and the error is 0; then, and for
    an empty table, whitened is empty or there are no rows.
    """
    numbers = write_parquet(whole_numbers(df.select(df[f"`{id_col}`"].alias("id"), df[f"`{vector_col}`"].alias("_vector")), "_vector", scale, offset), "whitening-numbers")
    first = numbers.select("length").head()
    model = fit(numbers, first.length if first else 1, most)
    if not model.n:
        return numbers.select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), model, 0.0
    out = write_parquet(apply(numbers, model), "whitened")
    count = len(model.eigenvalues)
    return out, model, _identity_error(out, model.n, count) if count else 0.0
