"""Whitening of embeddings: principal components from FEAST contour integration.

Counts, sums and the covariance come from passes over the vectors in Spark; what reaches the driver is one number per
pair of dimensions. The upper part of the spectrum is sliced into intervals by inertia counts, and each interval is a
Spark task of its own: solves with the covariance at complex shifts on a circle around the interval project onto its
eigenvectors, Rayleigh-Ritz extracts them, and the inertia count of the interval says whether one is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.session import local_frame

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LIMIT = 2.0**31  # entries beyond have no exact x
NODES = 8  # shifts on the upper half of a circle
PER_SLICE = 4  # eigenvalues that a slice aims at
_SWEEPS = 12
_TINY = np.finfo(float).tiny
_MOST = float(1 << 63)


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def whole_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are vectors of ``width`` usable entries, and their x = floor(1024 c) + 100000 as integers."""
    lengths = _lengths(column)
    held = np.maximum(lengths, 0)
    starts = np.cumsum(held) - held
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null entries become nan
    rows = np.flatnonzero(lengths == width)
    if not width or not len(rows):
        return rows[:0], np.zeros((0, width), np.int64)
    values = flat[starts[rows][:, None] + np.arange(width)].astype(np.float64)
    good = (np.abs(values) < LIMIT).all(axis=1)  # false for nan as well
    return rows[good], np.floor(SCALE * values[good]).astype(np.int64) + SHIFT


def _batches(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


@dataclass(frozen=True)
class Center:
    """Number of vectors, their width and the exact sum of every dimension."""

    n: int
    sums: tuple[int, ...]

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double, without the rounding of large numbers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over the dimensions of (n x - S)^2; null where it does not fit 64 bits."""
        about = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        out: list[int | None] = [None] * len(x)
        # A sum that fits has terms that fit.
        fits = np.flatnonzero(about < _MOST * (1 - 1e-9))
        exact = ((self.n * (x[fits] - whole) - rest) ** 2).sum(axis=1)
        for i, v in zip(fits.tolist(), exact.tolist()):
            out[i] = v
        for i in np.flatnonzero((about >= _MOST * (1 - 1e-9)) & (about < _MOST * (1 + 1e-9))).tolist():
            value = sum((self.n * int(c) - s) ** 2 for c, s in zip(x[i], self.sums))
            out[i] = value if value < 1 << 63 else None
        return out


def measure(vectors: DataFrame) -> Center | None:
    """Center of the usable vectors; of several widths the most frequent one is meant (of equally many, the largest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(1)
            for width in np.unique(_lengths(column)).tolist():
                if width > 0:
                    rows, x = whole_vectors(column, width)
                    counts[width] = counts.get(width, 0) + len(rows)
                    # Kept as Python integers, which do not overflow.
                    sums[width] = sums.get(width, 0) + x.sum(axis=0).astype(object)
        for width, n in counts.items():
            digits = [str(v) for v in sums[width]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(digits)],
                names=["width", "place", "n", "total"],
            )

    parts = _batches(vectors).mapInArrow(run, "width int, place int, n long, total string")
    found = parts.groupBy("width", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    most = found.filter("n > 0").agg(F.max(F.struct("n", "width")).alias("m")).first()["m"]
    if most is None:
        return None
    rows = found.filter(F.col("width") == most["width"]).orderBy("place").collect()  # one a dimension
    return Center(most["n"], tuple(int(r["total"]) for r in rows))


def _gram(vectors: DataFrame, center: Center, made: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all vectors of the outer product of ``made`` (centred vectors to rows of ``size`` numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            _, x = whole_vectors(batch.column(1), center.width)
            rows = made(center.centred(x))
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total))], names=["i", "row"])

    cells = _batches(vectors).mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((size, size))
    for i, j, v in cells.groupBy("i", "j").agg(F.sum("v")).collect():  # one a pair of dimensions
        out[i, j] = v
    return (out + out.T) / 2


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and subdiagonal of a matrix that Householder reflections make from a symmetric one."""
    a = np.array(matrix, float)
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size > _TINY:
            v /= size
            a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Inertia:
    """Counts of eigenvalues below a shift, from the signs of the pivots of the shifted matrix."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.diagonal, off = tridiagonal(matrix)
        self.square = off * off
        around = np.abs(np.concatenate([[0.0], off, [0.0]]))
        reach = around[:-1] + around[1:]
        self.low, self.high = float((self.diagonal - reach).min()), float((self.diagonal + reach).max())
        self.scale = max(abs(self.low), abs(self.high))
        self.step = 1e-13 * self.scale

    def below(self, shift: float) -> int:
        count, pivot, least = 0, 1.0, max(_TINY, np.finfo(float).eps ** 2 * self.scale)
        for i, d in enumerate(self.diagonal.tolist()):
            pivot = d - shift - (self.square[i - 1] / pivot if i else 0.0)
            if abs(pivot) < least:
                pivot = -least
            count += pivot < 0
        return count

    def cut(self, low: float, high: float) -> float | None:
        """A place between the ends, near the middle, that no eigenvalue is close to; None if there is none."""
        margin = max(self.step, 1e-4 * (high - low))
        for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7):
            at = low + part * (high - low)
            if self.below(at - margin) == self.below(at + margin):
                return at
        return None

    def slices(self, count: int) -> list[tuple[float, float, int]]:
        """Intervals (low, high, eigenvalues inside) that hold the ``count`` largest eigenvalues at least.

        An interval holds more than ``PER_SLICE`` only where they lie too close together to be cut.
        """
        n = len(self.diagonal)
        margin = max(4 * self.step, 1e-3 * self.scale)
        out, stack = [], [(self.low - margin, self.high + margin, n)]
        while stack and sum(s[2] for s in out) < count:
            low, high, inside = stack.pop()
            if not inside:
                continue
            at = self.cut(low, high) if inside > PER_SLICE and high - low > 64 * self.step else None
            if at is None:
                out.append((low, high, inside))
                continue
            upper = inside - (self.below(at) - self.below(low))
            stack += [(low, at, inside - upper), (at, high, upper)]
        return out


def feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high`` and their unit eigenvectors, as columns.

    One sweep applies the filter 1 / 2 pi i times the integral of (z - V)^-1 along the circle through both ends, by
    ``NODES`` Gauss points on its upper half (the lower half is conjugate), to a block of vectors, and takes the Ritz
    pairs of what comes out. The block has more vectors than the interval has eigenvalues; if that is not enough to find
    all of them to double precision, it grows, at last to all dimensions, where Ritz pairs are eigenpairs.
    """
    n = len(matrix)
    middle, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    around = np.exp(1j * np.pi * (points + 1) / 2)
    limit = 1e-14 * n * max(np.abs(matrix).sum(axis=1).max(), _TINY)
    size = min(n, 2 * count + 4)
    rng = np.random.default_rng(seed)
    block = rng.normal(size=(n, size))
    while True:
        for _ in range(_SWEEPS if size < n else 1):
            if size < n:
                filtered = np.zeros((n, size))
                for w, e in zip(weights, around):
                    filtered += w / 2 * (radius * e * np.linalg.solve((middle + radius * e) * np.eye(n) - matrix, block.astype(complex))).real
            else:
                filtered = np.eye(n)
            basis, _ = np.linalg.qr(filtered)
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turned
            inside = np.flatnonzero((values >= low) & (values < high))
            far = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if len(inside) == count and (far <= limit).all() or size == n:
                return values[inside], block[:, inside]
        size = min(n, 2 * size)
        block = np.hstack([block, rng.normal(size=(n, size - block.shape[1]))])


def largest_eigenpairs(spark, matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``count`` largest eigenvalues, falling, with unit eigenvectors as columns; those that are zero in double are left out."""
    if not np.abs(matrix).max() > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    inertia = Inertia(matrix)
    parts = inertia.slices(min(count, len(matrix)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high, inside in frame.itertuples(index=False):
                values, vectors = feast(matrix, low, high, int(inside))
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    tasks = local_frame(spark, parts, "low double, high double, inside long").repartition(len(parts))
    found = tasks.mapInPandas(run, "value double, vector array<double>").collect()
    if len(found) != sum(p[2] for p in parts):
        raise ArithmeticError(f"{len(found)} eigenpairs where inertia counts {sum(p[2] for p in parts)}")
    # One more Rayleigh-Ritz step over all slices makes the vectors orthogonal to each other.
    basis, _ = np.linalg.qr(np.array([r["vector"] for r in found]).T)
    values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:count]
    order = order[values[order] > len(matrix) * np.finfo(float).eps * values.max()]
    return values[order], basis @ turned[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: ``values`` and ``vectors`` (columns) of the components, trace of the covariance."""

    center: Center
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Center and components of all usable vectors of ``vectors`` (embedding); None without any."""
    center = measure(vectors)
    if center is None:
        return None
    covariance = _gram(vectors, center, lambda y: y, center.width) / center.n
    values, axes = largest_eigenpairs(vectors.sparkSession, covariance, components)
    return Whitening(center, values, axes, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, measured on all of them."""
    size, projection = len(model.values), model.projection
    # A last column of ones gives the means.
    total = _gram(vectors, model.center, lambda y: np.hstack([y @ projection, np.ones((len(y), 1))]), size + 1) / model.center.n
    mean = total[:-1, -1]
    return float(np.abs(total[:-1, :-1] - np.outer(mean, mean) - np.eye(size)).max(initial=0.0))


_ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(vectors: DataFrame, model: Whitening, error: float) -> DataFrame:
    """One row per usable vector and component, see ``whiten``."""
    size, projection = len(model.values), model.projection
    explained = model.values / model.trace if size else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_vectors(batch.column(1), model.center.width)
            many = len(rows) * size
            at = pa.array(np.repeat(rows, size))
            deviation = pa.array(model.center.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(rows))), pa.array(np.full(many, model.center.n)),
                deviation.take(pa.array(np.repeat(np.arange(len(rows)), size))), pa.array((model.center.centred(x) @ projection).reshape(-1)),
                pa.array(np.tile(explained, len(rows))), pa.array(np.full(many, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _batches(vectors).mapInArrow(run, _ROW)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all vectors (vec_id, embedding), fitted to all of them.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are entries of 2^31 or more,
    for which x = floor(1024 c) + 100000 is not exact, and vectors of another width than most. Rows that repeat count
    and are returned each. Per remaining row and component (from 1, by falling eigenvalue, at most ``components``): ``n``,
    ``deviation`` (exact; null where it does not fit a long), ``whitened``, ``explained`` and ``identity_error``. Components without
    variance are left out, so equal vectors, or an empty table, give no rows. Reads the vectors four times; other columns
    of the input are not read.
    """
    model = fit(vectors, components)
    if model is None:
        return local_frame(vectors.sparkSession, [], _ROW)
    return transform(vectors, model, identity_error(vectors, model))
