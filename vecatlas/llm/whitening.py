"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Vectors are fixed-point numbers: entry c becomes x = floor(scale c) + shift. The model is fitted to each distinct vector once.
Tasks add up the scatter of x - S/n (S: sums of n vectors), so that only dim x dim numbers reach the driver, whatever n is. There
the scatter becomes L L' with the greatest remaining diagonal entry as pivot; the columns of L are then turned in pairs until all are
orthogonal. Their squared norms are the eigenvalues of the scatter, found to high relative precision since it is never squared again, and their directions its eigenvectors.

Null vectors and vectors with an entry that is null, not finite or beyond 2^52 / scale are left out, and so are vectors of another width than the
most frequent one (ties: the greater). A constant dimension has no part in any component; a scatter of rank r gives r components, so a table without rows, or with
one distinct vector, gives none and no result rows. Repeated rows and rows of the same id each get their own result; null ids are ordinary
values. Equal eigenvalues give any basis of their space. Other columns are not looked at. Vectors of any width are read whole; dim x dim numbers must fit in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import frugal, stash

MOST = 2.0**52
ROWS = 512  # rows that are multiplied together
LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their sums by dimension (exact), components as columns, their eigenvalues of the covariance, its trace, and how far whitened vectors are from unit covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def matrix(self) -> np.ndarray:
        """What centred vectors are multiplied by."""
        return self.components / np.sqrt(self.values)


def fixed_point(vectors: DataFrame, vec_col: str, scale: int, shift: int, *others: Column) -> DataFrame:
    """others and x, the array of longs, for the rows that are whole."""
    c = F.col(vec_col)
    size = float(MOST / scale)
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < size))
    return vectors.where(c.isNotNull()).where(whole).select(*others, F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("bigint") + F.lit(shift).cast("bigint")).alias("x"))


def _rows(batch, column: int, width: int):
    """Matrices of some rows each, from a column of arrays that all have the width."""
    values = batch.column(column)
    for lo in range(0, batch.num_rows, ROWS):
        part = values.slice(lo, ROWS)
        yield lo, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and their sums by dimension; each task sends a row for each dimension, in two halves that can't overflow."""

    def add(batches):
        n, total = 0, [0] * width
        for batch in batches:
            for _, x in _rows(batch, 0, width):
                n += len(x)
                total = [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([t >> 32 for t in total], pa.int64()), pa.array([t & 0xFFFFFFFF for t in total], pa.int64())], ["i", "n", "high", "low"])

    parts = rows.select("x").mapInArrow(frugal(add), "i int, n long, high long, low long")
    got = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).orderBy("i").collect()
    return (got[0]["n"], [(r["high"] << 32) + r["low"] for r in got]) if got else (0, [])


def scatter(rows: DataFrame, mean: np.ndarray, basis: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of x - mean (times basis): each task sends its own upper triangle, which Spark adds up."""
    width = len(mean)

    def add(batches):
        total, product = 0.0, None
        for batch in batches:
            for _, x in _rows(batch, 0, width):
                y = x - mean
                y = y if basis is None else y @ basis
                total, product = total + y.sum(axis=0), y.T @ y + (0.0 if product is None else product)
        if product is not None:
            i, j = np.triu_indices(len(product))
            entries = ([*range(len(product)), *i], [-1] * len(product) + [*j], np.concatenate([total, product[i, j]]))
            yield pa.RecordBatch.from_arrays([pa.array(e, t) for e, t in zip(entries, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["i", "j", "v"])

    parts = rows.select("x").mapInArrow(frugal(add), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (parts[c].to_numpy() for c in ("i", "j", "v"))
    k = width if basis is None else basis.shape[1]
    total, product = np.zeros(k), np.zeros((k, k))
    total[i[j < 0]] = v[j < 0]
    product[i[j >= 0], j[j >= 0]] = product[j[j >= 0], i[j >= 0]] = v[j >= 0]
    return total, product


def pivoted_cholesky(a: np.ndarray, tolerance: float | None = None) -> np.ndarray:
    """L (rows in the order of a) with a = L L' but for a rest whose diagonal is under tolerance times the greatest entry; in pivot order L is triangular. Its columns are as many as the rank."""
    n = len(a)
    rest, left, columns = a.diagonal().copy(), np.zeros((n, n)), 0
    least = (n * np.finfo(float).eps * 4 if tolerance is None else tolerance) * max(rest.max(initial=0.0), 0.0)
    free = np.ones(n, dtype=bool)
    while columns < n:
        p = int(np.argmax(np.where(free, rest, -np.inf)))
        if rest[p] <= least:
            break
        left[p, columns] = np.sqrt(rest[p])
        free[p] = False
        left[free, columns] = (a[free, p] - left[free, :columns] @ left[p, :columns]) / left[p, columns]
        rest[free] -= left[free, columns] ** 2
        columns += 1
    return left[:, :columns]


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms and directions of the factor's columns after turning pairs of columns until all are orthogonal; by falling norm. Rounds of disjoint pairs turn together."""
    u = factor.copy()
    n = u.shape[1]
    seats = list(range(n + n % 2))
    for _ in range(sweeps if n > 1 else 0):
        worst = 0.0
        for _ in range(len(seats) - 1):
            pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :]), strict=True) if max(a, b) < n]
            a, b = (np.array(s) for s in zip(*pairs, strict=True))
            x, y = u[:, a], u[:, b]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(xy) / np.sqrt(np.maximum(xx * yy, np.finfo(float).tiny))
            worst = max(worst, float(off.max()))
            zeta = (yy - xx) / np.where(xy == 0, 1.0, 2 * xy)
            t = np.where(xy == 0, 0.0, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)))
            c = 1 / np.hypot(1.0, t)
            u[:, a], u[:, b] = c * (x - t * y), c * (y + t * x)
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst < 1e-15 * max(n, 8):
            break
    norms = (u * u).sum(axis=0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], u[:, order] / np.sqrt(norms[order])


def fit(vectors: DataFrame, most: int = 16, vec_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> tuple[Whitening | None, int]:
    """The model of at most so many components, and the width of its vectors; None where nothing varies."""
    x = fixed_point(vectors, vec_col, scale, shift)
    widths = x.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None or not widths["width"]:
        return None, 0
    width = widths["width"]
    rows = stash(x.where(F.size("x") == width).distinct(), "distinct-vectors")
    n, sums = exact_sums(rows, width)
    mean = np.array([s / n for s in sums])
    _, product = scatter(rows, mean)
    norms, directions = jacobi(pivoted_cholesky(product))
    k = min(most, len(norms))
    if not k:
        return None, width
    values, components = norms[:k] / n, directions[:, :k]
    total, product_ = scatter(rows, mean, components / np.sqrt(values))
    off = product_ / n - np.outer(total / n, total / n) - np.eye(k)
    return Whitening(n, sums, components, values, float(np.trace(product)) / n, float(np.abs(off).max())), width


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null where no long holds it."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums))
    if most * most * len(sums) < LONG:
        d = x * np.int64(n) - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    if most < LONG and (d := np.abs(x * np.int64(n) - np.array(sums, dtype=np.int64))).size and int(d.max()) ** 2 * len(sums) < LONG:
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [e if e < LONG else None for e in exact]


def whitened(vectors: DataFrame, model: Whitening | None, width: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component, in one narrow step."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = fixed_point(vectors, vec_col, scale, shift, F.col(id_col)).where(F.size("x") == width)
    mean, matrix, k = model.mean, model.matrix, len(model.values)
    n, sums, shares, error = model.n, model.sums, (model.values / model.trace).tolist(), model.identity_error

    def run(batches):
        for batch in batches:
            for lo, x in _rows(batch, 1, width):
                ids = batch.column(0).slice(lo, len(x))
                out = (x - mean) @ matrix
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array([n] * len(each), pa.int64()), pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(out.ravel()), pa.array(shares * len(x), pa.float64()), pa.array([error] * len(each), pa.float64())],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(frugal(run), schema)
