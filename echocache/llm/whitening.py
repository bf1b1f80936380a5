"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are too tall for one machine, their triangular factor R is not: it has as many rows
and columns as a vector has entries. Each round is one pass over the rows: every task solves its rows
against the factor found so far, Q = A / R, and sums the products of Q's columns into one small
Gram matrix; the Cholesky factor of the summed matrix multiplies R from the left. The first Gram matrix
gets a shift on its diagonal, so that its factor exists however near the columns are to dependence,
and the rounds after it take the shift out again, until Q's columns are orthonormal. The singular values
and right vectors of R, which are those of A, then give the components: this keeps the small eigenvalues
that a plain covariance loses to rounding. A last pass measures how far the covariance of the
whitened rows is from the identity.

Entries are first put on a grid of whole numbers, ``floor(scale * c) + shift``. Sums and deviations of whole
numbers are exact, so they do not depend on how rows are dealt to tasks, and rows are centred before
anything is rounded. What leaves a task is one Gram matrix, and matrices are added up in two steps of
shuffles, so the driver gets a few of them at any number of tasks. The table is read once in each pass and
nothing is written down: a lost executor costs the tasks it ran.

Defined results: rows whose vector is null, is of another length than the most common one (of equally
common ones the longest) or has an entry that is null, not finite or beyond 2^52 on the grid are left
out of the fit and of the result; repeated rows count each time; components whose singular value is
within rounding of zero are not given, so equal vectors have none; an empty table has no rows, and no model.
Other columns, null or not, go through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocache.llm.bpe import extended
from echocache.llm.tables import SUMS, summed, total_batch

COMPONENTS = 8
#: Gram passes after the first, at most, and how far from the identity the last may be.
ROUNDS, ORTHOGONAL = 4, 1e-12
#: Largest whole number of an entry.
LARGEST = 1 << 52
_EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Grid:
    """How entries become whole numbers, and how many entries a vector has."""

    scale: float
    shift: int
    width: int

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which rows of a list column are in order, and their whole numbers."""
        fits = pc.fill_null(pc.equal(pc.list_value_length(column), self.width), False)
        flat = pc.cast(column.filter(fits).flatten(), pa.float64())
        with np.errstate(invalid="ignore", over="ignore"):
            values = np.floor(flat.to_numpy(zero_copy_only=False).reshape(-1, self.width) * self.scale)
            fine = (np.abs(values) <= LARGEST).all(axis=1)  # false for what is null or not finite
        good = np.flatnonzero(fits.to_numpy(zero_copy_only=False))[fine]
        return good, values[fine].astype(np.int64) + self.shift


@dataclass(frozen=True)
class Whitening:
    """A fitted model: ``components`` are rows of unit length, ``values`` their eigenvalues, falling."""

    grid: Grid
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(x) / self.trace for x in self.values]


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n times the distance of whole numbers from their mean, exact."""
    middle = [s // n for s in sums]
    near = x - np.array(middle)
    if n * (int(np.abs(near).max(initial=0)) + 1) >= 1 << 62:
        near = near.astype(object)
    return n * near - np.array([s - n * m for s, m in zip(sums, middle)])


def _rows(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return (_centred(x, n, sums) / n).astype(float)


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q @ r = a, for an upper triangular r: all rows column by column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _summed(
    df: DataFrame, vector: str, grid: Grid, width: int, kind: type, part: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray | None:
    """The sum over all rows of what ``part`` makes of a batch of whole numbers, a flat array of ``width``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (grid.rows(b.column(0))[1] for b in batches)
        yield from total_batch(part(x) for x in found if len(x))

    found = summed(df.select(vector).mapInArrow(each, SUMS), kind)
    assert found is None or len(found) == width
    return found


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor; a further shift where rounding leaves the matrix not positive."""
    step = max(shift, _EPS * float(np.trace(gram)))
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift, step = shift + step, 2 * step


def fit(
    df: DataFrame, vector: str = "embedding", *, components: int = COMPONENTS, scale: float = 1 << 20, shift: int = 0
) -> Whitening | None:
    """The whitening of all usable rows of ``df``; None where there are none."""
    lengths = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("width")).count()
    width = lengths.orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not width:
        return None
    grid = Grid(float(scale), int(shift), width[0].width)
    d = grid.width

    # Sums of whole numbers, split in halves so that they are exact for 2^31 rows of the largest.
    halves = lambda x: np.concatenate([[len(x)], (x >> 26).sum(axis=0), (x & (1 << 26) - 1).sum(axis=0)])
    found = _summed(df, vector, grid, 1 + 2 * d, np.int64, halves)
    if found is None:
        return None
    n, high, low = int(found[0]), found[1 : d + 1].tolist(), found[d + 1 :].tolist()
    sums = tuple((h << 26) + x for h, x in zip(high, low))

    def gram(r: np.ndarray | None) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            a = _rows(x, n, sums)
            q = a if r is None else solved(a, r)
            return (q.T @ q).ravel()

        return _summed(df, vector, grid, d * d, np.float64, part).reshape(d, d)

    first = gram(None)
    trace = float(np.trace(first)) / n
    if trace <= 0:
        return Whitening(grid, n, sums, np.empty((0, d)), np.empty(0), 0.0, 0.0)
    r = _factor(first, 11 * (n * d + d * (d + 1)) * _EPS * _EPS * float(np.trace(first)) + _EPS * float(np.trace(first)))
    for _ in range(ROUNDS):
        now = gram(r)
        if np.abs(now - np.eye(d)).max() <= ORTHOGONAL:
            break
        r = _factor(now, 0.0) @ r
    _, singular, right = np.linalg.svd(r)
    kept = int((singular[:components] > singular[0] * 8 * max(n, d) ** 0.5 * _EPS).sum())
    axes = right[:kept] * np.where(right[np.arange(kept), np.abs(right[:kept]).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    values = singular[:kept] ** 2 / n
    whiten = axes.T / np.sqrt(values)

    def products(x: np.ndarray) -> np.ndarray:
        w = _rows(x, n, sums) @ whiten
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    moments = _summed(df, vector, grid, kept * kept + kept, np.float64, products)
    mean = moments[kept * kept :] / n
    off = moments[: kept * kept].reshape(kept, kept) / n - np.outer(mean, mean) - np.eye(kept)
    return Whitening(grid, n, sums, axes, values, trace, float(np.abs(off).max(initial=0.0)))


def transform(
    df: DataFrame, model: Whitening | None, vector: str = "embedding", *,
    whitened: str = "whitened", deviation: str = "deviation",
) -> DataFrame:
    """Usable rows of ``df`` with their whitened vector and the exact squared distance from the sum.

    ``deviation`` is the sum over entries of (n * x - S)^2, a decimal(38,0).
    """
    schema = extended(df, {whitened: T.ArrayType(T.DoubleType()), deviation: T.DecimalType(38, 0)})
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    n, sums, grid, axes = model.n, model.sums, model.grid, model.components.T / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = grid.rows(batch.column(batch.schema.get_field_index(vector)))
            far = _centred(x, n, sums)
            w = (far / n).astype(float) @ axes
            ends = np.arange(0, w.size + 1, axes.shape[1]) if axes.shape[1] else np.zeros(len(w) + 1, int)
            most = int(np.abs(far).max(initial=0))
            square = (far.astype(object) if most * most * grid.width >= 1 << 62 else far) ** 2
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(w.ravel()))
            exact = pa.array(square.sum(axis=1).tolist(), pa.decimal128(38, 0))
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns, lists, exact], [*kept.schema.names, whitened, deviation])

    return df.mapInArrow(run, schema)
