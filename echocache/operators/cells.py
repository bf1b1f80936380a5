"""Cells: which entries a request has to be compared with.

``one_cell`` compares everything inside a collection. ``pivot_cells`` drops cells that cannot
hold a match by the triangle inequality and loses nothing. ``lsh_cells`` compares only rows that
share a random-projection bucket, so it may lose matches; callers ask for it by name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators.blockjoin import closeness, matrix, points
from echocache.scratch import materialize

# Error of a squared distance computed from products, as a share of both squared lengths.
_ERROR = 1e-12
# The cell of collections that are kept whole.
WHOLE = -1
# A request as it looks for cells: entries within ``reach`` are wanted.
ASKED = ["collection", "request_id", "seq", "vector", "reach"]
ASKED_DDL = "collection string, request_id string, seq long, vector array<double>, reach double"
# Parts by distance from its pivot that a pivot's entries are cut into.
RINGS = 8
# Rows tried out before an index is built, and the share of pairs that must go for it to pay.
TRIED, WORTH = 256, 0.5
# Rows measured against all pivots at a time, and numbers of a table of rows by cells that is worked out at a time.
_SLICE, NUMBERS = 1024, 1 << 20


def one_cell(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cell", F.lit(0))


def radius(threshold: float, metric: str) -> float:
    """Euclidean distance between compared points at the threshold."""
    squared = {"cosine": 2.0 - 2.0 * threshold, "l2sq": threshold, "l2": threshold * threshold}
    return float(np.sqrt(max(squared[metric], 0.0)))


def drawn(rows: DataFrame, order: Column, n: int, total: int | None, *ties: str) -> list[list[float]]:
    """Vectors of the ``n`` rows with the smallest ``order``, a hash.

    With the ``total`` of the rows, a cut-off on the hash lets through four times as many as wanted, so that a
    task sends a few rows and not ``n``. Where that should be too few, all rows are asked.
    """
    share = 1.0 if not total else 4.0 * n / total
    rows = rows.select("vector", order.alias("_order"), *ties)
    take = lambda x: [r.vector for r in x.orderBy("_order", *ties).limit(n).select("vector").collect()]
    if share >= 1:
        return take(rows)
    found = take(rows.where(F.col("_order") < F.lit(-(1 << 63) + int(share * (1 << 64)))))
    return found if len(found) >= n else take(rows)


class Pivots:
    """A fixed small set of entries, numbered, held by the driver and sent to the tasks.

    They are the ``n_pivots`` entries with the smallest hashed key, or vectors given as a list. Collections may
    have different dimensions; a row is only measured against pivots of its own.
    """

    def __init__(self, entries: DataFrame | list, metric: str, n_pivots: int = 0, total: int | None = None):
        if isinstance(entries, list):
            self.vectors = entries
        else:
            self.vectors = drawn(entries, F.xxhash64("collection", "seq"), n_pivots, total, "collection", "seq")
        by_size: dict[int, list] = {}
        for number, vector in enumerate(self.vectors):
            by_size.setdefault(len(vector), []).append((number, vector))
        self.metric, self.n = metric, len(self.vectors)
        self.groups = {
            size: (np.array([n for n, _ in group]), points(np.array([v for _, v in group]), metric))
            for size, group in by_size.items()
        }

    def distances(self, vectors: pa.Array) -> Iterator[tuple]:
        """For each dimension, in slices: rows, pivot numbers, squared distances and their error."""
        sizes = np.diff(vectors.offsets.to_numpy())
        for size in np.unique(sizes):
            of_size = np.flatnonzero(sizes == size)
            number, pivots = self.groups.get(int(size), (np.empty(0, int), np.empty((0, size))))
            for at in range(0, len(of_size), _SLICE):
                rows = of_size[at : at + _SLICE]
                part = points(matrix(pa.chunked_array([vectors.take(pa.array(rows))])), self.metric)
                error = _ERROR * ((part * part).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :])
                yield rows, number, -closeness(part, pivots, "l2sq"), error

    def gaps(self) -> np.ndarray:
        """Distance between every two pivots; infinite between dimensions."""
        found = np.full((self.n, self.n), np.inf)
        for number, pivots in self.groups.values():
            for i, row in zip(number, pivots):
                found[i, number] = np.sqrt(((pivots - row) ** 2).sum(axis=1))
        return found


def _low(squared: np.ndarray, error: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squared - error, 0.0))


def _high(squared: np.ndarray, error: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squared, 0.0) + error)


class Cells:
    """Which cells can hold an entry within ``reach`` of a request.

    A cell has a pivot, the least and largest distance of its entries from it, and the largest
    error of any squared distance in it. An entry of the cell is at least |d - gap| away from a
    request at distance d from the pivot, for some gap in that range; and as the entry is nearer
    to this pivot than to another, it is at least as far as the plane between the two.
    """

    def __init__(self, cells: dict[int, tuple[float, float, float]], between: np.ndarray, reach: float):
        self.ids = np.array(sorted(c for c in cells if c >= 0), int)
        self.pivot = self.ids // RINGS
        found = np.array([cells[c] for c in self.ids]).reshape(len(self.ids), 3)
        self.least, self.most, self.error = found.T
        self.between, self.reach = between, reach
        self.whole = WHOLE in cells

    def visited(
        self, number: np.ndarray, squared: np.ndarray, error: np.ndarray, reach: np.ndarray | None = None
    ) -> np.ndarray:
        """(row, cell index) matrix of what has to be compared; ``number`` are the pivots measured.

        Rows may have a ``reach`` of their own.
        """
        step = max(1, NUMBERS // max(1, len(self.ids)))
        if len(squared) > step:
            parts = (slice(lo, lo + step) for lo in range(0, len(squared), step))
            return np.concatenate([
                self.visited(number, squared[x], error[x], None if reach is None else reach[x]) for x in parts
            ])
        place = np.full(len(self.between), -1)
        place[number] = np.arange(len(number))
        at = place[self.pivot]
        out = np.zeros((len(squared), len(self.ids)), bool)
        some = np.flatnonzero(at >= 0)
        if not len(some) or not len(squared):
            return out
        near, wrong, column = squared.argmin(axis=1), error, at[some]
        room = (self.reach if reach is None else reach[:, None]) * (1 + 1e-9)
        keep = _low(squared, wrong)[:, column] <= self.most[some] + room
        keep &= _high(squared, wrong)[:, column] >= self.least[some] - room
        rows = np.arange(len(squared))
        apart = self.between[self.pivot[some][None, :], number[near][:, None]]
        beyond = squared[:, column] - squared[rows, near][:, None]
        slack = wrong[:, column] + wrong[rows, near][:, None] + 2 * self.error[some]
        with np.errstate(invalid="ignore"):  # no distance times an infinite reach
            keep &= (beyond - slack <= 2 * apart * room) | (apart == 0)
        out[:, some] = keep
        return out


def measured(pivots: Pivots, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest pivot of each row, the distance to it and the error of its square."""
    n = len(vectors)
    cell, gap, wrong = np.full(n, WHOLE), np.zeros(n), np.zeros(n)
    for rows, number, squared, error in pivots.distances(vectors):
        if len(number):
            near = squared.argmin(axis=1)
            each = np.arange(len(rows))
            cell[rows], wrong[rows] = number[near], error.max(axis=1)
            gap[rows] = np.sqrt(squared[each, near])
    return cell, gap, wrong


def worth_it(
    requests: DataFrame, entries: DataFrame, pivots: Pivots, reach: float, totals: tuple[int, int] = (0, 0)
) -> bool:
    """Whether pivots drop enough pairs, tried out on a few rows of each side.

    The answer decides how the work is done, not what is found. At most ``TRIED`` vectors of each
    side come to the driver.
    """
    order = lambda *c: F.xxhash64(F.lit(1), *c)
    some = lambda rows, n, *c: pa.array(drawn(rows, order(*c), TRIED, n), pa.list_(pa.float64()))
    held = some(entries, totals[1], "collection", "seq")
    asked = some(requests, totals[0], "collection", "request_id")
    cell, gap, wrong = measured(pivots, held)
    # Every tried entry as a ring of its own shows what rings can do.
    known = {int(c) * RINGS: None for c in cell if c >= 0}
    found = {}
    for c in known:
        mine = cell == c // RINGS
        found[c] = (gap[mine].min(), gap[mine].max(), wrong[mine].max())
    cells = Cells(found, pivots.gaps(), reach)
    weight = np.array([(cell == c // RINGS).sum() for c in cells.ids])
    kept = 0
    for _, number, squared, error in pivots.distances(asked):
        kept += (cells.visited(number, squared, error) * weight).sum()
    return kept <= WORTH * len(held) * len(asked)


class Index:
    """Pivots and what is known of their cells: it tells which cells a request has to look at.

    Requests carry their ``reach`` and no lists of cells, which would grow with the table: whoever needs the cells
    works them out, for a slice of rows at a time.
    """

    def __init__(self, pivots: Pivots, known: dict[int, tuple[float, float, float]]):
        self.pivots, self.between = pivots, pivots.gaps()
        self.cells = Cells(known, self.between, 0.0)

    def of(self, cell: np.ndarray, gap: np.ndarray, error: np.ndarray) -> tuple[Cells, np.ndarray]:
        """The cells of some entries, which lie sorted by cell, and where those of each begin and the last end."""
        ids, starts = np.unique(cell, return_index=True)
        least, most, wrong = (f.reduceat(x, starts) for f, x in ((np.minimum, gap), (np.maximum, gap), (np.maximum, error)))
        known = {int(c): span(*x) for c, *x in zip(ids, least, most, wrong)}
        return Cells(known, self.between, 0.0), np.r_[starts, len(cell)]

    def looked_at(self, vectors: pa.Array, reach: np.ndarray, known: Cells | None = None) -> Iterator[tuple]:
        """Slices of rows, and the (row, cell) matrix of the cells that they look at."""
        known = known or self.cells
        for rows, number, squared, error in self.pivots.distances(vectors):
            yield rows, known.visited(number, squared, error, reach[rows])


def _lists(batches: Iterator[pa.RecordBatch], index: Index, places: Callable) -> Iterator[pa.RecordBatch]:
    """Batches with a last column of lists: ``places`` of the (row, cell) matrix are rows and numbers, in the order of rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _SLICE):
            part = batch.slice(lo, _SLICE)
            keep = np.zeros((part.num_rows, len(index.cells.ids)), bool)
            for rows, kept in index.looked_at(part["vector"], part["reach"].to_numpy()):
                keep[rows] = kept
            rows, numbers = places(keep)
            ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=part.num_rows))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "_numbers"])


def with_numbers(asked: DataFrame, index: Index, places: Callable, name: str) -> DataFrame:
    """``asked`` with a row for each number that ``places`` gives it; see ``_lists``."""
    found = asked.select(*ASKED).mapInArrow(lambda batches: _lists(batches, index, places), f"{ASKED_DDL}, _numbers array<int>")
    return found.select(*ASKED, F.explode("_numbers").alias(name))


def any_looks_at(asked: DataFrame, index: Index) -> list[int]:
    """The cells that some request has to look at; a task sends each of them once."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(index.cells.ids), bool), 0
        for batch in batches:
            rows += batch.num_rows
            if not seen.all():
                for _, kept in index.looked_at(batch["vector"], batch["reach"].to_numpy()):
                    seen |= kept.any(axis=0)
        found = [WHOLE] * (index.cells.whole and rows > 0) + index.cells.ids[seen].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["cell"])

    return sorted(r.cell for r in asked.select("vector", "reach").mapInArrow(union, "cell int").distinct().collect())


def pivot_cells(*given) -> tuple[DataFrame, DataFrame]:
    """The requests of ``pivot_index`` with a row for each cell that they look at, and the entries."""
    asked, placed, index = pivot_index(*given)
    return each_visit(asked, index), placed


def pivot_index(
    requests: DataFrame,
    entries: DataFrame,
    metric: str,
    threshold: float,
    pivots: Pivots,
    small_collection: int,
) -> tuple[DataFrame, DataFrame, Index]:
    """Entries go to a ring around their nearest pivot; the index tells which rings a request has to look at.

    Collections of at most ``small_collection`` entries stay in one cell. The driver and the tasks
    hold the pivots and a few numbers for each ring, whatever the size of the data.
    """
    reach = radius(threshold, metric)
    size = F.size("vector")
    known = entries.groupBy("collection").agg(
        F.count(F.lit(1)).alias("n_entries"), F.min(size).alias("low"), F.max(size).alias("high")
    )
    # Dropped cells would hide unequal dimensions, so they are looked for here.
    uneven = F.raise_error(F.lit(S.VECTOR_DIMENSION)).cast(S.VECTOR)
    same = (size == F.col("low")) & (size == F.col("high"))
    checked = F.when(same, F.col("vector")).otherwise(uneven).alias("vector")
    sized = entries.join(known, "collection").select("collection", "seq", checked, "n_entries")
    asked = requests.join(known, "collection").select("collection", "request_id", "seq", checked, F.lit(reach).alias("reach"))

    placed = place_in_rings(sized, pivots, small_collection)
    spans = placed.groupBy("cell").agg(F.min("gap").alias("a"), F.max("gap").alias("b"), F.max("error").alias("e"))
    return asked, placed, Index(pivots, ranges(spans))


def place_in_rings(entries: DataFrame, pivots: Pivots, small_collection: int | None = None) -> DataFrame:
    """collection, seq and vector with ``pivot``, ``gap``, ``error`` and ``cell``.

    With ``small_collection``, entries with at most so many in their column ``n_entries`` share one cell.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, gap, wrong = measured(pivots, batch["vector"])
            table = pa.Table.from_batches([batch])
            if small_collection is not None:
                cell[batch["n_entries"].to_numpy() <= small_collection] = WHOLE
                table = table.drop_columns(["n_entries"])
            table = table.append_column("pivot", pa.array(cell.astype(np.int32)))
            table = table.append_column("gap", pa.array(gap))
            yield from table.append_column("error", pa.array(wrong)).to_batches()

    schema = "collection string, seq long, vector array<double>, pivot int, gap double, error double"
    placed = materialize(entries.mapInArrow(assign, schema), "placed")
    edges = ring_edges(placed)
    ring = F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("gap"))), F.lit(0))
    cell = F.when(F.col("pivot") < 0, F.lit(WHOLE)).otherwise(F.col("pivot") * RINGS + ring)
    return placed.join(F.broadcast(edges), "pivot", "left").withColumn("cell", cell.cast("int"))


def ring_edges(placed: DataFrame) -> DataFrame:
    """``RINGS`` - 1 distances for each pivot that has entries, between its rings."""
    parts = [i / RINGS for i in range(1, RINGS)]
    return placed.where("pivot >= 0").groupBy("pivot").agg(F.percentile_approx("gap", parts, 1000).alias("edges"))


def span(a: float, b: float, e: float) -> tuple[float, float, float]:
    return math.sqrt(max(a * a - e, 0.0)), math.sqrt(b * b + e), e


def ranges(spans: DataFrame) -> dict[int, tuple[float, float, float]]:
    """What ``Cells`` wants to know of each cell, from its least and largest gap ``a``, ``b`` and error ``e``."""
    return {r.cell: span(r.a, r.b, r.e) for r in spans.collect()}


def each_visit(asked: DataFrame, index: Index) -> DataFrame:
    """A row of the request and ``cell`` for each cell that it has to look at."""
    ids, whole = index.cells.ids, index.cells.whole

    def places(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.column_stack([np.full(len(keep), whole), keep])
        rows, at = np.nonzero(keep)
        return rows, np.r_[WHOLE, ids][at]

    # Visits to cells that a collection does not have meet no entries and disappear in the join.
    return with_numbers(asked, index, places, "cell")


def lsh_cells(
    requests: DataFrame,
    entries: DataFrame,
    metric: str,
    width: float,
    tables: int,
    projections: int,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """One cell per table and combination of buckets; a row is in ``tables`` cells.

    In each table a row is projected on ``projections`` random directions, and each projection is
    cut into buckets of ``width``. Rows are in one cell of a table if all of its buckets agree.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            vectors = batch["vector"]
            sizes = np.diff(vectors.offsets.to_numpy())
            cells = np.zeros((batch.num_rows, tables), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                if int(size) not in known:
                    rng = np.random.default_rng([seed, int(size)])
                    known[int(size)] = (
                        rng.normal(size=(int(size), tables * projections)), rng.uniform(0, width, tables * projections),
                        rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1,
                    )
                directions, shift, odd = known[int(size)]
                part = points(matrix(pa.chunked_array([vectors.take(pa.array(rows))])), metric)
                bucket = np.floor((part @ directions + shift) / width).astype(np.int64)
                mixed = (bucket.reshape(len(rows), tables, projections) * odd).sum(axis=2)
                cells[rows] = (mixed ^ (mixed >> 29)) * tables + np.arange(tables)
            ends = np.arange(0, cells.size + 1, tables, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.ravel()))
            table = pa.Table.from_batches([batch])
            yield from table.append_column("cells", lists).to_batches()

    def bucketed(rows: DataFrame) -> DataFrame:
        types = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
        return rows.mapInArrow(hashed, f"{types}, cells array<long>").select(
            *rows.columns, F.explode("cells").alias("cell")
        )

    return bucketed(requests), bucketed(entries)
