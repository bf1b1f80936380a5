"""Best-match join of request vectors with entry vectors, block against block.

Both sides arrive as rows ``(collection, cell, …, vector)``. Rows of the same cell are compared.
A cell of any size is cut into request stripes and entry stripes of at most about ``block_rows``
rows; every (request stripe, entry stripe) pair is one bounded Python task input, multiplied as
matrices. A block pair emits only the k best entries per request, never its pairs, and the
block results are merged by a map-side combined aggregation.

With cells from an index a request looks at many, so ``best_in_parts`` puts neighbouring cells into few parts
of bounded size: a request is sent once to each part that has one of its cells, whatever the number of these. Which cells
of the part it looks at is worked out there anew: lists of cells would grow with the rows times the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.scratch import materialize, spread

BLOCK_ROWS = 8192
#: Blocks that a side is cut into while these fit, and the most numbers that the vectors of a block have.
PARTS, VALUES = 8, 1 << 23
# Cosines are compared after rounding to this many decimals, distances to as many significant digits.
SCORE_DECIMALS = 12
_SLICE_CELLS = 4_000_000
# Widest vectors multiplied in single precision, the share of pairs from which they are all scored in full, and the rows that are
# tried first for a match.
MAX_SINGLE, DENSE, FIRST_TRIED = 4_096, 0.03, 256
# Rows of either side in a tile of products.
TILE = (512, 2_048)

# Numbers of the table of requests by cells that a task holds, and the share of pairs looked at from which all are compared.
LOOKED_AT, MOST = 1 << 24, 0.5

# Matches of a task that are held before only the best of each request are kept.
_HELD_MATCHES = 2_000_000

_MATCH = "collection string, request_id string, entry_seq long, closeness double"


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list<double> column as a 2-d array; unequal lengths are an error."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(S.VECTOR_DIMENSION)
    width = int(sizes[0]) if len(sizes) else 0
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def points(rows: np.ndarray, metric: str) -> np.ndarray:
    """Rows as compared: unit length for cosine, unchanged for the distances."""
    if not np.isfinite(rows).all():
        raise ValueError(S.VECTOR_NOT_FINITE)
    if metric != "cosine":
        return rows
    length = np.sqrt((rows * rows).sum(axis=1))
    if (length == 0).any():
        raise ValueError(S.VECTOR_ZERO)
    return rows / length[:, None]


def significant(values: np.ndarray) -> np.ndarray:
    """Rounded to ``SCORE_DECIMALS`` significant digits, so that the scale of the data is free."""
    values = np.asarray(values, float)
    size = np.abs(values)
    power = np.floor(np.log10(np.where(size > 0, size, 1.0)))
    scale = 10.0 ** np.clip(SCORE_DECIMALS - 1 - power, -290, 290)
    return np.where(np.isfinite(values), np.round(values * scale) / scale, values)


def closeness_floor(threshold: float | None, metric: str) -> float:
    """The threshold on the closeness scale, where larger is closer for every metric."""
    if threshold is None:
        return -np.inf
    floor = {"cosine": threshold, "l2sq": -threshold, "l2": -threshold * threshold}[metric]
    return floor if metric == "cosine" else float(significant(floor))


def closeness_to_score(closeness: Column, metric: str) -> Column:
    if metric == "cosine":
        return closeness
    return F.sqrt(-closeness) if metric == "l2" else -closeness


def closeness(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Cosine, or minus the squared distance, of every left row with every right row."""
    products = left @ right.T
    if metric == "cosine":
        return products
    left_sq = (left * left).sum(axis=1)[:, None]
    right_sq = (right * right).sum(axis=1)[None, :]
    return np.minimum(2.0 * products - left_sq - right_sq, 0.0)


def exact_closeness(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """``closeness`` without digit cancellation, for small inputs."""
    if metric == "cosine":
        return np.round(left @ right.T, SCORE_DECIMALS)
    gaps = [((right - row) ** 2).sum(axis=1) for row in left]
    return significant(-np.array(gaps).reshape(len(left), len(right)))


def _rescore(left, right, rows, cols, metric) -> np.ndarray:
    """Exact closeness of the few chosen pairs: single precision, and the distance formula above, lose digits."""
    if metric == "cosine" and len(rows) > DENSE * len(left) * len(right):
        return np.round((left @ right.T)[rows, cols], SCORE_DECIMALS)
    exact = np.empty(len(rows))
    step = max(1, _SLICE_CELLS // max(1, left.shape[1]))
    for lo in range(0, len(rows), step):
        mine, other = left[rows[lo : lo + step]], right[cols[lo : lo + step]]
        if metric == "cosine":
            exact[lo : lo + step] = np.einsum("ij,ij->i", mine, other)
        else:
            exact[lo : lo + step] = -((mine - other) ** 2).sum(axis=1)
    return np.round(exact, SCORE_DECIMALS) if metric == "cosine" else significant(exact)


class _Products:
    """Closeness of slices of two blocks in a precision that is fast, and how far it may be off.

    Points of length one are multiplied in single precision: their product of n numbers is within (n + 3) / 2^24 of the
    exact one. What may be the best by that is scored again in full.
    """

    def __init__(self, left, right, metric, left_seq, right_seq):
        self.left, self.right, self.metric = left, right, metric
        #: How many of the first right rows each left row may be compared with.
        self.ends = np.full(len(left), len(right)) if left_seq is None else np.searchsorted(right_seq, left_seq)
        single = metric == "cosine" and left.shape[1] <= MAX_SINGLE
        self.quick = (left.astype(np.float32), right.astype(np.float32)) if single else (left, right)
        self.error = 1e-12 + 1.02 * (left.shape[1] + 3) * 2.0**-24 if single else 1e-12
        if metric != "cosine" and len(left) and len(right):
            self.error *= 1.0 + (left * left).sum(axis=1).max() + (right * right).sum(axis=1).max()

    def near(self, mine: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Closeness of some left rows with the right rows from ``lo`` to ``hi``; minus infinity where there is none to be."""
        near = closeness(self.quick[0][mine], self.quick[1][lo:hi], self.metric)
        ends = self.ends[mine]
        if (first := max(lo, ends.min())) < hi:
            near[:, first - lo :][np.arange(first, hi)[None, :] >= ends[:, None]] = -np.inf
        return near

    def reaching(self, near: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of what is at the limit of its row or above, or may be."""
        limit = limit - 2 * self.error
        if near.dtype == np.float32:  # not compared as doubles, which would copy all
            limit = np.nextafter(limit.astype(np.float32), np.float32(-np.inf))
        return np.nonzero((near >= limit[:, None]) & (near > -np.inf))

    def exact(self, mine: np.ndarray, rows: np.ndarray, cols: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return _rescore(self.left[mine], self.right[lo:hi], rows, cols, self.metric)


def best_pairs(left, right, metric, k, floor, left_seq=None, right_seq=None):
    """(row, column, closeness) of the k closest right rows per left row, at or above ``floor``.

    Ties go to the first right row, so ``right`` must be in list order. With ``left_seq`` and
    ``right_seq`` only strictly earlier right rows are considered.
    """
    products = _Products(left, right, metric, left_seq, right_seq)
    if k == 1:
        return _best(products, floor)
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    order = np.argsort(products.ends, kind="stable")
    step = max(1, _SLICE_CELLS // max(1, len(right)))
    for lo in range(0, len(left), step):
        mine = order[lo : lo + step]
        hi = int(products.ends[mine[-1]])
        if not hi:
            continue
        near = products.near(mine, 0, hi)
        cut = most = near.max(axis=1)
        if hi > 1:
            cut = np.partition(near, hi - min(k, hi), axis=1)[:, hi - min(k, hi)]
        some = np.flatnonzero(most >= floor - 2 * products.error)
        near = near if len(some) == len(mine) else near[some]
        mine = mine[some]
        rows, cols = products.reaching(near, np.maximum(cut[some].astype(float), floor))
        exact = products.exact(mine, rows, cols, 0, hi)
        keep = exact >= floor
        rows, cols, exact = rows[keep], cols[keep], exact[keep]
        order_of = np.lexsort((cols, -exact, rows))
        rows, cols, exact = rows[order_of], cols[order_of], exact[order_of]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        found.append((mine[rows[keep]], cols[keep], exact[keep]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _best(products: _Products, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_pairs`` for one of each row: in tiles that stay near the processor, of which a row's best so far leaves few to score."""
    best, place = np.full(len(products.left), -np.inf), np.full(len(products.left), -1)
    order = np.argsort(products.ends, kind="stable")
    for at in range(0, len(order), TILE[0]):
        mine = order[at : at + TILE[0]]
        for lo in range(0, last := int(products.ends[mine[-1]]), TILE[1]):
            hi = min(lo + TILE[1], last)
            near = products.near(mine, lo, hi)
            most = near.max(axis=1).astype(float)
            some = np.flatnonzero(most >= np.maximum(best[mine], floor) - 2 * products.error)
            rows, cols = products.reaching(near[some], np.maximum(np.maximum(best[mine], most), floor)[some])
            exact = products.exact(mine[some], rows, cols, lo, hi)
            rows, cols, exact = (x[exact >= floor] for x in (mine[some[rows]], cols + lo, exact))
            first = np.lexsort((cols, -exact, rows))
            first = first[np.unique(rows[first], return_index=True)[1]]
            # Of equals the one of an earlier tile stays.
            first = first[exact[first] > best[rows[first]]]
            best[rows[first]], place[rows[first]] = exact[first], cols[first]
    found = np.flatnonzero(place >= 0)
    return found, place[found], best[found]


def some_pairs(left, right, metric, floor, left_seq=None, right_seq=None):
    """For each left row that has a right row at or above ``floor`` one such pair, as from ``best_pairs``; not the closest.

    A row that has one is not compared on, so this takes about as many pairs as it takes to find the first.
    """
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    products = _Products(left, right, metric, left_seq, right_seq)
    waiting, lo, width = np.argsort(products.ends, kind="stable"), 0, FIRST_TRIED
    while len(waiting) and lo < len(right):
        hi = min(lo + width, len(right))
        waiting = waiting[products.ends[waiting] > lo]
        left_over = []
        step = max(1, _SLICE_CELLS // (hi - lo))
        for at in range(0, len(waiting), step):
            mine = waiting[at : at + step]
            near = products.near(mine, lo, hi)
            some = np.flatnonzero(near.max(axis=1) >= floor - 2 * products.error)
            # The first by fast products is mostly one; where it is not, all that may be are looked at.
            cols = near[some].argmax(axis=1)
            exact = products.exact(mine, some, cols, lo, hi)
            sure = exact >= floor
            found.append((mine[some[sure]], cols[sure] + lo, exact[sure]))
            open_ = some[~sure]
            rows, more = products.reaching(near[open_], np.full(len(open_), floor))
            exact = products.exact(mine[open_], rows, more, lo, hi)
            rows, more, exact = (x[exact >= floor] for x in (rows, more, exact))
            rows, first = np.unique(rows, return_index=True)
            found.append((mine[open_[rows]], more[first] + lo, exact[first]))
            rest = np.ones(len(mine), bool)
            rest[some[sure]] = rest[open_[rows]] = False
            left_over.append(mine[rest])
        waiting = np.concatenate(left_over) if left_over else waiting[:0]
        lo, width = hi, min(4 * width, BLOCK_ROWS)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _block_kernel(metric: str, k: int, floor: float, before: bool, closest: bool = True):
    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table(
                {"collection": pa.array([], pa.string()), "request_id": pa.array([], pa.string()),
                 "entry_seq": pa.array([], pa.int64()), "closeness": pa.array([], pa.float64())}
            )
        right = right.sort_by("seq")
        requests, entries = matrix(left["vector"]), matrix(right["vector"])
        if requests.shape[1] != entries.shape[1]:
            raise ValueError(S.VECTOR_DIMENSION)
        entry_seq = right["seq"].to_numpy()
        request_seq = left["seq"].to_numpy() if before else None
        both = points(requests, metric), points(entries, metric), metric
        seqs = request_seq, entry_seq if before else None
        rows, cols, near = best_pairs(*both, k, floor, *seqs) if closest else some_pairs(*both, floor, *seqs)
        return pa.table(
            {"collection": pa.array([key[0].as_py()] * len(rows), pa.string()),
             "request_id": left["request_id"].combine_chunks().take(pa.array(rows)).cast(pa.string()),
             "entry_seq": pa.array(entry_seq[cols], pa.int64()),
             "closeness": pa.array(near, pa.float64())}
        )

    return run


def _stripe(rows_in_cell: str, block_rows: int) -> Column:
    return F.ceil(F.col(rows_in_cell) / block_rows).cast("int")


def row_counts(requests: DataFrame, entries: DataFrame) -> tuple[int, int, int]:
    """Rows of both sides, and numbers in the longest vector."""
    n, width = F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")
    both = requests.agg(n, width).withColumn("side", F.lit(0)).union(entries.agg(n, width).withColumn("side", F.lit(1)))
    counted = {row.side: row for row in both.collect()}
    return counted[0].n, counted[1].n, max(row.width or 0 for row in counted.values())


def block_size(rows: int, width: int, least: int) -> int:
    """Rows of a block: ``least``, or so many that ``PARTS`` blocks do, as far as their vectors may be that large."""
    return max(least, min(-(-rows // PARTS), VALUES // max(1, width)))


def best_in_cells(
    requests: DataFrame,
    entries: DataFrame,
    metric: str,
    k: int = 1,
    floor: float = -np.inf,
    before: bool = False,
    block_rows: int = BLOCK_ROWS,
    fits_block: bool = False,
    repeats: bool = False,
    closest: bool = True,
) -> DataFrame:
    """The k closest entries of each request over the cells it shares with them.

    ``requests``: collection, cell, request_id, seq, vector. ``entries``: collection, cell, seq,
    vector. Returns collection, request_id, entry_seq, closeness and, for k > 1, place.
    ``fits_block``: the caller counted both sides, and each fits one block. ``repeats``: a request
    and an entry may share several cells. Without ``closest`` (for k = 1) a request gets some entry of those that pass.
    """
    cell = ["collection", "cell"]
    sizes = None
    if not fits_block:
        # Written out once: both sides read it, and its real size decides how it is joined.
        sizes = materialize(
            requests.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_requests"))
            .join(entries.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_entries")), cell)
            .select(
                *cell,
                _stripe("n_requests", block_rows).alias("request_stripes"),
                _stripe("n_entries", block_rows).alias("entry_stripes"),
            ),
            "sizes",
        )

    def striped(rows: DataFrame, own: str, other: str) -> DataFrame:
        if sizes is None:
            return rows.withColumns({f"{own}_stripe": F.lit(0), f"{other}_stripe": F.lit(0)})
        placed = rows.join(sizes, cell)
        key = "request_id" if own == "request" else "seq"
        mine = F.pmod(F.xxhash64(key), F.col(f"{own}_stripes")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_stripes") - 1))
        return placed.withColumn(f"{own}_stripe", mine).withColumn(f"{other}_stripe", every).drop(
            "request_stripes", "entry_stripes"
        )

    block = [*cell, "request_stripe", "entry_stripe"]
    left = striped(requests.select(*cell, "request_id", "seq", "vector"), "request", "entry")
    right = striped(entries.select(*cell, "seq", "vector"), "entry", "request")
    local = (
        spread(left, block).groupBy(*block)
        .cogroup(spread(right, block).groupBy(*block))
        .applyInArrow(_block_kernel(metric, k, floor, before, closest), _MATCH)
    )
    return _merged(local, k, repeats)


def _merged(local: DataFrame, k: int, repeats: bool = False) -> DataFrame:
    request = ["collection", "request_id"]
    if k == 1:
        best = F.min(F.struct((-F.col("closeness")).alias("far"), F.col("entry_seq")))
        return local.groupBy(*request).agg(best.alias("b")).select(
            *request, F.col("b.entry_seq"), (-F.col("b.far")).alias("closeness")
        )
    order = Window.partitionBy(*request).orderBy(F.desc("closeness"), F.asc("entry_seq"))
    if repeats:
        local = local.dropDuplicates([*request, "entry_seq"])
    return (
        local.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
    )


class Layout:
    """Which part the entries of a cell are in: in order of their numbers, as many cells in a part as ``rows`` allow.

    A cell with more entries has parts of its own, into which these are dealt.
    """

    def __init__(self, counts: dict[int, int], rows: int):
        self.spans: dict[int, tuple[int, int]] = {}
        next_part, room = 0, 0
        for cell in sorted(counts):
            n = counts[cell]
            parts = -(-n // rows)
            if n > room:
                self.spans[cell] = next_part, parts
                next_part, room = next_part + parts, rows - n if parts == 1 else 0
            else:
                self.spans[cell] = next_part - 1, 1
                room -= n
        self.n_parts = next_part

    def places(self, ids: np.ndarray, whole: bool) -> Callable:
        """A function from the (row, cell) matrix of cells ``ids`` that requests look at to rows and parts; ``whole``: and all at cell -1."""
        cell = sorted(self.spans)
        known = np.searchsorted(ids, [c for c in cell if c >= 0])
        # The parts of neighbouring cells are in order, so those that have a part are neighbours too.
        firsts = {}
        for column, c in enumerate(cell):
            for part in range(self.spans[c][0], sum(self.spans[c])):
                firsts.setdefault(part, column)
        first, always = [firsts[part] for part in sorted(firsts)], -1 in self.spans

        def run(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = keep[:, known]
            if always:
                keep = np.column_stack([np.full(len(keep), whole), keep])
            if not first or not len(keep):
                return np.empty(0, int), np.empty(0, int)
            return np.nonzero(np.logical_or.reduceat(keep, first, axis=1))

        return run

    def entries(self, rows: DataFrame) -> DataFrame:
        """Add ``part`` to rows with ``cell`` and ``seq``."""
        spans = [(c, *span) for c, span in self.spans.items()]
        known = rows.sparkSession.createDataFrame(spans, "cell int, _first int, _parts int")
        part = F.col("_first") + F.pmod(F.xxhash64("seq"), F.col("_parts")).cast("int")
        return rows.join(F.broadcast(known), "cell").withColumn("part", part).drop("_first", "_parts")

    def requests(self, rows: DataFrame) -> DataFrame:
        """For requests that come with lists: a row for each ``part`` that has one of the ``cells`` of a request, with those of its cells that are there."""
        cell = np.array(sorted(self.spans), np.int64)
        first, parts = (np.array([self.spans[int(c)][i] for c in cell], np.int64) for i in (0, 1))

        def nest(lists: pa.Array) -> pa.Array:
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            wanted = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(cell, wanted), max(0, len(cell) - 1))
            known = cell[at] == wanted if len(cell) else np.zeros(len(wanted), bool)
            row, at = row[known], at[known]
            times = parts[at] if len(cell) else at
            each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, at = np.repeat(row, times), np.repeat(at, times)
            part = (first[at] if len(cell) else at) + each
            order = np.lexsort((at, part, row))
            row, at, part = row[order], at[order], part[order]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) if len(row) else np.empty(0, int)
            inner = pa.ListArray.from_arrays(
                pa.array(np.r_[new, len(row)], pa.int32()), pa.array(cell[at] if len(cell) else at, pa.int32())
            )
            visits = pa.StructArray.from_arrays([pa.array(part[new], pa.int32()), inner], ["part", "cells"])
            ends = np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(lists)))]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), visits)

        # Spark reads the hints as types, not as text.
        nest.__annotations__ = {"lists": pa.Array, "return": pa.Array}
        visits = F.arrow_udf(nest, "array<struct<part: int, cells: array<int>>>")("cells")
        others = [c for c in rows.columns if c != "cells"]
        rows = rows.select(*others, F.explode(visits).alias("_visit"))
        return rows.select(*others, "_visit.part", "_visit.cells")


def _best_rows(found: list[tuple], entry_seq: np.ndarray, k: int) -> tuple:
    rows, cols, near = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((entry_seq[cols], -near, rows))
    rows, cols, near = rows[order], cols[order], near[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep], near[keep]


def _compared_cells(left: pa.Table, right: pa.Table, index, metric: str, k: int, floor: float, before: bool) -> Iterator[tuple]:
    """Matches of the entries, which lie sorted by cell and number, with the requests that look at their cells.

    Requests are taken in slices, so that the table of requests by cells is bounded. Where most pairs are looked at, all are compared at
    once: a pair more changes nothing, and many small products take longer.
    """
    requests, entries = matrix(left["vector"]), matrix(right["vector"])
    if requests.shape[1] != entries.shape[1]:
        raise ValueError(S.VECTOR_DIMENSION)
    requests, entries = points(requests, metric), points(entries, metric)
    request_seq, entry_seq = left["seq"].to_numpy(), right["seq"].to_numpy()
    vectors, reach, cell = pa.concat_arrays(left["vector"].chunks), left["reach"].to_numpy(), right["cell"].to_numpy()
    known, starts = index.of(cell, right["gap"].to_numpy(), right["error"].to_numpy())
    sizes = np.diff(starts)
    in_order = np.argsort(entry_seq, kind="stable")
    step = max(1, LOOKED_AT // len(sizes))
    for lo in range(0, len(requests), step):
        some = slice(lo, lo + step)
        # A cell that is looked at by all has the first column, if there is one.
        keep = np.ones((len(requests[some]), len(sizes)), bool)
        for rows, kept in index.looked_at(vectors.slice(lo, step), reach[some], known):
            keep[rows, len(sizes) - kept.shape[1] :] = kept
        if (keep * sizes).sum() > MOST * len(keep) * len(entries):
            seqs = (request_seq[some], entry_seq[in_order]) if before else (None, None)
            i, j, near = best_pairs(requests[some], entries[in_order], metric, k, floor, *seqs)
            yield i + lo, in_order[j], near
            continue
        for column, (first, end) in enumerate(zip(starts, starts[1:])):
            mine = np.flatnonzero(keep[:, column]) + lo
            if len(mine):
                seqs = (request_seq[mine], entry_seq[first:end]) if before else (None, None)
                i, j, near = best_pairs(requests[mine], entries[first:end], metric, k, floor, *seqs)
                yield mine[i], j + first, near


def _part_kernel(index, metric: str, k: int, floor: float, before: bool):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found, held = [(np.empty(0, int), np.empty(0, int), np.empty(0))], 0
        if left.num_rows and right.num_rows:
            right = right.sort_by([("cell", "ascending"), ("seq", "ascending")])
            entry_seq = right["seq"].to_numpy()
            for one in _compared_cells(left, right, index, metric, k, floor, before):
                found.append(one)
                held += len(one[0])
                if held > max(_HELD_MATCHES, 2 * k * left.num_rows):
                    found = [_best_rows(found, entry_seq, k)]
                    held = len(found[0][0])
            found = [_best_rows(found, entry_seq, k)]
        rows, cols, near = found[0]
        ids = pa.concat_arrays(left["request_id"].chunks) if len(rows) else pa.array([], pa.string())
        return pa.table(
            {"collection": pa.array([key[0].as_py()] * len(rows), pa.string()),
             "request_id": ids.take(pa.array(rows)).cast(pa.string()),
             "entry_seq": pa.array(entry_seq[cols] if len(rows) else [], pa.int64()),
             "closeness": pa.array(near, pa.float64())}
        )

    return run


def best_in_parts(
    requests: DataFrame,
    entries: DataFrame,
    index,
    metric: str,
    k: int = 1,
    floor: float = -np.inf,
    before: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows of ``best_in_cells`` for requests with a ``reach`` and entries that lie in the cells of an ``index`` (see ``cells``).

    ``requests``: collection, request_id, seq, vector, reach. ``entries``: collection, seq, vector, cell, gap, error. Both sides are read more than once, so they are written tables. ``block_rows`` are the rows of a block
    while ``PARTS`` blocks of that size hold all; larger tables have larger blocks, up to ``VALUES`` numbers. The driver gets
    one count for each cell.
    """
    from echocache.operators import cells  # which needs this module

    n, width = F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")
    counts = entries.groupBy("collection", "cell").agg(n, width).groupBy("cell").agg(F.max("n").alias("n"), F.max("width").alias("width"))
    counts = {row.cell: (row.n, row.width) for row in counts.collect()}
    width = max((w for _, w in counts.values()), default=1) or 1
    # A part has so many rows of one collection at most.
    layout = Layout({c: m for c, (m, _) in counts.items()}, block_size(sum(m for m, _ in counts.values()), width, block_rows))
    size = F.greatest(F.lit(block_rows), F.least(F.ceil(F.col("n") / PARTS), F.lit(VALUES // width)))
    stripes = requests.groupBy("collection").agg(n).select("collection", F.ceil(F.col("n") / size).cast("int").alias("stripes"))
    stripes = materialize(stripes, "stripes")
    left = cells.with_numbers(requests, index, layout.places(index.cells.ids, index.cells.whole), "part").join(stripes, "collection")
    left = left.withColumn("stripe", F.pmod(F.xxhash64("request_id"), F.col("stripes")).cast("int")).drop("stripes")
    right = layout.entries(entries.select("collection", "seq", "vector", "cell", "gap", "error")).join(stripes, "collection")
    right = right.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).drop("stripes")
    block = ["collection", "part", "stripe"]
    local = (
        spread(left, block).groupBy(*block)
        .cogroup(spread(right, block).groupBy(*block))
        .applyInArrow(_part_kernel(index, metric, k, floor, before), _MATCH)
    )
    return _merged(local, k)
