"""Closest entry of sparse vectors by an inverted index with prefix filtering, block against block.

Vectors of token counts or one-hot codes are mostly zeros, and clusters do not help there: all are about equally far
from any pivot. Here a row is the list of its dimensions that are not zero, scaled to length one. A collection is cut
into stripes of requests and of entries, and each pair of stripes is one bounded task input: lists are shuffled, pairs
of rows never are. A task indexes its entries by dimension, rare dimensions first, and adds up products in groups of
``GROUP`` dimensions, each only for the rows that have one of them. What a pair can still gain from the rest is at most
the product of the lengths of what both have left. As soon as this leaves few pairs, only these are scored to their
end; vectors that share most dimensions, as token counts in few buckets do, are plain products to the last group.

A dimension that stands in very many lists is no key of the shuffle, so it is spread like any other. Stripes are as few as their
rows (``HOT_ROWS``) and list items (``TERMS``) allow, but ``PARTS`` of a side if it has rows for that. A task hands back the best entry of
each request only; the driver gets nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators.blockjoin import SCORE_DECIMALS
from echocache.scratch import materialize, spread

#: Rows and list items of a stripe, rows that a smaller one is not cut for, and stripes of a side that has more.
HOT_ROWS, TERMS, FEW_ROWS, PARTS = 32_768, 1 << 21, 1_024, 8
#: Dimensions multiplied at a time, the share of pairs that are scored one by one, and numbers held for a slice of pairs.
GROUP, FEW, CELLS = 512, 0.02, 1 << 22
# More than the rounding error of a product of two vectors of length one.
_SLACK = 1e-9

_TERMS = "array<struct<dim: int, w: double>>"


def _terms(vector: Column) -> Column:
    """Dimensions that are not zero, with their share of the length."""
    numbered = F.transform(vector, lambda x, i: F.struct(i.alias("dim"), x.alias("w")))
    return F.filter(numbered, lambda t: t["w"] != 0)


def _scaled(rows: DataFrame, *keys: str) -> DataFrame:
    rows = rows.select(*keys, F.size("vector").alias("width"), _terms(F.col("vector").cast(S.VECTOR)).alias("terms"))
    length = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["w"] * t["w"]))
    rows = rows.withColumn("length", length)
    scaled = F.transform("terms", lambda t: F.struct(t["dim"].alias("dim"), (t["w"] / F.col("length")).alias("w")))
    zero = F.raise_error(F.lit(S.VECTOR_ZERO)).cast(_TERMS)
    return rows.withColumn("terms", F.when(F.col("length") > 0, scaled.cast(_TERMS)).otherwise(zero)).drop("length")


class _Lists:
    """The lists of a stripe as numbers: row, place of the dimension in the order of the block, and weight."""

    def __init__(self, column: pa.ChunkedArray, dims: np.ndarray | None = None, place: np.ndarray | None = None):
        lists = pa.concat_arrays(column.chunks)
        self.n = len(lists)
        sizes, terms = np.diff(lists.offsets.to_numpy()), lists.flatten()
        row = np.repeat(np.arange(self.n), sizes)
        dim, weight = terms.field("dim").to_numpy(), terms.field("w").to_numpy()
        if dims is None:
            dims, at, count = np.unique(dim, return_inverse=True, return_counts=True)
            place = np.empty(len(dims), int)
            place[np.argsort(count, kind="stable")] = np.arange(len(dims))
        else:
            at = np.minimum(np.searchsorted(dims, dim), max(0, len(dims) - 1))
            known = dims[at] == dim if len(dims) else np.zeros(len(dim), bool)
            row, at, weight = row[known], at[known], weight[known]
        self.dims, self.place = dims, place
        at = place[at]
        order = np.lexsort((row, at // GROUP))
        self.row, self.at, self.weight = row[order], at[order], weight[order]
        self.groups = -(-len(dims) // GROUP)
        self.starts = np.searchsorted(self.at // GROUP, np.arange(self.groups + 1))

    def part(self, group: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows from ``lo`` to ``hi`` with a dimension of the group, less ``lo``, and their weights."""
        start, end = self.starts[group : group + 2]
        start, end = start + np.searchsorted(self.row[start:end], (lo, hi))
        rows, own = np.unique(self.row[start:end], return_inverse=True)
        dense = np.zeros((len(rows), min(GROUP, len(self.dims) - group * GROUP)))
        dense[own, self.at[start:end] - group * GROUP] = self.weight[start:end]
        return rows - lo, dense

    def tails(self) -> np.ndarray:
        """For each row, the length of what is left from each group on, and at last nothing."""
        squares = np.zeros((self.groups + 1, self.n))
        for group in range(self.groups):
            mine = slice(*self.starts[group : group + 2])
            squares[group] = np.bincount(self.row[mine], self.weight[mine] ** 2, self.n)
        return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])


def _rest(asked: _Lists, held: _Lists, group: int, lo: int, hi: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """What single pairs gain from the dimensions of a group."""
    out = np.zeros(len(rows))
    (mine, left), (own, right) = asked.part(group, lo, hi), held.part(group, 0, held.n)
    at, to = np.full(hi - lo, -1), np.full(held.n, -1)
    at[mine], to[own] = np.arange(len(mine)), np.arange(len(own))
    both = np.flatnonzero((at[rows] >= 0) & (to[cols] >= 0))
    for i in range(0, len(both), step := max(1, CELLS // GROUP)):
        some = both[i : i + step]
        out[some] = (left[at[rows[some]]] * right[to[cols[some]]]).sum(axis=1)
    return out


def _reaching(asked: _Lists, held: _Lists, threshold: float, early: Callable) -> Iterator[tuple]:
    """Rows, columns and cosines of the pairs that reach the threshold but for rounding, in slices of rows.

    ``early`` takes a range of rows and tells which columns each of them may not be compared with, or None.
    """
    left, right = asked.tails(), held.tails()
    step = max(1, CELLS // max(1, held.n))
    kept = {}  # of few groups, so that not every slice makes them anew
    for lo in range(0, asked.n, step):
        hi = min(lo + step, asked.n)
        total = np.zeros((hi - lo, held.n))
        if (late := early(lo, hi)) is not None:
            total[late] = -np.inf
        pairs = None
        for group in range(held.groups):
            if pairs is not None:
                pairs = (*pairs[:2], pairs[2] + _rest(asked, held, group, lo, hi, *pairs[:2]))
                continue
            own, more = kept[group] if group in kept else held.part(group, 0, held.n)
            if group not in kept and sum(x.size for _, x in kept.values()) + more.size <= 4 * CELLS:
                kept[group] = own, more
            mine, part = asked.part(group, lo, hi)
            if len(mine) == hi - lo and len(own) == held.n:
                total += part @ more.T
            elif len(mine) and len(own):
                total[np.ix_(mine, own)] += part @ more.T
            if group + 1 < held.groups:
                most = total + left[group + 1, lo:hi, None] * right[group + 1][None, :]
                able = most >= threshold - _SLACK
                if np.count_nonzero(able) <= FEW * able.size:
                    rows, cols = np.nonzero(able)
                    pairs = rows, cols, total[rows, cols]
        if pairs is None:
            rows, cols = np.nonzero(total >= threshold - _SLACK)
            pairs = rows, cols, total[rows, cols]
        enough = pairs[2] >= threshold - _SLACK
        yield pairs[0][enough] + lo, pairs[1][enough], pairs[2][enough]


def _kernel(threshold: float, before: bool, best: bool):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, cols, near = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            right = right.sort_by("seq")
            held = _Lists(right["terms"])
            asked = _Lists(left["terms"], held.dims, held.place)
            asked_seq, held_seq = left["seq"].to_numpy(), right["seq"].to_numpy()
            early = lambda lo, hi: held_seq[None, :] >= asked_seq[lo:hi, None] if before else None
            for i, j, cosine in _reaching(asked, held, threshold, early):
                if best:
                    cosine = np.round(cosine, SCORE_DECIMALS)
                    some = np.flatnonzero(cosine >= threshold)
                    some = some[np.lexsort((j[some], -cosine[some], i[some]))]
                    some = some[np.unique(i[some], return_index=True)[1]]
                    i, j, cosine = i[some], j[some], cosine[some]
                rows.append(i)
                cols.append(j)
                near.append(cosine)
        at, to = np.concatenate(rows), np.concatenate(cols)
        return pa.table({
            "collection": pa.array([key[0].as_py()] * len(at), pa.string()),
            "request_id": pa.concat_arrays(left["request_id"].chunks).take(pa.array(at)).cast(pa.string())
            if len(at) else pa.array([], pa.string()),
            "entry_seq": pa.array(right["seq"].to_numpy()[to] if len(at) else [], pa.int64()),
            "score": pa.array(np.concatenate(near), pa.float64()),
        })

    return run


def _compared(requests: DataFrame, entries: DataFrame, threshold: float, before: bool, best: bool) -> DataFrame:
    """collection, request_id, entry_seq and score from all pairs of stripes."""

    def counted(rows: DataFrame, own: str) -> DataFrame:
        n, items = F.count(F.lit(1)), F.sum(F.size("terms"))
        least = F.least(F.ceil(n / FEW_ROWS), F.lit(PARTS))
        stripes = F.greatest(F.ceil(n / HOT_ROWS), F.ceil(items / TERMS), least).cast("int")
        return rows.groupBy("collection").agg(stripes.alias(own))

    sizes = materialize(counted(requests, "request_stripes").join(counted(entries, "entry_stripes"), "collection"), "sizes")

    def striped(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(f"{own}_stripes")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_stripes") - 1))
        placed = rows.join(sizes, "collection").withColumn(f"{own}_stripe", mine).withColumn(f"{other}_stripe", every)
        return placed.drop("request_stripes", "entry_stripes")

    block = ["collection", "request_stripe", "entry_stripe"]
    left = striped(requests.select("collection", "request_id", "seq", "terms"), "request_id", "request", "entry")
    right = striped(entries.select("collection", "seq", "terms"), "seq", "entry", "request")
    return (
        spread(left, block).groupBy(*block)
        .cogroup(spread(right, block).groupBy(*block))
        .applyInArrow(_kernel(threshold, before, best), "collection string, request_id string, entry_seq long, score double")
    )


def candidates(requests: DataFrame, entries: DataFrame, threshold: float, before: bool = False) -> DataFrame:
    """collection, request_id, entry_seq of the pairs that reach the cosine ``threshold`` but for rounding, each once.

    Both sides are as from ``scaled_rows``.
    """
    return _compared(requests, entries, threshold, before, False).drop("score")


def scaled_rows(requests: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as lists of their dimensions; requests of another dimension than their collection are an error."""
    held = materialize(_scaled(entries.select("collection", F.col("seq").cast("long").alias("seq"), "vector"), "collection", "seq"), "held")
    widths = held.groupBy("collection").agg(F.min("width").alias("low"), F.max("width").alias("high"))
    asked = _scaled(
        requests.select("collection", F.col("request_id").cast("string").alias("request_id"), F.col("seq").cast("long").alias("seq"), "vector"),
        "collection", "request_id", "seq",
    )
    same = (F.col("width") == F.col("low")) & (F.col("width") == F.col("high"))
    uneven = F.raise_error(F.lit(S.VECTOR_DIMENSION)).cast(_TERMS)
    asked = asked.join(widths, "collection").withColumn("terms", F.when(same, F.col("terms")).otherwise(uneven))
    return materialize(asked.drop("low", "high"), "asked"), held


def nearest_sparse(
    requests: DataFrame, entries: DataFrame, threshold: float = S.DEFAULT_THRESHOLD, before: bool = False
) -> DataFrame:
    """The rows of ``lookup.nearest`` by cosine, for vectors that are mostly zeros.

    collection, request_id, entry_seq and score of the closest entry of each request that reaches the
    threshold, which is above 0; ties go to the earliest entry. Requests without one have no row.
    """
    if S.check_threshold(threshold) <= 0:
        raise ValueError("an inverted index needs a threshold above 0")
    asked, held = scaled_rows(requests, entries)
    found = _compared(asked, held, threshold, before, True)
    best = F.min(F.struct((-F.col("score")).alias("far"), "entry_seq")).alias("b")
    return found.groupBy("collection", "request_id").agg(best).select(
        "collection", "request_id", F.col("b.entry_seq"), (-F.col("b.far")).alias("score")
    )
