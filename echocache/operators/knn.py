"""The k closest entries of each request, without a threshold, from few cells.

Entries lie in rings around pivots (see ``cells``). In a first phase nothing but counts is looked at: an entry
of a cell is at most as far from a request as the pivot is, plus the cell's largest gap, so the cells with the least
such bounds that hold k entries together give an upper bound on the distance of the k-th closest. In a second phase a
request visits the cells that the triangle inequality allows to hold an entry within its own bound, and only
these are compared. On data in clusters that is a small part of all pairs; on data without clusters bounds are wide
and most cells are visited.

What a task gets is a stripe of requests and the counts of its collection's cells, of which there are at most
``MAX_PIVOTS`` times ``RINGS``; the driver holds the pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators import blockjoin, cells
from echocache.scratch import materialize, spread

MAX_PIVOTS = 1_024


def _reach(pivots: cells.Pivots, between: np.ndarray, stats: pa.Table, vectors: pa.Array, metric: str, k: int) -> np.ndarray:
    """For each request a bound on the distance of its k-th closest entry, from the counts of its collection's cells."""
    rows = stats.to_pydict()
    known = cells.Cells({c: cells.span(*x) for c, *x in zip(rows["cell"], *(rows[x] for x in "abe"))}, between, 0.0)
    counts = dict(zip(rows["cell"], rows["n"]))
    held = np.array([counts[c] for c in known.ids], float)
    reach = np.full(len(vectors), np.inf)
    for at, number, squared, error in pivots.distances(vectors):
        place = np.full(pivots.n, -1)
        place[number] = np.arange(len(number))
        column = place[known.pivot]
        some = np.flatnonzero(column >= 0)
        step = max(1, cells.NUMBERS // max(1, len(some)))
        for lo in range(0, len(at) if len(some) else 0, step):
            mine = slice(lo, lo + step)
            far = np.sqrt(np.maximum(squared[mine], 0) + error[mine])[:, column[some]] + known.most[some]
            order = np.argsort(far, axis=1)
            enough = np.cumsum(held[some][order], axis=1) >= k
            bound = np.take_along_axis(far, order, axis=1)[np.arange(len(far)), enough.argmax(axis=1)]
            reach[at[mine]] = np.where(enough.any(axis=1), bound, np.inf)
    # Closeness is compared after rounding, so entries a little farther can be as close.
    return np.sqrt(reach * reach + 1e-11) if metric == "cosine" else reach * (1 + 1e-9) + 1e-12


def _asked(asked: DataFrame, stats: DataFrame, pivots: cells.Pivots, metric: str, k: int, block_rows: int) -> DataFrame:
    """The requests with their ``reach``; that of a collection with fewer than k entries is infinite."""
    n = asked.groupBy("collection").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("stripes"))
    n = materialize(n, "stripes")
    left = asked.join(n, "collection").withColumn("stripe", F.pmod(F.xxhash64("request_id"), F.col("stripes")).cast("int"))
    right = stats.join(n, "collection").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    between = pivots.gaps()

    def run(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        rows = rows.select(cells.ASKED[:-1])
        reach = np.empty(0)
        if rows.num_rows:
            reach = _reach(pivots, between, counts, pa.concat_arrays(rows["vector"].chunks), metric, k)
        return rows.append_column("reach", pa.array(reach, pa.float64()))

    block = ["collection", "stripe"]
    return (
        spread(left.drop("stripes"), block).groupBy(*block)
        .cogroup(spread(right.drop("stripes"), block).groupBy(*block))
        .applyInArrow(run, cells.ASKED_DDL)
    )


def cells_and_visits(*given) -> tuple[DataFrame, DataFrame]:
    """The requests of ``indexed`` with a row for each cell that they look at, and the entries."""
    found, placed, index = indexed(*given)
    return cells.each_visit(found, index), placed


def indexed(
    requests: DataFrame, entries: DataFrame, k: int, metric: str, n_pivots: int | None, block_rows: int
) -> tuple[DataFrame, DataFrame, cells.Index]:
    """The requests with their ``reach``, the entries with their cells, and the index of these."""
    left = requests.select(
        F.col("collection").cast("string").alias("collection"), F.col("request_id").cast("string").alias("request_id"),
        F.col("seq").cast("long").alias("seq"), F.col("vector").cast(S.VECTOR).alias("vector"),
    )
    right = entries.select(
        F.col("collection").cast("string").alias("collection"), F.col("seq").cast("long").alias("seq"),
        F.col("vector").cast(S.VECTOR).alias("vector"),
    )
    size = F.size("vector")
    sizes = right.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"))
    sizes = materialize(sizes, "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    uneven = F.raise_error(F.lit(S.VECTOR_DIMENSION)).cast(S.VECTOR)
    even = lambda rows: rows.join(sizes, "collection").withColumn(
        "vector", F.when((size == F.col("low")) & (size == F.col("high")), F.col("vector")).otherwise(uneven)
    )
    wanted = min(n_pivots or max(8, total // block_rows), MAX_PIVOTS)
    pivots = cells.Pivots(right, metric, wanted if total else 0, total)
    placed = cells.place_in_rings(even(right).select("collection", "seq", "vector"), pivots)
    stats = materialize(
        placed.groupBy("collection", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("gap").alias("a"), F.max("gap").alias("b"), F.max("error").alias("e")
        ),
        "counts",
    )
    asked = even(left).select("collection", "request_id", "seq", "vector")
    found = materialize(_asked(asked, stats, pivots, metric, k, block_rows), "asked")
    spans = stats.groupBy("cell").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("e").alias("e"))
    return found, placed, cells.Index(pivots, cells.ranges(spans))


def nearest_k(
    requests: DataFrame, entries: DataFrame, k: int, metric: str = "cosine", n_pivots: int | None = None,
    block_rows: int = blockjoin.BLOCK_ROWS,
) -> DataFrame:
    """collection, request_id, entry_seq, score and place (1 to k) of the k closest entries of each request.

    The rows of ``lookup.nearest`` without a threshold; ties go to the earliest entry.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    S.check_metric(metric)
    found, held, index = indexed(requests, entries, k, metric, n_pivots, block_rows)
    best = blockjoin.best_in_parts(found, held, index, metric, k, block_rows=block_rows)
    score = blockjoin.closeness_to_score(F.col("closeness"), metric)
    return (best if k > 1 else best.withColumn("place", F.lit(1))).withColumn("score", score).select(
        "collection", "request_id", "entry_seq", "score", F.col("place").cast("int").alias("place")
    )
