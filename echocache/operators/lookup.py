"""Similarity lookup: requests against cached entries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators import blockjoin, cells
from echocache.scratch import materialize

# Pivots are kept on the driver and sent to every task: at most this many vectors.
MAX_PIVOTS = 1024
INDEXES = ("auto", "none", "pivots", "lsh")


def _wanted(rows: DataFrame, *names: str) -> DataFrame:
    """The columns the join needs, in the types it needs; texts stay behind."""
    types = {"collection": "string", "request_id": "string", "seq": "long", "cell": "int"}
    return rows.select(
        *[F.col(n).cast(types[n]).alias(n) for n in names],
        F.col("vector").cast(S.VECTOR).alias("vector"),
    )


def nearest(
    requests: DataFrame,
    entries: DataFrame,
    threshold: float | None = S.DEFAULT_THRESHOLD,
    metric: str = "cosine",
    k: int = 1,
    before: bool = False,
    index: str = "auto",
    block_rows: int = blockjoin.BLOCK_ROWS,
    n_pivots: int | None = None,
    tables: int = 20,
    projections: int = 8,
    bucket_length: float | None = None,
    closest: bool = True,
) -> DataFrame:
    """Closest entries of each request that pass the threshold; ties go to the earliest entry.

    Returns collection, request_id, entry_seq, score (and place for k > 1). Requests without a
    match have no row. ``before`` allows only entries with a smaller ``seq`` than the request.
    ``index``: ``none`` compares a whole collection block by block; ``pivots`` first drops cells
    that cannot match (same result); ``lsh`` is approximate; ``auto`` uses pivots when the
    entries fill more than a few blocks and a few rows tried out show that enough pairs go.
    ``block_rows`` are the rows of a block; unless the index is ``none`` or ``lsh``, larger tables have larger
    blocks, so that a row is sent to ``blockjoin.PARTS`` of them while their vectors fit a task.
    Without ``closest`` a request with a match gets any entry that passes, mostly in far fewer comparisons.
    ``bucket_length`` of LSH is by default three times the distance at the threshold.
    """
    S.check_metric(metric)
    if threshold is not None:
        S.check_threshold(threshold)
    if index not in INDEXES:
        raise ValueError(f"unknown index '{index}'. Supported: {', '.join(INDEXES)}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if not closest and (k > 1 or threshold is None):
        raise ValueError("any entry that passes is one, and needs a threshold")
    left = _wanted(requests, "collection", "request_id", "seq")
    right = _wanted(entries, "collection", "seq")
    if index == "pivots" and threshold is None:
        raise ValueError("index 'pivots' needs a threshold")
    request_rows, entry_rows, width = blockjoin.row_counts(left, right)
    blocks = math.ceil(entry_rows / block_rows)
    pivots = None
    if index == "pivots" and entry_rows or index == "auto" and threshold is not None and blocks > 4:
        wanted = min(n_pivots or max(8, min(blocks, MAX_PIVOTS)), MAX_PIVOTS)
        pivots = cells.Pivots(right, metric, wanted, entry_rows)
        if index == "auto" and not cells.worth_it(
            left, right, pivots, cells.radius(threshold, metric), (request_rows, entry_rows)
        ):
            pivots = None
    floor = blockjoin.closeness_floor(threshold, metric)
    if pivots is not None:
        left, right, rings = cells.pivot_index(left, right, metric, threshold, pivots, block_rows)
        left = materialize(left, "asked")
        found = blockjoin.best_in_parts(left, right, rings, metric, k, floor, before, block_rows)
    else:
        if index == "lsh" and entry_rows:
            length = bucket_length or 3 * cells.radius(S.DEFAULT_THRESHOLD if threshold is None else threshold, metric) or 1.0
            left, right = cells.lsh_cells(left, right, metric, length, tables, projections)
            fits_block = False
        else:
            if index != "none":
                block_rows = blockjoin.block_size(max(request_rows, entry_rows), width, block_rows)
            left, right = cells.one_cell(left), cells.one_cell(right)
            fits_block = max(request_rows, entry_rows) <= block_rows
        found = blockjoin.best_in_cells(
            left, right, metric, k, floor, before, block_rows, fits_block, repeats=index == "lsh", closest=closest,
        )
    return found.withColumn(
        "score", blockjoin.closeness_to_score(F.col("closeness"), metric)
    ).drop("closeness")


def lookup(
    requests: DataFrame,
    entries: DataFrame,
    threshold: float = S.DEFAULT_THRESHOLD,
    metric: str | None = None,
    store: str | None = None,
    **options,
) -> DataFrame:
    """One row per request: what the cache holds for it.

    Adds found, cached_prompt, cached_response, entry_id, entry_seq and score to the request
    columns. A miss has ``found = false``, empty texts and NULL id and score.
    ``store`` is ``cosine`` (a minimum similarity), ``distance`` (a maximum distance) or one of the
    baselines ``always_miss`` and ``always_hit``, which read no entries. Store and metric follow
    from one another where one is not given.
    """
    store, metric = S.resolve_metric(store, metric)
    if store == "always_miss":
        return _constant(requests, F.lit(False), F.lit(""), F.lit(""))
    if store == "always_hit":
        return _constant(
            requests, F.lit(True), F.lit(S.BASELINE_CACHED_PROMPT),
            F.lit(S.BASELINE_CACHED_RESPONSE),
        )
    return with_texts(requests, entries, nearest(requests, entries, threshold, metric, **options))


def with_texts(requests: DataFrame, entries: DataFrame, best: DataFrame) -> DataFrame:
    """The result of ``lookup`` from the best entry of each request that has one."""
    texts = entries.select(
        "collection",
        F.col("seq").alias("entry_seq"),
        F.col("id").alias("entry_id"),
        F.col("prompt").alias("cached_prompt"),
        F.col("response").alias("cached_response"),
    )
    served = best.join(texts, ["collection", "entry_seq"])
    return requests.join(served, ["collection", "request_id"], "left").select(
        *requests.columns,
        F.col("entry_seq").isNotNull().alias("found"),
        F.coalesce("cached_prompt", F.lit("")).alias("cached_prompt"),
        F.coalesce("cached_response", F.lit("")).alias("cached_response"),
        "entry_id",
        "entry_seq",
        "score",
    )


def _constant(requests: DataFrame, found: Column, prompt: Column, response: Column) -> DataFrame:
    return requests.select(
        *requests.columns,
        found.alias("found"),
        prompt.alias("cached_prompt"),
        response.alias("cached_response"),
        F.lit(None).cast("string").alias("entry_id"),
        F.lit(None).cast("long").alias("entry_seq"),
        F.lit(None).cast("double").alias("score"),
    )


def hits(looked_up: DataFrame) -> DataFrame:
    return looked_up.where("found")


def misses(looked_up: DataFrame) -> DataFrame:
    return looked_up.where(~F.col("found"))
