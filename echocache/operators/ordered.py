"""Ordered read-through without eviction, as parallel rounds.

Request i is a hit exactly when an earlier *stored* request (or an entry that was there before) is
close enough; otherwise it is stored. Deciding this one by one is the greedy, lexicographically
first maximal independent set of the "close enough" graph. Here it runs in rounds
(Blelloch, Fineman & Shun, SPAA 2012): a request with an earlier stored neighbour is a hit, one
without an earlier undecided neighbour is stored. No edge is ever written out: each round asks the
block join only for some earlier match of a request, which compares no further when it has one.

In every round the earliest rows of each collection, at most ``block_rows`` of them by rank, are also
settled one by one in a task of that size. This finishes small collections at once and bounds the
number of rounds on long chains of similar requests, however sparse their numbers are.

With a generator, who is stored depends on the answers, and only a miss may be asked. ``answered_in_order``
therefore asks in rounds: only requests without an undecided earlier neighbour, which are misses whatever
else happens. Usable answers decide the neighbours as hits; a blank one takes its request out, and those that
waited for it are looked at again in the next round. Rounds are as many as answers that depend on one another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators import blockjoin
from echocache.operators.lookup import nearest
from echocache.operators.rank import rank_within
from echocache.scratch import materialize

_SLICE = 256
_KEY = ["collection", "seq"]


def _greedy_kernel(metric: str, floor: float):
    def run(key, table):
        table = table.sort_by("seq")
        rows = blockjoin.points(blockjoin.matrix(table["vector"]), metric)
        stored = np.zeros(len(rows), dtype=bool)
        for lo in range(0, len(rows), _SLICE):
            part = rows[lo : lo + _SLICE]
            kept = rows[:lo][stored[:lo]]
            hit = np.zeros(len(part), dtype=bool)
            if len(kept):
                hit[blockjoin.some_pairs(part, kept, metric, floor)[0]] = True
            near = blockjoin.exact_closeness(part, part, metric) >= floor
            fresh = np.zeros(len(part), dtype=bool)
            for i in np.flatnonzero(~hit):
                fresh[i] = not near[i, :i][fresh[:i]].any()
            stored[lo : lo + _SLICE] = fresh
        return pa.table(
            {"collection": pa.array([key[0].as_py()] * len(rows), pa.string()),
             "seq": table["seq"], "stored": pa.array(stored)}
        )

    return run


def _as_requests(rows: DataFrame) -> DataFrame:
    return rows.withColumn("request_id", F.col("seq").cast("string"))


def _matched(rows: DataFrame, entries: DataFrame, before: bool, **options) -> DataFrame:
    """Keys of the rows that have a close enough entry."""
    found = nearest(_as_requests(rows), entries, before=before, closest=False, **options)
    return found.select("collection", F.col("request_id").cast("long").alias("seq"))


def stored_requests(
    requests: DataFrame,
    entries: DataFrame | None = None,
    threshold: float = S.DEFAULT_THRESHOLD,
    metric: str = "cosine",
    block_rows: int = blockjoin.BLOCK_ROWS,
) -> DataFrame:
    """(collection, seq, vector) of the requests that ordered read-through stores.

    ``seq`` is the arrival number, unique in its collection. Of equal vectors only the first can
    be stored, so copies leave before the first round.
    """
    S.check_threshold(threshold)
    options = {"threshold": threshold, "metric": S.check_metric(metric), "block_rows": block_rows}
    floor = blockjoin.closeness_floor(threshold, metric)
    undecided = requests.groupBy(
        F.col("collection").cast("string").alias("collection"),
        F.col("vector").cast(S.VECTOR).alias("vector"),
    ).agg(F.min(F.col("seq").cast("long")).alias("seq"))
    undecided = materialize(undecided, "undecided")
    if entries is not None:
        served = _matched(undecided, entries, before=False, **options)
        undecided = materialize(undecided.join(served, _KEY, "left_anti"), "undecided")
    undecided = materialize(rank_within(undecided, ["collection"], ["seq"], "place"), "undecided")
    stored = []
    while not undecided.isEmpty():
        spans = undecided.groupBy("collection").agg(
            F.min("place").alias("first"), F.count(F.lit(1)).alias("n")
        )
        early = (F.col("n") <= block_rows) | (F.col("place") < F.col("first") + block_rows)
        spanned = undecided.join(spans, "collection").withColumn("early", early)
        settled = materialize(
            spanned.where("early").select(*_KEY, "vector")
            .groupBy("collection")
            .applyInArrow(_greedy_kernel(metric, floor), "collection string, seq long, stored boolean"),
            "settled",
        )
        kept = materialize(undecided.join(settled.where("stored"), _KEY, "left_semi"), "stored")
        stored.append(kept)
        rest = spanned.where(~F.col("early")).select(*_KEY, "vector", "place")
        if rest.isEmpty():
            break
        rest = materialize(
            rest.join(_matched(rest, kept, before=True, **options), _KEY, "left_anti"), "undecided"
        )
        waiting = _matched(rest, rest, before=True, **options)
        free = materialize(rest.join(waiting, _KEY, "left_anti"), "stored")
        stored.append(free)
        rest = rest.join(free, _KEY, "left_anti")
        undecided = materialize(
            rest.join(_matched(rest, free, before=True, **options), _KEY, "left_anti"), "undecided"
        )
    if not stored:
        return undecided.select(*_KEY, "vector")
    return reduce(DataFrame.unionByName, [x.select(*_KEY, "vector") for x in stored])


def answered_in_order(
    requests: DataFrame,
    entries: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    usable: Column,
    threshold: float = S.DEFAULT_THRESHOLD,
    metric: str = "cosine",
    block_rows: int = blockjoin.BLOCK_ROWS,
) -> DataFrame:
    """The requests that were asked for an answer, with what ``answer`` adds to them.

    ``answer`` is called with misses only, and with each of them once. ``usable`` tells whether an
    answered request is stored; an answer depends on the prompt, so a prompt that got none is not
    asked for again, and its later requests store nothing. Equal requests are asked for once: the first
    is stored and serves the others, or they have no answer either.
    """
    options = {"threshold": threshold, "metric": metric, "block_rows": block_rows}
    same = F.struct(F.xxhash64("prompt"), "prompt", F.col("vector").cast(S.VECTOR))
    firsts = requests.groupBy("collection", same.alias("same")).agg(F.min("seq").alias("seq"))
    undecided = requests.join(firsts.select(*_KEY), _KEY, "left_semi")
    undecided = materialize(undecided.withColumn("vector", F.col("vector").cast(S.VECTOR)), "undecided")
    served = _matched(undecided, entries, before=False, **options)
    undecided = materialize(undecided.join(served, _KEY, "left_anti"), "undecided")
    rounds = []
    while not undecided.isEmpty() or not rounds:
        waiting = _matched(undecided, undecided, before=True, **options)
        free = materialize(undecided.join(waiting, _KEY, "left_anti"), "free")
        asked = materialize(answer(free), "answered")
        rounds.append(asked)
        stored, failed = (asked.where(usable == told) for told in (True, False))
        rest = undecided.join(free.select(*_KEY), _KEY, "left_anti")
        if not failed.isEmpty():
            rest = rest.join(failed.select("prompt").distinct(), "prompt", "left_anti").select(*undecided.columns)
        rest = materialize(rest, "undecided")
        undecided = materialize(rest.join(_matched(rest, stored, before=True, **options), _KEY, "left_anti"), "undecided")
    return reduce(DataFrame.unionByName, rounds)


def read_through_ordered(
    requests: DataFrame,
    entries: DataFrame | None = None,
    threshold: float = S.DEFAULT_THRESHOLD,
    metric: str = "cosine",
    block_rows: int = blockjoin.BLOCK_ROWS,
) -> DataFrame:
    """collection, request_id, seq, cache_hit, entry_seq, score for requests taken in ``seq`` order.

    A hit is served by the best entry present at that moment: an initial entry or an earlier
    stored request. ``entry_seq`` of a miss is NULL. Initial entries have smaller ``seq`` values
    than the requests, as they arrived before.
    """
    stored = stored_requests(requests, entries, threshold, metric, block_rows)
    present = stored
    if entries is not None:
        held = entries.select("collection", "seq", F.col("vector").cast(S.VECTOR).alias("vector"))
        present = stored.unionByName(held)
    keys = stored.select(*_KEY).withColumn("is_stored", F.lit(True))
    marked = requests.join(keys, _KEY, "left")
    served = nearest(
        marked.where("is_stored IS NULL"), present, threshold, metric, before=True,
        block_rows=block_rows,
    )
    return (
        marked.drop("vector")
        .join(served, ["collection", "request_id"], "left")
        .select(
            "collection", "request_id", "seq",
            F.col("is_stored").isNull().alias("cache_hit"), "entry_seq", "score",
        )
    )
