"""Ordered read-through with a capacity, in parallel and exact.

What a bounded cache answers depends on everything before, so a collection is a sequence. It is
cut into chunks of ``chunk_rows`` requests, and all chunks are replayed at once, each from a
guessed starting cache (first guess: empty). The ending cache of a chunk is the right start for
the next one; chunks whose start turns out different run again. When no start changes any more,
every chunk ran from its predecessor's end, which is the sequential result. A bounded cache
forgets, so starts settle after a few rounds; in the worst case one more chunk settles per
round. A task holds one chunk and at most ``max_capacity`` entries.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators import blockjoin
from echocache.operators.rank import rank_within
from echocache.scratch import materialize, spread

CHUNK_ROWS = 50_000
POLICIES = ("lru", "fifo")

# How a cache travels between chunks; ``what`` is the vector or the exact key of an entry.
_HELD = "array<struct<entry_seq: bigint, used: bigint, what: {what}>>"
_OUT = (
    "collection string, chunk long, request_id string, seq long, cache_hit boolean, "
    "entry_seq long, score double, digest string, held {held}"
)
_RESULT = ["collection", "request_id", "seq", "cache_hit", "entry_seq", "score"]


class KeyCache:
    """Bounded cache of exact keys; the front of the dictionary leaves first."""

    what = "string"

    def __init__(self, capacity: int, policy: str):
        self.capacity, self.lru = capacity, policy == "lru"
        self.entries = OrderedDict()

    def load(self, held):
        for entry in sorted(held, key=lambda e: (e["used"] if self.lru else 0, e["entry_seq"])):
            self.entries[entry["what"]] = (entry["entry_seq"], entry["used"])

    def held(self):
        return [
            {"entry_seq": s, "used": u, "what": key} for key, (s, u) in self.entries.items()
        ]

    def one(self, what):
        return what

    def prepare(self, column: pa.ChunkedArray):
        return column.to_pylist()

    def access(self, key, seq):
        known = self.entries.get(key)
        if known is not None:
            if self.lru:
                self.entries[key] = (known[0], seq)
                self.entries.move_to_end(key)
            return True, known[0], 1.0
        if len(self.entries) >= self.capacity:
            self.entries.popitem(last=False)
        self.entries[key] = (seq, seq)
        return False, None, None


class VectorCache:
    """Bounded cache of vectors; a hit is the closest entry at or above the floor."""

    what = "array<double>"

    def __init__(self, capacity: int, policy: str, metric: str, floor: float):
        self.capacity, self.lru = capacity, policy == "lru"
        self.metric, self.floor = metric, floor
        self.rows, self.n = None, 0
        self.seq, self.used = np.empty(0, np.int64), np.empty(0, np.int64)

    def load(self, held):
        for entry in held:
            self._put(self.n, self.one(entry["what"]), entry["entry_seq"], entry["used"])

    def held(self):
        return [
            {"entry_seq": int(self.seq[i]), "used": int(self.used[i]), "what": self.rows[i].tolist()}
            for i in range(self.n)
        ]

    def one(self, what):
        return blockjoin.points(np.array([what], dtype=float), self.metric)[0]

    def prepare(self, column: pa.ChunkedArray):
        return blockjoin.points(blockjoin.matrix(column), self.metric)

    def access(self, row, seq):
        if self.n:
            if self.rows.shape[1] != len(row):
                raise ValueError(S.VECTOR_DIMENSION)
            near = blockjoin.exact_closeness(row[None, :], self.rows[: self.n], self.metric)[0]
            best = near.max()
            if best >= self.floor:
                ties = np.flatnonzero(near == best)
                slot = ties[self.seq[ties].argmin()]
                if self.lru:
                    self.used[slot] = seq
                return True, int(self.seq[slot]), float(best)
        slot = self.n if self.n < self.capacity else self._victim()
        self._put(slot, row, seq, seq)
        return False, None, None

    def _victim(self):
        if not self.lru:
            return int(self.seq[: self.n].argmin())
        oldest = np.flatnonzero(self.used[: self.n] == self.used[: self.n].min())
        return int(oldest[self.seq[oldest].argmin()])

    def _put(self, slot, row, seq, used):
        if self.rows is None:
            self.rows = np.empty((0, len(row)))
        if slot >= len(self.rows):
            size = max(16, 2 * len(self.rows))
            self.rows = np.resize(self.rows, (size, self.rows.shape[1]))
            self.seq, self.used = np.resize(self.seq, size), np.resize(self.used, size)
        self.rows[slot], self.seq[slot], self.used[slot] = row, seq, used
        self.n = max(self.n, slot + 1)


def to_score(closeness: float | None, metric: str) -> float | None:
    if closeness is None or metric == "cosine":
        return closeness
    return (-closeness) ** 0.5 if metric == "l2" else -closeness


def _digest(held) -> str:
    pairs = sorted((entry["entry_seq"], entry["used"]) for entry in held)
    return hashlib.md5(np.array(pairs, dtype=np.int64).tobytes()).hexdigest()


def _chunk_kernel(new_cache, metric: str, held_type: pa.DataType):
    def run(key, left, right):
        cache = new_cache()
        if right.num_rows and right["held"][0].is_valid:
            cache.load(right["held"][0].as_py())
        left = left.sort_by("seq")
        n = left.num_rows
        seqs = left["seq"].to_pylist()
        whats = cache.prepare(left["what"]) if n else []
        answers = [cache.access(what, seq) for what, seq in zip(whats, seqs)]
        held = cache.held()
        scores = [to_score(a[2], metric) for a in answers]
        # One extra row carries the ending cache.
        return pa.table(
            {"collection": pa.array([key[0].as_py()] * (n + 1), pa.string()),
             "chunk": pa.array([key[1].as_py()] * (n + 1), pa.int64()),
             "request_id": pa.array([*left["request_id"].to_pylist(), None], pa.string()),
             "seq": pa.array([*seqs, None], pa.int64()),
             "cache_hit": pa.array([*(a[0] for a in answers), None], pa.bool_()),
             "entry_seq": pa.array([*(a[1] for a in answers), None], pa.int64()),
             "score": pa.array([*scores, None], pa.float64()),
             "digest": pa.array([*[None] * n, _digest(held)], pa.string()),
             "held": pa.array([*[None] * n, held], held_type)}
        )

    return run


def _replay(
    rows: DataFrame, starts: DataFrame | None, new_cache, metric, chunk_rows
) -> tuple[DataFrame, DataFrame]:
    """(results, ending caches). ``rows``: collection, request_id, seq, what; caches: collection, held."""
    what = new_cache().what
    held_type = pa.list_(
        pa.struct([("entry_seq", pa.int64()), ("used", pa.int64()),
                   ("what", pa.list_(pa.float64()) if what != "string" else pa.string())])
    )
    held_ddl = _HELD.format(what=what)
    chunk = ["collection", "chunk"]
    spark = rows.sparkSession
    if starts is None:
        starts = spark.createDataFrame([], f"collection string, held {held_ddl}")
    starts = starts.select("collection", F.lit(0).cast("long").alias("chunk"), "held")

    def run(requests: DataFrame, begins: DataFrame) -> DataFrame:
        return (
            spread(requests, chunk).groupBy(*chunk)
            .cogroup(spread(begins.select(*chunk, "held"), chunk).groupBy(*chunk))
            .applyInArrow(_chunk_kernel(new_cache, metric, held_type), _OUT.format(held=held_ddl))
        )

    results = F.col("request_id").isNotNull()
    largest = rows.groupBy("collection").count().agg(F.max("count")).first()[0] or 0
    if largest <= chunk_rows:
        placed = rows.withColumn("chunk", F.lit(0).cast("long"))
        # A collection that only has a starting cache is in the groups too and keeps it.
        ran = run(placed, starts)
        return ran.where(results).select(*_RESULT), ran.where(~results).select("collection", "held")

    number = F.floor((F.col("rank") - 1) / chunk_rows).cast("long")
    placed = materialize(
        rank_within(rows, ["collection"], ["seq"]).withColumn("chunk", number).drop("rank"), "chunks"
    )
    last = placed.groupBy("collection").agg(F.max("chunk").alias("last"))
    dirty = materialize(
        placed.select(*chunk).distinct().join(starts, chunk, "left")
        .withColumn("digest", F.lit("")),
        "starts",
    )
    used = dirty.select(*chunk, "digest")
    rounds = []
    while not dirty.isEmpty():
        ran = materialize(
            run(placed.join(dirty.select(*chunk), chunk, "left_semi"), dirty), "replayed"
        )
        rounds.append(ran.withColumn("round", F.lit(len(rounds))))
        ends = (
            ran.where(~results).select("collection", (F.col("chunk") + 1).alias("chunk"), "digest", "held")
            .join(last, "collection").where("chunk <= last").drop("last")
        )
        before = used.withColumnRenamed("digest", "was")
        dirty = materialize(
            ends.join(before, chunk).where("digest <> was").drop("was"), "starts"
        )
        used = materialize(
            used.join(dirty.select(*chunk), chunk, "left_anti").unionByName(
                dirty.select(*chunk, "digest")
            ),
            "used",
        )
    every = reduce(DataFrame.unionByName, rounds)
    final = every.groupBy(*chunk).agg(F.max("round").alias("round"))
    settled = every.join(final, [*chunk, "round"])
    ends = settled.where(~results).join(last.withColumnRenamed("last", "chunk"), chunk)
    ended = ends.select("collection", "held").unionByName(
        starts.select("collection", "held").join(last, "collection", "left_anti")
    )
    return settled.where(results).select(*_RESULT), ended


def starting_caches(entries: DataFrame, max_capacity: int) -> DataFrame:
    """One row per collection with its entries in use order; a cache over capacity is an error."""
    over = entries.groupBy("collection").count().where(F.col("count") > max_capacity)
    if not over.isEmpty():
        raise ValueError("a collection holds more entries than max_capacity: shrink it first")
    used = F.struct("last_accessed_at", "seq", F.col("vector").alias("what"))
    ordered = entries.groupBy("collection").agg(F.array_sort(F.collect_list(used)).alias("list"))
    # Entries were used before every request: negative numbers in last-access order.
    held = F.transform(
        "list",
        lambda e, i: F.struct(
            e["seq"].alias("entry_seq"),
            (i - F.size("list")).cast("long").alias("used"),
            e["what"].alias("what"),
        ),
    )
    return ordered.select("collection", held.alias("held"))


def bounded_replay(
    requests: DataFrame,
    max_capacity: int = S.DEFAULT_CAPACITY,
    threshold: float = S.DEFAULT_THRESHOLD,
    metric: str = "cosine",
    policy: str = "lru",
    key: str | None = None,
    starts: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(results, ending caches) of requests in ``seq`` order, from the caches in ``starts``.

    With ``key`` requests match on that column exactly, otherwise on their vectors.
    """
    S.check_capacity(max_capacity)
    if policy not in POLICIES:
        raise ValueError(f"a bounded replay needs policy {' or '.join(POLICIES)}. Got: {policy}")
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be at least 1")
    S.check_threshold(threshold)
    S.check_metric(metric)
    what = F.col(key).cast("string") if key else F.col("vector").cast(S.VECTOR)
    rows = requests.select(
        F.col("collection").cast("string").alias("collection"),
        F.col("request_id").cast("string").alias("request_id"),
        F.col("seq").cast("long").alias("seq"),
        what.alias("what"),
    )
    return _replay(
        rows, starts, cache_maker(max_capacity, threshold, metric, policy, key), metric, chunk_rows
    )


def cache_maker(max_capacity: int, threshold: float, metric: str, policy: str, key: str | None):
    """A function that makes an empty cache, shipped to the tasks."""
    if key:
        return lambda: KeyCache(max_capacity, policy)
    floor = blockjoin.closeness_floor(threshold, metric)
    return lambda: VectorCache(max_capacity, policy, metric, floor)


def read_through_bounded(
    requests: DataFrame,
    max_capacity: int = S.DEFAULT_CAPACITY,
    threshold: float = S.DEFAULT_THRESHOLD,
    metric: str = "cosine",
    policy: str = "lru",
    entries: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """collection, request_id, seq, cache_hit, entry_seq, score for requests in ``seq`` order.

    The cache of a collection never holds more than ``max_capacity`` entries; a hit counts as a
    use, a miss is stored and may push out one entry.
    """
    starts = starting_caches(entries, max_capacity) if entries is not None else None
    return bounded_replay(
        requests, max_capacity, threshold, metric, policy, starts=starts, chunk_rows=chunk_rows
    )[0]


def read_through_exact(
    requests: DataFrame,
    key: str,
    max_capacity: int = S.DEFAULT_CAPACITY,
    policy: str = "lru",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The same for exact repeats: requests with equal ``key`` match, others do not."""
    return bounded_replay(requests, max_capacity, policy=policy, key=key, chunk_rows=chunk_rows)[0]
