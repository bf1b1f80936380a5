"""Stateful read-through of a request stream, one bounded cache per collection."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from echocache import schema as S
from echocache.operators.replay import POLICIES, bounded_replay, cache_maker, to_score
from echocache.scratch import materialize

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "collection string, request_id string, seq long, cache_hit boolean, entry_seq long, score double"


class CacheProcessor(StatefulProcessor):
    """Keeps a collection's cache in a state list of at most ``max_capacity`` rows."""

    def __init__(self, new_cache: Callable, what: str, metric: str):
        self.new_cache, self.what, self.metric = new_cache, what, metric

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", f"entry_seq long, used long, what {self.what}")

    def handleInputRows(self, key, rows, timerValues):
        cache = self.new_cache()
        cache.load(
            {"entry_seq": h[0], "used": h[1], "what": h[2]} for h in self.held.get()
        )
        # Rows of one trigger arrive in any order.
        batch = pd.concat(list(rows)).sort_values("seq")
        answers = [
            cache.access(cache.one(what), int(seq)) for what, seq in zip(batch["what"], batch["seq"])
        ]
        held = cache.held()
        if held:
            self.held.put([(h["entry_seq"], h["used"], h["what"]) for h in held])
        yield pd.DataFrame(
            {
                "collection": key[0],
                "request_id": batch["request_id"].to_numpy(),
                "seq": batch["seq"].to_numpy(),
                "cache_hit": [a[0] for a in answers],
                "entry_seq": pd.array([a[1] for a in answers], dtype="Int64"),
                "score": pd.array([to_score(a[2], self.metric) for a in answers], dtype="Float64"),
            }
        )

    def close(self) -> None:
        pass


def stream_read_through(
    requests: DataFrame,
    max_capacity: int = S.DEFAULT_CAPACITY,
    threshold: float = S.DEFAULT_THRESHOLD,
    metric: str = "cosine",
    policy: str = "lru",
    key: str | None = None,
) -> DataFrame:
    """Streaming form of the bounded read-through; needs the RocksDB state store provider.

    With ``key`` requests match on that column exactly, otherwise on their vectors. Requests are
    taken in ``seq`` order inside a trigger and in arrival order across triggers. A task holds
    one collection's requests of one trigger: limit triggers with the source's rate options, or
    use ``serve_bounded_batch``, which cuts hot collections into chunks.
    """
    S.check_capacity(max_capacity)
    S.check_threshold(threshold)
    S.check_metric(metric)
    if policy not in POLICIES:
        raise ValueError(f"a bounded cache needs policy {' or '.join(POLICIES)}. Got: {policy}")
    what = F.col(key).cast("string") if key else F.col("vector").cast(S.VECTOR)
    rows = requests.select(
        F.col("collection").cast("string").alias("collection"),
        F.col("request_id").cast("string").alias("request_id"),
        F.col("seq").cast("long").alias("seq"),
        what.alias("what"),
    )
    new_cache = cache_maker(max_capacity, threshold, metric, policy, key)
    processor = CacheProcessor(new_cache, new_cache().what, metric)
    return rows.groupBy("collection").transformWithStateInPandas(
        processor, outputStructType=_OUT, outputMode="Append", timeMode="None"
    )


def serve_bounded_batch(path: str, **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for the bounded read-through without a per-task limit.

    Results go to ``path/results/batch=N`` and ending caches to ``path/caches/batch=N``. Batch N
    starts from the latest caches before N and overwrites its own output, so it can run twice.
    ``options`` are those of ``bounded_replay``.
    """

    def run(requests: DataFrame, batch: int) -> None:
        spark = requests.sparkSession
        starts = None
        if batch > 0:
            caches = spark.read.parquet(f"{path}/caches").where(F.col("batch") < batch)
            starts = caches.groupBy("collection").agg(F.max_by("held", "batch").alias("held"))
            starts = materialize(starts, "caches")
        results, ends = bounded_replay(requests, starts=starts, **options)
        results.write.mode("overwrite").parquet(f"{path}/results/batch={batch}")
        ends.write.mode("overwrite").parquet(f"{path}/caches/batch={batch}")

    return run
