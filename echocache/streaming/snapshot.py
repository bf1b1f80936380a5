"""Micro-batch read-through of a request stream against a persistent store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from echocache.operators.entries import touch
from echocache.operators.evict import victims
from echocache.plans.read_through import read_through
from echocache.sources.store import CacheStore


def serve_batch(
    store: CacheStore,
    answer: Callable[[DataFrame], DataFrame],
    results_path: str,
    max_capacity: int | None = None,
    policy="lru",
    **options,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: serve, answer, append and record accesses.

    Batch N sees the store as it was before batch N and overwrites its own output, so a batch
    that runs twice has the effect of running once.
    """

    def run(requests: DataFrame, batch: int) -> None:
        before = store.entries(before=batch)
        outcome = read_through(
            requests, before, answer, issued=store.issued(before=batch), **options
        )
        outcome.results.write.mode("overwrite").parquet(f"{results_path}/batch={batch}")
        store.append(outcome.new_entries, batch)
        store.touch(outcome.touched, batch)
        if max_capacity is not None:
            current = touch(before, outcome.touched)
            store.delete(victims(current, outcome.new_entries, max_capacity, policy), batch)

    return run
