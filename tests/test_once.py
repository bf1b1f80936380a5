"""Every request of a stream is served once, in event-time order."""

import pytest

from echocache import schema as S
from echocache.plans import read_through as RT
from echocache.sources.clustered import ClusteredStore
from echocache.sources.store import CacheStore
from echocache.streaming.once import LATE, Ledger, serve_once
from tests.rows import at, collected


def asked(spark, *rows):
    """Requests from (id, second, vector); arrival numbers as they come."""
    full = [("c", r, n, at(second), f"ask {r}", v) for n, (r, second, v) in enumerate(rows)]
    return spark.createDataFrame(full, S.REQUEST)


EAST, NORTH, BETWEEN = [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]


def results(spark, path, batch):
    return {r.request_id: (r.cache_hit, r.response) for r in spark.read.parquet(f"{path}/results/batch={batch}").collect()}


@pytest.mark.parametrize("kind", [CacheStore, ClusteredStore])
def test_repeated_late_and_rerun_batches(spark, tmp_path, kind):
    path, calls = str(tmp_path / "once"), []

    def answer(missed):
        found = sorted(r.request_id for r in missed.collect())
        calls.extend(found)
        return RT.fixed_answer(f"answer {len(calls)}")(missed)

    def serve(rows, batch):  # a new function each time, as after a restart
        serve_once(kind(spark, str(tmp_path / "store")), answer, path, delay_seconds=100, threshold=0.95, slot_seconds=50)(rows, batch)

    first = asked(spark, ("b", 20, EAST), ("a", 10, EAST), ("a", 10, EAST), ("n", 15, NORTH))
    serve(first, 0)
    # The earlier event is stored, the later one of the same batch hits it, and the repeated row is one request.
    assert results(spark, path, 0) == {"a": (False, "answer 2"), "b": (True, "answer 2"), "n": (False, "answer 2")}
    assert calls == ["a", "n"] and spark.read.parquet(f"{path}/results/batch=0").count() == 4
    second = asked(spark, ("a", 10, NORTH), ("b", 90, EAST), ("m", 200, BETWEEN), ("e", 95, EAST))
    for _ in range(2):
        serve(second, 1)
    got = results(spark, path, 1)
    # Known requests get their first answer, whatever they ask now.
    assert got == {"a": (False, "answer 2"), "b": (True, "answer 2"), "m": (False, got["m"][1]), "e": (True, "answer 2")}
    assert calls == ["a", "n", "m", "m"]  # the second m is the batch that ran again
    store = kind(spark, str(tmp_path / "store"))
    assert collected(store.entries(), "id", "prompt") == [("entry-1", "ask a"), ("entry-2", "ask n"), ("entry-3", "ask m")]
    third = asked(spark, ("late", 50, EAST), ("a", 10, EAST), ("e", 101, EAST), ("new", 210, NORTH))
    serve(third, 2)
    # The watermark is at 100: older requests are turned away, also those that were served once; e comes with a new
    # event time after the watermark has passed its first one, so it is served as a new request.
    assert results(spark, path, 2) == {"e": (True, "answer 2"), "new": (True, "answer 2")}
    assert collected(spark.read.parquet(f"{path}/late/batch=2"), "request_id", "reject_reason") == [("a", LATE), ("late", LATE)]
    assert store.entries().count() == 3 and len(calls) == 4


def test_slots_behind_the_watermark_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "once")
    store = CacheStore(spark, str(tmp_path / "store"))
    serve = serve_once(store, RT.fixed_answer(), path, delay_seconds=10, threshold=0.9, slot_seconds=10)
    for n in range(4):
        serve(asked(spark, (f"r{n}", 100 * n, [1.0, float(n)])), n)
    known = Ledger(spark, path, 10, 10).known(4)
    assert [r.request_id for r in known.collect()] == ["r3"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan[plan.index("PartitionFilters") : plan.index("PartitionFilters") + 400]


def test_an_unanswered_request_may_come_again(spark, tmp_path):
    path, store = str(tmp_path / "once"), CacheStore(spark, str(tmp_path / "store"))
    rows = asked(spark, ("a", 1, EAST))
    serve_once(store, RT.fixed_answer(" "), path, delay_seconds=10)(rows, 0)
    assert collected(spark.read.parquet(f"{path}/late/batch=0"), "request_id", "reject_reason") == [("a", S.RESPONSE_BLANK)]
    serve_once(store, RT.fixed_answer("now"), path, delay_seconds=10)(rows, 1)
    assert results(spark, path, 1) == {"a": (False, "now")}
    with pytest.raises(ValueError, match="delay_seconds"):
        Ledger(spark, path, -1)
