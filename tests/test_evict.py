import random

import pytest

from echocache.operators import evict as EV
from tests import models
from tests.rows import at, collected, entries


def test_lru_victim_is_the_least_recently_used(spark):
    held = entries(spark, [(1, [1.0], 3), (2, [1.0], 1)])
    assert collected(EV.victim(held), "id") == [("entry-2",)]


def test_lru_victim_ties_go_to_the_first(spark):
    held = entries(spark, [(4, [1.0], 9), (2, [1.0], 9), (3, [1.0], 9)])
    assert collected(EV.victim(held), "id") == [("entry-2",)]


def test_fifo_victim_is_the_first(spark):
    held = entries(spark, [(1, [1.0], 3), (2, [1.0], 1)])
    assert collected(EV.victim(held, "fifo"), "id") == [("entry-1",)]


def test_no_entries_no_victim(spark):
    assert EV.victim(entries(spark, [])).isEmpty()
    with pytest.raises(ValueError):
        EV.victim(entries(spark, []), "none")


def test_without_policy_nothing_leaves(spark):
    held, new = entries(spark, [(1, [1.0])]), entries(spark, [(2, [1.0])])
    assert EV.bounded_append(held, new, 1, "none").count() == 2


def test_over_capacity_keeps_its_size_unless_shrunk(spark):
    held = entries(spark, [(i, [1.0], i) for i in range(6)])
    new = entries(spark, [(10, [1.0], 100)])
    assert collected(EV.bounded_append(held, new, 2), "seq") == [(i,) for i in (1, 2, 3, 4, 5, 10)]
    assert collected(EV.bounded_append(held, new, 2, shrink=True), "seq") == [(5,), (10,)]


def metadata(spark, rows):
    full = [(name, f"entry-{s}", s, at(0), at(u)) for name, s, u in rows]
    return spark.createDataFrame(
        full, "collection string, id string, seq long, created_at timestamp, last_accessed_at timestamp"
    )


def test_a_late_insert_stays_until_the_next_one(spark):
    held, new = metadata(spark, [("c", 1, 10)]), metadata(spark, [("c", 2, 5)])
    assert collected(EV.bounded_append(held, new, 1), "seq") == [(2,)]


@pytest.mark.parametrize("policy", ["lru", "fifo"])
def test_equals_storing_one_by_one(spark, policy):
    rng = random.Random(3)
    old, new, want = [], [], []
    for case in range(40):
        name = f"c{case}"
        held = [(i, rng.randrange(0, 6)) for i in range(rng.randrange(0, 9))]
        late = rng.random() < 0.5  # inserts whose access time is older than that of kept entries
        coming = [(100 + i, rng.randrange(0, 8) if late else 1000 + i) for i in range(rng.randrange(0, 9))]
        old += [(name, s, u) for s, u in held]
        new += [(name, s, u) for s, u in coming]
        want += [(name, s) for s in models.bounded_store(held, coming, 5, policy)]
    got = EV.bounded_append(metadata(spark, old), metadata(spark, new), 5, policy)
    assert collected(got, "collection", "seq") == sorted(want)
