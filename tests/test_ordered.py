import numpy as np
import pytest

from echocache.operators import ordered as O
from echocache.operators import replay as R
from tests import models
from tests.rows import collected, entries, requests


def vectors(seed, n, dim=3, copies=0.3):
    """Random vectors, a share of them copies of one."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dim))
    rows[rng.random(n) < copies] = rows[0]
    return [[float(x) for x in row] for row in rows]


def outcome(df):
    return sorted((r.seq, r.cache_hit, r.entry_seq) for r in df.collect())


@pytest.mark.parametrize("metric,threshold,block_rows", [
    ("cosine", 0.9, 1000), ("cosine", 0.9, 20), ("l2sq", 0.5, 20), ("l2", 0.8, 1000),
])
def test_ordered_equals_one_by_one(spark, metric, threshold, block_rows):
    asked = [(7 * i, v) for i, v in enumerate(vectors(1, 120))]
    got = O.read_through_ordered(requests(spark, asked), None, threshold, metric, block_rows)
    assert outcome(got) == models.replay(asked, threshold, metric)


@pytest.mark.parametrize("block_rows", [1000, 16])
def test_ordered_with_initial_entries(spark, block_rows):
    held = [(i, v) for i, v in enumerate(vectors(2, 12))]
    asked = [(100 + i, v) for i, v in enumerate(vectors(3, 60))]
    got = O.read_through_ordered(requests(spark, asked), entries(spark, held), 0.9, "cosine", block_rows)
    assert outcome(got) == models.replay(asked, 0.9, "cosine", entries=[(s, v, 0) for s, v in held])


def test_long_chain_of_similar_requests(spark):
    angle = np.deg2rad(20) * np.arange(60) / 1.5
    asked = [(i, [float(np.cos(a) + 3), float(np.sin(a)), float(i) / 5]) for i, a in enumerate(angle[:40])]
    got = O.read_through_ordered(requests(spark, asked), None, 0.3, "l2", 10)
    assert outcome(got) == models.replay(asked, 0.3, "l2")


def rounds(monkeypatch):
    """Counts the rounds of ``stored_requests``."""
    seen, plain = [], O._greedy_kernel
    monkeypatch.setattr(O, "_greedy_kernel", lambda *x: seen.append(1) or plain(*x))
    return seen


def test_sparse_numbers_take_no_more_rounds(spark, monkeypatch):
    angle = np.deg2rad(13) * np.arange(40)
    chain = [[float(np.cos(a)), float(np.sin(a)), float(i) / 9] for i, a in enumerate(angle)]
    counted = []
    for step in (1, 1000):
        asked = [(step * i, v) for i, v in enumerate(chain)]
        seen = rounds(monkeypatch)
        got = O.read_through_ordered(requests(spark, asked), None, 0.3, "l2", 10)
        assert outcome(got) == models.replay(asked, 0.3, "l2")
        counted.append(len(seen))
        monkeypatch.undo()
    assert counted[0] == counted[1] > 1


def test_collections_are_independent(spark):
    asked = [(i, v) for i, v in enumerate(vectors(4, 30))]
    both = requests(spark, asked, "a").unionByName(requests(spark, asked[::2], "b"))
    got = O.read_through_ordered(both, None, 0.9, "cosine", 10)
    assert outcome(got.where("collection = 'a'")) == models.replay(asked, 0.9, "cosine")
    assert outcome(got.where("collection = 'b'")) == models.replay(asked[::2], 0.9, "cosine")


@pytest.mark.parametrize("policy,metric,threshold,chunk_rows", [
    ("lru", "cosine", 0.9, 10_000), ("lru", "cosine", 0.9, 40), ("fifo", "cosine", 0.9, 40), ("lru", "l2", 0.8, 40),
])
def test_bounded_equals_one_by_one(spark, policy, metric, threshold, chunk_rows):
    asked = [(3 * i, v) for i, v in enumerate(vectors(5, 150))]
    got = R.read_through_bounded(requests(spark, asked), 6, threshold, metric, policy, chunk_rows=chunk_rows)
    assert outcome(got) == models.replay(asked, threshold, metric, 6, policy)


@pytest.mark.parametrize("chunk_rows", [10_000, 27])
def test_bounded_with_initial_entries(spark, chunk_rows):
    held = [(i, v, (i * 5) % 7) for i, v in enumerate(vectors(6, 7, copies=0))]
    asked = [(100 + i, v) for i, v in enumerate(vectors(7, 80))]
    got = R.read_through_bounded(
        requests(spark, asked), 7, 0.9, entries=entries(spark, held), chunk_rows=chunk_rows
    )
    assert outcome(got) == models.replay(asked, 0.9, "cosine", 7, entries=held)


def test_initial_entries_over_capacity_are_an_error(spark):
    held = entries(spark, [(i, [1.0, float(i)]) for i in range(4)])
    with pytest.raises(ValueError, match="max_capacity"):
        R.read_through_bounded(requests(spark, [(9, [1.0, 1.0])]), 3, entries=held)


def test_large_capacity_equals_no_eviction(spark):
    asked = requests(spark, [(i, v) for i, v in enumerate(vectors(8, 90))])
    plain = O.read_through_ordered(asked, None, 0.85)
    assert outcome(R.read_through_bounded(asked, 90, 0.85)) == outcome(plain)


@pytest.mark.parametrize("policy", ["lru", "fifo"])
@pytest.mark.parametrize("chunk_rows", [10_000, 60])
def test_exact_keys_equal_one_by_one(spark, policy, chunk_rows):
    rng = np.random.default_rng(9)
    keys = np.where(rng.random(200) < 0.33, 0, rng.integers(0, 12, 200))
    hot = [("hot", f"r{i}", i, str(k)) for i, k in enumerate(keys)]
    cold = [("cold", f"q{i}", i, str(k)) for i, k in enumerate(keys[:20])]
    ddl = "collection string, request_id string, seq long, key string"
    got = R.read_through_exact(spark.createDataFrame(hot + cold, ddl), "key", 5, policy, chunk_rows)
    one_hot = lambda k: [1.0 if i == k else 0.0 for i in range(12)]
    for name, n in (("hot", 200), ("cold", 20)):
        want = models.replay([(i, one_hot(k)) for i, k in enumerate(keys[:n])], 0.9, "cosine", 5, policy)
        assert outcome(got.where(f"collection = '{name}'")) == want


def test_lru_sequence(spark):
    first, second, third = [1.0, 0.0], [0.0, 1.0], [0.7, 0.7]
    asked = [(1, first), (2, second), (3, first), (4, third), (5, first), (7, third), (8, second)]
    got = dict((s, h) for s, h, _ in outcome(R.read_through_bounded(requests(spark, asked), 2, 0.8)))
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True, 7: True, 8: False}


def test_fifo_sequence(spark):
    first, second, third = [1.0, 0.0], [0.0, 1.0], [0.7, 0.7]
    asked = [(1, first), (2, second), (3, first), (4, third), (5, second), (6, first)]
    got = dict((s, h) for s, h, _ in outcome(R.read_through_bounded(requests(spark, asked), 2, 0.8, policy="fifo")))
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_unbounded_distance_store(spark):
    asked = [(1, [0.0, 0.1]), (2, [10.0, 10.0]), (3, [0.0, 0.1]), (4, [10.0, 10.0])]
    got = O.read_through_ordered(requests(spark, asked), None, 0.1, "l2sq")
    assert [h for _, h, _ in outcome(got)] == [False, False, True, True]


def test_bounded_distance_store(spark):
    asked = [(1, [0.0, 0.1]), (2, [10.0, 10.0]), (3, [0.0, 0.1]), (4, [0.3, 0.4]), (5, [0.0, 0.1]), (6, [0.3, 0.4]), (7, [10.0, 10.0])]
    got = R.read_through_bounded(requests(spark, asked), 2, 0.1, "l2sq")
    assert [h for _, h, _ in outcome(got)] == [False, False, True, False, True, True, False]
    assert collected(got.where("cache_hit"), "seq", "score") == [(3, 0.0), (5, 0.0), (6, 0.0)]
