import pytest

from echocache import schema as S
from echocache.operators import replay as R
from echocache.sources.store import CacheStore


@pytest.mark.parametrize("threshold", [-0.1, 1.1, float("nan")])
def test_rejects_invalid_threshold(threshold):
    with pytest.raises(ValueError, match="similarity_threshold"):
        S.check_threshold(threshold)


def test_accepts_threshold_bounds():
    assert S.check_threshold(0) == 0.0 and S.check_threshold(1) == 1.0


def test_rejects_invalid_capacity():
    with pytest.raises(ValueError, match="max_capacity"):
        S.check_capacity(0)


def test_rejects_blank_names():
    with pytest.raises(ValueError, match="persist_path must be a non-empty string"):
        CacheStore(None, "  ")
    with pytest.raises(ValueError, match="collection_name must be a non-empty string"):
        CacheStore(None, "/x", " ")


@pytest.mark.parametrize("policy,store,order", [
    ("default", "cosine", ("last_accessed_at", "seq")),
    ("default", "distance", ("last_accessed_at", "seq")),
    (" LRU ", "cosine", ("last_accessed_at", "seq")),
    ("fifo", "distance", ("seq",)),
    ("none", "distance", None),
    ("default", "always_hit", None),
    (["created_at"], "cosine", ("created_at", "seq")),
])
def test_policies(policy, store, order):
    assert S.resolve_policy(policy, store) == order


@pytest.mark.parametrize("policy,store", [
    ("random", "cosine"), ("lru", "always_miss"), ("lru", "other"), (["size"], "cosine"),
])
def test_unknown_policies(policy, store):
    with pytest.raises(ValueError):
        S.resolve_policy(policy, store)


def test_bounded_replay_needs_a_policy():
    with pytest.raises(ValueError, match="policy"):
        R.bounded_replay(None, policy="none")
