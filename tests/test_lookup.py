import math

import numpy as np
import pytest

from echocache import schema as S
from echocache.operators import cells as C
from echocache.operators import lookup as L
from echocache.sources import tables as TB
from tests import models
from tests.rows import collected, entries, requests


def found(spark, cached, probe, threshold=0.8, metric="cosine"):
    out = L.lookup(requests(spark, [(1, probe)]), entries(spark, cached), threshold, metric).first()
    return out.found, out.cached_prompt, out.cached_response


@pytest.mark.parametrize("metric", S.METRICS)
def test_empty_cache_is_a_miss(spark, metric):
    assert found(spark, [], [1.0, 0.0], metric=metric) == (False, "", "")


@pytest.mark.parametrize("metric", S.METRICS)
def test_close_request_hits(spark, metric):
    got = found(spark, [(1, [1.0, 0.0])], [0.9, 0.1], metric=metric)
    assert got == (True, "prompt 1", "response 1")


@pytest.mark.parametrize("metric", S.METRICS)
def test_far_request_misses(spark, metric):
    assert found(spark, [(1, [1.0, 0.0])], [0.0, 1.0], metric=metric) == (False, "", "")


def test_nearest_of_two(spark):
    got = found(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [0.1, 0.9])
    assert got == (True, "prompt 2", "response 2")


def test_tie_goes_to_the_earliest_entry(spark):
    same = [(3, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0])]
    assert found(spark, same, [1.0, 0.0])[1] == "prompt 1"


@pytest.mark.parametrize("metric,probe", [("cosine", [0.8, 0.6]), ("l2sq", [0.2, 0.0]), ("l2", [0.2, 0.0])])
def test_threshold_is_inclusive(spark, metric, probe):
    threshold = {"cosine": 0.8, "l2sq": 0.64, "l2": 0.8}[metric]
    assert found(spark, [(1, [1.0, 0.0])], probe, threshold, metric)[0]


def test_identical_vector_hits_at_threshold_one(spark):
    vector = [0.1, 0.2, 0.3, 0.7]
    assert found(spark, [(1, vector)], vector, 1.0)[0]


def test_dimension_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match=S.VECTOR_DIMENSION):
        found(spark, [(1, [1.0, 0.0])], [1.0])


@pytest.mark.parametrize("bad,message", [([0.0, 0.0], S.VECTOR_ZERO), ([math.nan, 1.0], S.VECTOR_NOT_FINITE)])
def test_unusable_vectors_are_an_error(spark, bad, message):
    with pytest.raises(Exception, match=message):
        found(spark, [(1, [1.0, 0.0])], bad)


def test_collections_do_not_mix(spark):
    asked = requests(spark, [(1, [1.0, 0.0])], "a")
    held = entries(spark, [(1, [1.0, 0.0])], "b")
    assert not L.lookup(asked, held).first().found


def clustered(rng, n, dim, clusters, spread):
    centres = rng.normal(size=(clusters, dim))
    rows = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))
    return [[float(x) for x in row] for row in rows]


@pytest.mark.parametrize("metric,threshold", [("cosine", 0.8), ("cosine", 0.95), ("l2sq", 0.7), ("l2", 0.6)])
@pytest.mark.parametrize("options", [{"index": "none"}, {"index": "pivots", "n_pivots": 7}, {}])
def test_block_strategies_equal_brute_force(spark, metric, threshold, options):
    rng = np.random.default_rng(5)
    held = list(enumerate(clustered(rng, 260, 6, 9, 0.15)))
    # A third of the entries and of the requests are copies of one vector.
    held += [(300 + i, held[3][1]) for i in range(130)]
    asked = list(enumerate(clustered(rng, 90, 6, 9, 0.3)))
    asked += [(200 + i, held[3][1]) for i in range(45)]
    got = L.nearest(
        requests(spark, asked), entries(spark, held), threshold, metric, block_rows=50, **options
    )
    want = []
    for seq, vector in asked:
        match = models.best(vector, held, threshold, metric)
        if match is not None:
            want.append((f"r{seq}", match[0]))
    assert collected(got, "request_id", "entry_seq") == sorted(want)
    assert want


def test_pivots_keep_small_collections_whole(spark):
    rng = np.random.default_rng(7)
    vectors = clustered(rng, 140, 4, 5, 0.2)
    held = entries(spark, list(enumerate(vectors[:120])), "big").unionByName(
        entries(spark, list(enumerate(vectors[120:])), "small")
    )
    asked = requests(spark, list(enumerate(vectors[:60])), "big").unionByName(
        requests(spark, list(enumerate(vectors[100:140])), "small")
    )
    columns = ("collection", "request_id", "entry_seq")
    plain = L.nearest(asked, held, 0.9, index="none")
    pivots = L.nearest(asked, held, 0.9, index="pivots", n_pivots=6, block_rows=30)
    assert collected(pivots, *columns) == collected(plain, *columns)


@pytest.mark.parametrize("index", L.INDEXES)
def test_every_index_accepts_an_empty_cache(spark, index):
    assert L.nearest(requests(spark, [(1, [1.0, 0.0])]), entries(spark, []), index=index).isEmpty()


def test_pivots_allow_one_dimension_per_collection(spark):
    rng = np.random.default_rng(8)
    flat, deep = (list(enumerate(clustered(rng, 60, dim, 4, 0.2))) for dim in (3, 5))
    held = entries(spark, flat, "flat").unionByName(entries(spark, deep, "deep"))
    asked = requests(spark, flat, "flat").unionByName(requests(spark, deep, "deep"))
    got = L.nearest(asked, held, 0.9, index="pivots", n_pivots=8, block_rows=20)
    assert got.where("request_id = concat('r', entry_seq)").count() == 120
    mixed = entries(spark, flat + [(99, [1.0])], "flat")
    with pytest.raises(Exception, match=S.VECTOR_DIMENSION):
        L.nearest(asked, mixed, 0.9, index="pivots", n_pivots=8, block_rows=20).collect()
    with pytest.raises(Exception, match=S.VECTOR_DIMENSION):
        L.nearest(requests(spark, [(1, [1.0])], "flat"), held, 0.9, index="pivots", n_pivots=8, block_rows=20).collect()


def test_far_from_the_origin_distances_stay_exact(spark):
    base = [1e6, -1e6, 5e5]
    held = [(1, [base[0] + 0.3, *base[1:]]), (2, [base[0] + 0.2, *base[1:]]), (3, [base[0] + 2, *base[1:]])]
    got = L.nearest(requests(spark, [(1, base)]), entries(spark, held), 0.5, "l2").first()
    assert got.entry_seq == 2 and got.score == pytest.approx(0.2, abs=1e-9)


def test_small_distances_are_not_rounded_away(spark):
    held = [(1, [1e-7, 0.0]), (2, [3e-7, 0.0])]
    got = L.nearest(requests(spark, [(1, [3e-7, 0.0])]), entries(spark, held), 1e-6, "l2").first()
    assert (got.entry_seq, got.score) == (2, 0)
    asked = requests(spark, [(1, [8e-7, 0.0])])
    assert L.nearest(asked, entries(spark, held), 1e-7, "l2").isEmpty()


@pytest.mark.parametrize("scale", [1e-7, 1.0, 1e7])
@pytest.mark.parametrize("options", [{"index": "none"}, {"index": "pivots", "n_pivots": 32}, {}])
def test_every_exact_index_finds_all_at_any_offset(spark, scale, options):
    rng = np.random.default_rng(3)
    base = scale * rng.normal(size=8)
    held = base + rng.normal(size=(400, 8)) * min(scale, 1.0)
    step = rng.normal(size=(400, 8))
    asked = held + 0.04 * min(scale, 1.0) * step / np.linalg.norm(step, axis=1)[:, None]
    rows = lambda x: list(enumerate([[float(v) for v in r] for r in x]))
    got = L.nearest(
        requests(spark, rows(asked)), entries(spark, rows(held)), 0.05 * min(scale, 1.0), "l2", block_rows=50, **options
    )
    assert collected(got, "request_id", "entry_seq") == sorted((f"r{i}", i) for i in range(400))


def test_store_and_metric_go_together(spark):
    asked, held = requests(spark, [(1, [1.0, 0.0])]), entries(spark, [(1, [1.0, 0.1])])
    assert L.lookup(asked, held, 0.1, store="distance").first().found
    with pytest.raises(ValueError, match="unknown store"):
        L.lookup(asked, held, store="allways_hit")
    with pytest.raises(ValueError, match="does not compare by metric"):
        L.lookup(asked, held, store="distance", metric="cosine")


def test_top_k_in_order_with_ties(spark):
    held = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [1.0, 1.0])]
    got = L.nearest(requests(spark, [(9, [1.0, 0.1])]), entries(spark, held), None, k=3, block_rows=2)
    assert [r.entry_seq for r in got.orderBy("place").collect()] == [1, 3, 4]


def test_before_sees_only_earlier_entries(spark):
    held = entries(spark, [(1, [1.0, 0.0]), (5, [1.0, 0.01])])
    asked = requests(spark, [(1, [1.0, 0.01]), (5, [1.0, 0.01]), (6, [1.0, 0.01])])
    got = L.nearest(asked, held, 0.8, before=True)
    assert collected(got, "request_id", "entry_seq") == [("r5", 1), ("r6", 5)]


def compared(visits, placed):
    mine, other = (x.groupBy("collection", "cell").count() for x in (visits, placed))
    pairs = mine.join(other.withColumnRenamed("count", "others"), ["collection", "cell"])
    return pairs.selectExpr("sum(count * others)").first()[0] or 0


def test_pivots_prune_clustered_rows(spark):
    rng = np.random.default_rng(21)
    vectors = list(enumerate(clustered(rng, 1200, 8, 30, 0.1)))
    held, asked = entries(spark, vectors), requests(spark, vectors[::2])
    pivots = C.Pivots(held, "cosine", 40)
    assert C.worth_it(asked, held, pivots, C.radius(0.95, "cosine"))
    visits, placed = C.pivot_cells(asked, held, "cosine", 0.95, pivots, 10)
    assert compared(visits, placed) < 0.2 * 600 * 1200


def test_lsh_compares_a_quarter_and_finds_most(spark):
    folder = "/root/testdata/sf0.1"
    asked, held = TB.vector_requests(spark, folder, False), TB.vector_entries(spark, folder, False)
    columns = ("request_id", "entry_seq")
    visits, placed = C.lsh_cells(
        asked.select("collection", "request_id", "seq", "vector"), held.select("collection", "seq", "vector"),
        "cosine", 3 * C.radius(0.8, "cosine"), 20, 8,
    )
    assert compared(visits, placed) < 0.25 * asked.count() * held.count()
    exact = set(collected(L.nearest(asked, held, 0.8, index="none"), *columns))
    assert len(exact & set(collected(L.nearest(asked, held, 0.8, index="lsh"), *columns))) >= 0.95 * len(exact)


def test_lsh_recall_and_precision(spark):
    rng = np.random.default_rng(11)
    vectors = clustered(rng, 300, 16, 40, 0.25)
    held, asked = entries(spark, list(enumerate(vectors))), requests(spark, list(enumerate(vectors[::-1])))
    columns = ("request_id", "entry_seq")
    exact = set(collected(L.nearest(asked, held, 0.9, index="none"), *columns))
    found = set(collected(L.nearest(asked, held, 0.9, index="lsh", block_rows=64), *columns))
    assert len(found & exact) >= 0.95 * len(exact)
    scored = L.nearest(asked, held, 0.9, index="lsh")
    assert scored.where("score < 0.9").isEmpty()


def test_baselines_read_no_entries(spark):
    asked = requests(spark, [(1, [1.0])])
    hit = L.lookup(asked, None, store="always_hit").first()
    miss = L.lookup(asked, None, store="always_miss").first()
    assert (hit.found, hit.cached_prompt, hit.cached_response) == (True, "cached prompt", "cached answer")
    assert (miss.found, miss.cached_prompt, miss.cached_response) == (False, "", "")


def test_parameters_are_checked_before_any_job(spark):
    with pytest.raises(ValueError, match="similarity_threshold"):
        L.nearest(None, None, threshold=1.1)
    with pytest.raises(ValueError, match="unknown metric"):
        L.nearest(None, None, metric="dot")
    with pytest.raises(ValueError, match="unknown index"):
        L.nearest(None, None, index="tree")
