"""The store that is its own index: equal to comparing with all entries, from the files of few cells."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators import lookup as L
from echocache.plans import read_through as RT
from echocache.sources import clustered
from echocache.sources.clustered import ClusteredStore
from echocache.streaming.snapshot import serve_batch
from tests.rows import at, collected, requests


def clustered_vectors(seed, n, dim=6, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 4
    return [[float(x) for x in centres[i % groups] + rng.normal(size=dim) * 0.3] for i in range(n)]


def rows_of(spark, vectors, first=0, collection=lambda i: f"c{i % 3}"):
    rows = [
        (collection(i), f"entry-{first + i}", first + i, f"prompt {first + i}", f"response {first + i}", v,
         float(np.linalg.norm(v)), at(first + i), at(first + i))
        for i, v in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, S.ENTRY)


def asked_of(spark, vectors, first=10_000):
    rows = [(f"c{i % 4}", f"r{i}", first + i, at(first + i), f"asked {i}", v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, S.REQUEST)


def found_by(df):
    return collected(df.withColumn("score", F.round("score", 9)), "collection", "request_id", "entry_seq", "score")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(clustered, "ENTRIES_PER_PIVOT", 12)


@pytest.mark.parametrize("metric, threshold", [("cosine", 0.97), ("l2sq", 0.9), ("l2", 0.8)])
def test_equals_comparing_with_all_entries(spark, tmp_path, small, metric, threshold):
    path = str(tmp_path / "store")
    store = ClusteredStore(spark, path, metric=metric)
    store.append(rows_of(spark, clustered_vectors(1, 240)), 0)
    store.append(rows_of(spark, clustered_vectors(1, 120)[60:], first=500), 1)  # copies and a late batch
    store.delete(spark.createDataFrame([("c0", 0), ("c1", 1), ("c2", 500 + 2)], "collection string, seq long"), 2)
    asked = asked_of(spark, clustered_vectors(1, 80) + clustered_vectors(7, 20))
    other = ClusteredStore(spark, path, metric=metric)  # as in a later session
    want = found_by(L.nearest(asked, other.entries(), threshold, metric, index="none"))
    assert found_by(other.nearest(asked, threshold)) == want and len(want) > 15
    assert found_by(other.nearest(asked, threshold, block_rows=5)) == want
    both = [x.where("found").select("request_id", "cached_response", "entry_id") for x in (
        other.lookup(asked, threshold), L.lookup(asked, other.entries(), threshold, metric, index="none"))]
    assert collected(both[0], "request_id", "cached_response", "entry_id") == collected(both[1], "request_id", "cached_response", "entry_id")
    assert other.lookup(asked, threshold).count() == 100
    early = asked.withColumn("seq", F.lit(520))
    assert found_by(other.nearest(early, threshold, earlier=True)) == found_by(
        L.nearest(early, other.entries(), threshold, metric, before=True, index="none"))
    # Inserts and deletes after the index was made are seen; a batch that runs again replaces itself.
    new = rows_of(spark, [r.vector for r in asked.limit(3).collect()], first=900, collection=lambda i: f"c{i % 4}")
    for _ in range(2):
        store.append(new, 3)
    got = {r.request_id: r.entry_seq for r in other.nearest(asked, threshold).collect()}
    assert other.entries().count() == 240 + 60 - 3 + 3 and {"r0", "r1", "r2"} <= set(got)
    for when in ("before", "after"):
        assert found_by(other.nearest(asked, threshold)) == found_by(
            L.nearest(asked, other.entries(), threshold, metric, index="none")), when
        assert {r.collection: r.base for r in other.issued().collect()} == {"c0": 900, "c1": 901, "c2": 902}
        if when == "before":
            other.fold(3)
    with pytest.raises(ValueError, match="folded"):
        other.entries(before=2).count()


def part_files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_files_of_other_cells_are_not_opened(spark, tmp_path, small):
    path = str(tmp_path / "store")
    ClusteredStore(spark, path).append(rows_of(spark, clustered_vectors(2, 600, groups=30)), 0)
    asked = asked_of(spark, clustered_vectors(2, 2, groups=30))
    store = ClusteredStore(spark, path)
    want = found_by(store.nearest(asked, 0.99))
    _, some = store.visits(asked, 0.99)
    files = part_files(f"{path}/entries")
    cell = {f: int(re.search(r"cell=(-?\d+)", f)[1]) for f in files}
    others = [f for f in files if cell[f] not in some]
    assert len(want) == 2 and 0 < len(some) < len(set(cell.values())) / 4 and others
    for f in others:  # what is opened would fail
        os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
        with open(f, "wb") as file:
            file.write(b"no parquet")
    again = ClusteredStore(spark, path)
    assert found_by(again.nearest(asked, 0.99)) == want
    assert again.lookup(asked, 0.99).where("found").count() == 2
    with pytest.raises(Exception):
        again.entries().count() + again.entries().agg(F.max("seq")).first()[0]


def test_files_do_not_grow_with_collections_and_ids_need_no_entries(spark, tmp_path):
    vectors = clustered_vectors(3, 2000)
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    ClusteredStore(spark, few).append(rows_of(spark, vectors, collection=lambda i: f"c{i % 2}"), 0)
    store = ClusteredStore(spark, many)
    store.append(rows_of(spark, vectors, collection=lambda i: f"c{i}"), 0)
    assert len(part_files(f"{many}/entries")) <= len(part_files(f"{few}/entries")) + 8 <= 8 * 8 + 16
    assert all("/sizes/" in f for f in store.issued().inputFiles())
    assert store.issued().count() == 2000
    one = ClusteredStore(spark, many, collection="c77")
    assert [r.seq for r in one.entries().collect()] == [77] and [r.base for r in one.issued().collect()] == [77]
    assert "collection" in re.search(r"PushedFilters: \[([^\]]*)\]", one.stored()._jdf.queryExecution().executedPlan().toString())[1]


def test_empty_stores_new_dimensions_and_uneven_ones(spark, tmp_path):
    store = ClusteredStore(spark, str(tmp_path / "store"))
    asked = requests(spark, [(5, [1.0, 0.0])])
    assert store.nearest(asked, 0.5).count() == 0 and store.lookup(asked, 0.5).first().found is False
    assert store.issued().count() == store.entries().count() == 0
    store.append(rows_of(spark, []), 0)  # an index without pivots
    assert store.nearest(asked, 0.5).count() == 0
    store.append(rows_of(spark, [[1.0, 0.1], [0.0, 1.0]], collection=lambda i: "c"), 1)
    store.append(rows_of(spark, [[1.0, 2.0, 3.0]], first=8, collection=lambda i: "wide"), 2)
    assert [(r.entry_seq, r.request_id) for r in store.nearest(asked, 0.5).collect()] == [(0, "r5")]
    wide = requests(spark, [(6, [1.0, 2.0, 3.1])], collection="wide")
    assert [r.entry_seq for r in store.nearest(wide, 0.9).collect()] == [8]
    with pytest.raises(Exception, match=S.VECTOR_DIMENSION):
        store.nearest(requests(spark, [(6, [1.0, 2.0, 3.1])]), 0.9).collect()
    with pytest.raises(ValueError, match="metric"):
        ClusteredStore(spark, store.path, metric="l2").nearest(asked, 0.5)


def test_a_stream_is_served_and_folded_between_batches(spark, tmp_path):
    store = ClusteredStore(spark, str(tmp_path / "store"))
    run = serve_batch(store, RT.fixed_answer("yes"), str(tmp_path / "results"), threshold=0.95)
    first = requests(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    later = requests(spark, [(3, [1.0, 0.01]), (4, [1.0, 1.0])])
    for _ in range(2):  # a batch that runs again
        run(first, 0)
    store.fold(0)
    for _ in range(2):
        run(later, 1)
    got = {r.request_id: (r.cache_hit, r.entry_id) for r in spark.read.parquet(str(tmp_path / "results")).collect()}
    assert got == {"r1": (False, None), "r2": (False, None), "r3": (True, "entry-1"), "r4": (False, None)}
    assert collected(store.entries(), "seq", "id", "last_accessed_at") == [
        (1, "entry-1", at(1003)), (2, "entry-2", at(1002)), (4, "entry-3", at(1004))]
    with pytest.raises(ValueError, match="after batch"):
        store.fold(0)
