"""The k closest entries from few cells: the rows of comparing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators import blockjoin, knn
from echocache.operators import lookup as L
from tests.rows import entries, requests


def clustered(seed, n, groups=25, dim=5, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(groups, dim)) * 3
    return [[float(x) for x in centres[i % groups] + rng.normal(size=dim) * spread] for i in range(n)]


def found_by(df):
    return sorted((r.collection, r.request_id, r.place, r.entry_seq, round(r.score, 9)) for r in df.collect())


def tables(spark):
    held = clustered(1, 260) + clustered(1, 30)  # thirty come twice: ties by number
    held = entries(spark, list(enumerate(held))).unionByName(entries(spark, list(enumerate(clustered(2, 7))), "few")).unionByName(
        entries(spark, [(i, [float(x) for x in np.random.default_rng(i).normal(size=3)]) for i in range(40)], "plain"))
    asked = requests(spark, list(enumerate(clustered(3, 50) + clustered(1, 10)))).unionByName(
        requests(spark, list(enumerate(clustered(4, 9))), "few")).unionByName(
        requests(spark, [(i, [1.0, float(i), -1.0]) for i in range(12)], "plain")).unionByName(
        requests(spark, [(1, [1.0])], "none"))
    return asked, held


@pytest.mark.parametrize("metric", ["cosine", "l2sq", "l2"])
@pytest.mark.parametrize("k", [1, 3, 10])
def test_equals_comparing_with_all(spark, metric, k):
    asked, held = tables(spark)
    want = L.nearest(asked, held, None, metric, k=k, index="none")
    want = want if k > 1 else want.withColumn("place", F.lit(1))
    assert found_by(knn.nearest_k(asked, held, k, metric, n_pivots=20, block_rows=64)) == found_by(want)


def test_fewer_pairs_on_clustered_data(spark):
    asked, held = (x.where("collection = 'c'") for x in tables(spark))
    found, placed = knn.cells_and_visits(asked, held, 3, "l2sq", 40, 64)
    sizes = placed.groupBy("collection", "cell").count()
    pairs = found.join(sizes, ["collection", "cell"]).agg(F.sum("count")).first()[0]
    assert pairs < 0.25 * asked.count() * held.count()


def test_more_wanted_than_there_is_and_empty_sides(spark):
    held = entries(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    asked = requests(spark, [(9, [1.0, 0.2])])
    assert [(r.place, r.entry_seq) for r in knn.nearest_k(asked, held, 10).orderBy("place").collect()] == [(1, 1), (2, 2)]
    assert knn.nearest_k(requests(spark, []), held, 3).count() == 0
    assert knn.nearest_k(asked, entries(spark, []), 3).count() == 0
    with pytest.raises(Exception, match=S.VECTOR_DIMENSION):
        knn.nearest_k(requests(spark, [(9, [1.0])]), held, 1).collect()
    with pytest.raises(ValueError, match="k must"):
        knn.nearest_k(asked, held, 0)


def test_a_request_is_sent_once_to_each_part(spark):
    """Neighbouring cells share a part, a cell beyond its size has parts of its own, and each visit is kept."""
    layout = blockjoin.Layout({-1: 3, 0: 4, 8: 2, 9: 25, 16: 5, 17: 5}, 10)
    assert layout.spans == {-1: (0, 1), 0: (0, 1), 8: (0, 1), 9: (1, 3), 16: (4, 1), 17: (4, 1)} and layout.n_parts == 5
    rows = spark.createDataFrame([("r1", [-1, 0, 8, 17]), ("r2", []), ("r3", [9, 16, 17, 99])], "request_id string, cells array<int>")
    got = sorted((r.request_id, r.part, list(r.cells)) for r in layout.requests(rows).collect())
    assert got == [("r1", 0, [-1, 0, 8]), ("r1", 4, [17]), ("r3", 1, [9]), ("r3", 2, [9]), ("r3", 3, [9]), ("r3", 4, [16, 17])]
    held = spark.createDataFrame([(9, i) for i in range(60)] + [(8, 1), (17, 2)], "cell int, seq long")
    parts = {(r.cell, r.part) for r in layout.entries(held).collect()}
    assert parts == {(9, 1), (9, 2), (9, 3), (8, 0), (17, 4)}


def test_blocks_grow_with_the_table_up_to_their_memory():
    size = blockjoin.block_size
    assert size(2_000, 64, 256) == 256 and size(80_000, 64, 256) == 10_000
    assert size(10**9, 64, 256) == blockjoin.VALUES // 64 and size(10**9, 1 << 30, 256) == 256
