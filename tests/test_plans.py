"""Plans that have to hold at scale."""

import pytest
from pyspark.sql import functions as F

from echocache.operators import blockjoin
from echocache.operators import entries as E
from echocache.operators import lookup as L
from echocache.sources import tables as TB

FOLDER = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by_label", [True, False])
def test_lookup_has_no_cross_join_and_reads_texts_only_for_hits(spark, by_label):
    asked = TB.vector_requests(spark, FOLDER, by_label)
    held = TB.vector_entries(spark, FOLDER, by_label)
    small, large = plan(L.lookup(asked, held)), plan(L.lookup(asked, held, index="none", block_rows=100))
    assert "CartesianProduct" not in small + large
    assert "NestedLoop" not in small
    # One literal collection leaves no join key: only the few-row table of stripe counts is broadcast.
    assert large.count("BroadcastNestedLoopJoin BuildRight, Inner") == (0 if by_label else 2)
    assert large.count("FlatMapCoGroupsInArrow") == 1


def test_blocks_are_bounded_for_a_hot_collection(spark, monkeypatch):
    """Every block of a collection with two thirds of all rows stays near the block size."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id") % 30)).alias("collection"),
        F.concat(F.lit("r"), "id").alias("request_id"),
        F.col("id").alias("seq"),
        F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector"),
    )
    blocks = spark.sparkContext.accumulator(0)
    plain = blockjoin._block_kernel

    def watched(*options):
        run = plain(*options)

        def kernel(key, left, right):
            assert max(left.num_rows, right.num_rows) <= 2 * 200
            blocks.add(1)
            return run(key, left, right)

        return kernel

    monkeypatch.setattr(blockjoin, "_block_kernel", watched)
    best = L.nearest(rows, rows, 0.5, "l2sq", index="none", block_rows=200)
    assert best.where("score <> 0 OR request_id <> concat('r', entry_seq)").isEmpty()
    assert best.count() == 3000 and blocks.value >= 100


def test_delete_shuffles_only_keys_of_the_victims(spark):
    held = TB.vector_entries(spark, FOLDER)
    victims = held.where("seq % 2 = 0").select("collection", "seq", "prompt")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        deleted = E.delete(held, victims)
        text = plan(deleted)
        assert "LeftAnti" in text and "Cartesian" not in text and text.count("Exchange hashpartitioning") == 2
        # The right side of the join carries the two key columns and nothing else.
        join = deleted._jdf.queryExecution().optimizedPlan().collectLeaves()
        right = deleted._jdf.queryExecution().optimizedPlan().toString().rsplit("Project [", 1)[1].split("]")[0]
        assert join.size() == 2 and "prompt" not in right and "vector" not in right
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_metadata_scan_is_pruned(spark):
    text = plan(E.metadata(TB.vector_entries(spark, FOLDER)))
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in text
