import pytest
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators import entries as E
from echocache.operators import lookup as L
from echocache.operators.rank import rank_within
from echocache.sources.store import CacheStore
from tests.rows import at, collected, entries, requests


def stored(spark, rows, **options):
    """new_entries from (seq, prompt, response, vector)."""
    full = [("c", f"r{seq}", seq, at(seq), *rest) for seq, *rest in rows]
    ddl = "collection string, request_id string, seq long, ts timestamp, prompt string, response string, vector array<double>"
    return E.new_entries(spark.createDataFrame(full, ddl), **options)


def test_ids_count_up_and_equal_vectors_are_both_kept(spark):
    new, _ = stored(spark, [(5, "first", "r", [1.0]), (9, "second", "r", [1.0])])
    assert collected(new, "seq", "id") == [(5, "entry-1"), (9, "entry-2")]


def test_ids_are_never_used_again(spark):
    old = entries(spark, [(7, [1.0]), (2, [1.0])])
    new, _ = stored(spark, [(20, "p", "r", [1.0])], issued=E.issued_ids(old))
    assert collected(new, "id") == [("entry-8",)]


def test_random_ids(spark):
    new, _ = stored(spark, [(1, "p", "r", [1.0]), (2, "p", "r", [1.0])], ids="uuid")
    ids = [r.id for r in new.collect()]
    assert len(set(ids)) == 2 and all(len(i) == 36 for i in ids)
    with pytest.raises(ValueError):
        E.new_entries(new, ids="other")


def test_prompt_is_stripped_and_response_is_not(spark):
    row = stored(spark, [(1, "  p\n", " r ", [3.0, 4.0])])[0].first()
    assert (row.prompt, row.response, row.norm) == ("p", " r ", 5.0)
    assert row.created_at == row.last_accessed_at == at(1)


def test_invalid_rows_are_rejected_with_the_first_reason(spark):
    _, rejected = stored(
        spark, [(1, " ", "r", [1.0]), (2, "p", "", [1.0]), (3, "p", "r", [0.0, 0.0]), (4, "p", "r", [])]
    )
    assert collected(rejected, "seq", "reject_reason") == [
        (1, S.PROMPT_BLANK), (2, S.RESPONSE_BLANK), (3, S.VECTOR_ZERO), (4, S.VECTOR_EMPTY)
    ]


@pytest.fixture
def many_partitions(spark):
    """Small data keeps its shuffle partitions, as large data would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rank_of_a_hot_group_spreads_over_partitions(spark, many_partitions):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 6000).alias("seq"),
    )
    got = rank_within(rows, ["g"], ["seq"])
    wrong = got.join(rows.withColumnRenamed("seq", "other"), "g").where("other <= seq").groupBy(
        "g", "seq", "rank").count().where("rank <> count")
    assert got.count() == 6000 and wrong.isEmpty()
    placed = rows.repartitionByRange("g", "seq").select("g", F.spark_partition_id().alias("p"))
    assert placed.where("g = 'hot'").select("p").distinct().count() > 1


def test_touch_moves_access_time_forward_only(spark):
    held = entries(spark, [(1, [1.0], 10), (2, [1.0], 10), (3, [1.0], 10)])
    hits = spark.createDataFrame(
        [("c", 1, at(50)), ("c", 1, at(40)), ("c", 2, at(5)), ("d", 3, at(99))],
        "collection string, entry_seq long, ts timestamp",
    )
    got = E.touch(held, hits)
    assert got.columns == held.columns
    assert collected(got, "seq", "last_accessed_at") == [(1, at(50)), (2, at(10)), (3, at(10))]
    assert collected(got, "seq", "created_at") == collected(held, "seq", "created_at")


def test_delete_keeps_other_copies(spark):
    held = entries(spark, [(1, [1.0]), (2, [1.0]), (3, [1.0])])
    assert collected(E.delete(held, held.where("seq = 2")), "seq") == [(1,), (3,)]
    assert collected(E.delete(held, held.where("seq = 2").select("collection", "id"), key="id"), "seq") == [(1,), (3,)]


def test_metadata_reads_no_vectors(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path))
    store.append(entries(spark, [(1, [1.0])]), 0)
    plan = E.metadata(store.stored())._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,seq:bigint,created_at:timestamp,last_accessed_at:timestamp>" in plan


def test_round_trip_through_a_second_instance(spark, tmp_path):
    CacheStore(spark, str(tmp_path), "c").append(entries(spark, [(1, [1.0, 0.0])]), 0)
    again = CacheStore(spark, str(tmp_path), "c").entries()
    got = L.lookup(requests(spark, [(2, [1.0, 0.0])]), again).first()
    assert got.found and got.cached_response == "response 1"
    assert [(f.name, f.dataType.simpleString()) for f in again.schema] == [
        (f.name, f.dataType.simpleString()) for f in S.ENTRY
    ]


def test_missing_store_is_empty_and_usable(spark, tmp_path):
    held = CacheStore(spark, str(tmp_path / "none"), "c").entries()
    assert held.isEmpty() and not L.lookup(requests(spark, [(2, [1.0])]), held).first().found


def test_only_the_named_collection_is_read(spark, tmp_path):
    both = entries(spark, [(1, [1.0])], "a").unionByName(entries(spark, [(2, [1.0])], "b"))
    CacheStore(spark, str(tmp_path)).append(both, 0)
    named = CacheStore(spark, str(tmp_path), "b").entries()
    assert collected(named, "collection", "seq") == [("b", 2)]
    plan = CacheStore(spark, str(tmp_path), "b").stored()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan


def test_batches_are_replaced_touches_and_deletes_apply(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path))
    store.append(entries(spark, [(1, [1.0]), (2, [1.0])]), 0)
    for _ in range(2):
        store.append(entries(spark, [(3, [1.0])]), 1)
        hits = spark.createDataFrame([("c", 1, at(70))], "collection string, entry_seq long, ts timestamp")
        store.touch(hits, 1)
        store.delete(entries(spark, [(2, [1.0])]), 1)
    assert collected(store.entries(), "seq", "last_accessed_at") == [(1, at(70)), (3, at(3))]
    assert collected(store.entries(before=1), "seq") == [(1,), (2,)]
    assert collected(store.issued(), "base") == [(3,)]
    moved = store.compact(str(tmp_path / "next"))
    assert collected(moved.entries(), *S.ENTRY.fieldNames()) == collected(store.entries(), *S.ENTRY.fieldNames())
    with pytest.raises(ValueError):
        store.compact(store.path)
