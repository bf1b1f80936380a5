import numpy as np
import pytest
from pyspark.sql import functions as F

from echocache.operators import replay as R
from echocache.plans import read_through as RT
from echocache.sources.store import CacheStore
from echocache.streaming.snapshot import serve_batch
from echocache.streaming.stateful import ROCKSDB, serve_bounded_batch, stream_read_through
from tests.rows import collected, entries, requests

RESULT = ("collection", "request_id", "cache_hit", "entry_seq", "score")


def log(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 3)))]
    return requests(spark, rows[:80], "a").unionByName(requests(spark, rows[80:], "b"))


def rounded(df):
    return collected(df.fillna(-1, ["entry_seq", "score"]).withColumn("score", F.round("score", 9)), *RESULT)


def parts(rows, path):
    """The log as a folder with one file for each stretch of seq, written in order."""
    for lo in (0, 30, 95):
        hi = {0: 30, 30: 95, 95: 120}[lo]
        rows.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_stateful_stream_equals_batch_over_restarts(spark, tmp_path, metric):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = log(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        answered = stream_read_through(stream, 8, 0.7, metric)
        answered.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(
            availableNow=True).start(out).awaitTermination()
        return spark.read.schema(answered.schema).parquet(out)

    rows.where("seq < 50").write.parquet(source)
    run()
    rows.where("seq >= 50").write.mode("append").parquet(source)  # the second run restores the state
    assert rounded(run()) == rounded(R.read_through_bounded(rows, 8, 0.7, metric))


def test_bounded_batches_equal_one_batch_and_can_run_twice(spark, tmp_path):
    rows, base = log(spark), str(tmp_path)
    serve = serve_bounded_batch(base, max_capacity=8, threshold=0.7, chunk_rows=20)
    for batch, (lo, hi) in enumerate([(0, 30), (30, 95), (95, 120)]):
        part = rows.where((F.col("seq") >= lo) & (F.col("seq") < hi))
        serve(part, batch)
        if batch == 1:
            serve(part, batch)
    got = spark.read.parquet(f"{base}/results")
    assert rounded(got) == rounded(R.read_through_bounded(rows, 8, 0.7))


def test_snapshot_batches_append_touch_evict_and_can_run_twice(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "store"))
    results = str(tmp_path / "results")
    serve = serve_batch(store, RT.fixed_answer("new"), results, max_capacity=2)
    serve(requests(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]), 0)
    second = requests(spark, [(3, [1.0, 0.0]), (4, [-1.0, 0.0])])
    serve(second, 1)
    serve(second, 1)
    got = spark.read.parquet(results)
    assert collected(got, "request_id", "cache_hit") == [("r1", False), ("r2", False), ("r3", True), ("r4", False)]
    assert collected(store.entries(), "id", "seq") == [("entry-1", 1), ("entry-3", 4)]


def test_snapshot_stream_reads_what_was_stored_before(spark, tmp_path):
    source, results = str(tmp_path / "in"), str(tmp_path / "results")
    store = CacheStore(spark, str(tmp_path / "store"))
    store.append(entries(spark, [(1, [1.0, 0.0])]), -1)
    asked = requests(spark, [(11, [1.0, 0.0]), (12, [0.0, 1.0])])
    asked.write.parquet(source)
    spark.readStream.schema(asked.schema).parquet(source).writeStream.foreachBatch(
        serve_batch(store, RT.fixed_answer("new"), results)
    ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(results)
    assert collected(got, "request_id", "response", "cache_hit") == [("r11", "response 1", True), ("r12", "new", False)]
    assert store.entries().count() == 2
