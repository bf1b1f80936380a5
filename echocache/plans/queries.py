"""Registered queries: every operator over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.functions import embed as EM
from echocache.functions import text as TX
from echocache.functions import vectors as V
from echocache.operators import answers as A
from echocache.operators import entries as E
from echocache.operators import evict as EV
from echocache.operators import knn as K
from echocache.operators import lookup as L
from echocache.operators import ordered as O
from echocache.operators import replay as R
from echocache.operators import report as RP
from echocache.operators import sparse as SP
from echocache.operators import validate as VA
from echocache.plans import read_through as RT
from echocache.scratch import materialize, scratch_path
from echocache.sources import tables as TB
from echocache.sources.clustered import ClusteredStore
from echocache.sources.store import CacheStore
from echocache.streaming.snapshot import serve_batch
from echocache.streaming.stateful import ROCKSDB, serve_bounded_batch, stream_read_through

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed values shared with the check SQL.
CHAT_THRESHOLD = 0.6
CHAT_DIM = 256
LOG_CAPACITY = 20
EVICT_CAPACITY = 80
STORE_CAPACITY = 50
ORDERED_THRESHOLD = 0.3


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _six(column: str):
    return F.round(column, 6).alias(column)


def _served(rows):
    return rows.select("seq", "cache_hit", F.coalesce("entry_seq", F.lit(-1)).alias("entry_seq"))


def _seconds(column: str):
    return F.unix_seconds(column)


# Sources and sinks


@query
def collection_roundtrip(spark, folder):
    path = scratch_path(spark, "store")
    CacheStore(spark, path).append(TB.vector_entries(spark, folder), batch=0)
    return CacheStore(spark, path).entries().select(
        "collection", "id", "seq", "prompt", "response",
        F.element_at("vector", 1).alias("first_value"), F.size("vector").alias("dim"),
        _seconds("created_at").alias("created_s"),
    )


@query
def store_append(spark, folder):
    entries = TB.vector_entries(spark, folder)
    again = TB.vector_entries(spark, folder).select(
        "collection",
        F.concat(F.lit("r"), "seq").alias("request_id"),
        (F.col("seq") + TB.LATER).alias("seq"),
        F.timestamp_seconds(F.lit(TB.LATER) + F.col("seq")).alias("ts"),
        F.concat(F.lit("  "), "prompt", F.lit("\n")).alias("prompt"),
        F.when(F.col("seq") % 50 == 3, F.lit(" ")).otherwise(F.concat("response", F.lit(" ")))
        .alias("response"),
        "vector",
    )
    new, _ = E.new_entries(again, issued=E.issued_ids(entries))
    return E.append(entries, new).select(
        "collection", "id", "seq", "prompt", "response", _six("norm"),
        _seconds("last_accessed_at").alias("accessed_s"),
    )


@query
def entry_metadata(spark, folder):
    return E.metadata(TB.vector_entries(spark, folder)).select(
        "collection", "id", "seq", _seconds("created_at").alias("created_s"),
        _seconds("last_accessed_at").alias("accessed_s"),
    )


# Cleaning and validation


@query
def clean_prompts(spark, folder):
    return VA.clean_requests(TB.marred_turns(spark, folder)).select("request_id", "prompt")


@query
def validate_requests(spark, folder):
    valid, _ = VA.split(TB.marred_turns(spark, folder), VA.request_reason())
    return VA.clean_requests(valid).select("request_id", "prompt")


@query
def validate_entries(spark, folder):
    reason = F.coalesce(TX.prompt_reason("prompt"), TX.response_reason("response"))
    valid, _ = VA.split(TB.marred_turns(spark, folder), reason)
    return valid.select("request_id", TX.clean("prompt").alias("prompt"), "response")


@query
def validate_vectors(spark, folder):
    return TB.marred_vectors(spark, folder).select(
        "request_id", V.vector_reason("vector").alias("reject_reason")
    )


@query
def dimension_mismatch(spark, folder):
    entries = TB.vector_entries(spark, folder)
    checked = VA.dimension_reason(TB.marred_vectors(spark, folder), entries)
    return checked.select("collection", "request_id", "reject_reason")


@query
def rejected_rows(spark, folder):
    turns = TB.marred_turns(spark, folder)
    reason = F.coalesce(TX.prompt_reason("prompt"), TX.response_reason("response"))
    _, texts = VA.split(turns, reason)
    _, vectors = VA.split(TB.marred_vectors(spark, folder), VA.request_reason(with_vector=True))
    columns = S.REJECT.fieldNames()
    return texts.select(*columns).unionByName(vectors.select(*columns))


@query
def float32_drift(spark, folder):
    third = F.transform("vector", lambda x: x / 3)
    rows = TB.vector_entries(spark, folder).select("seq", third.alias("v"))
    gap = F.zip_with("v", V.to_float32("v"), lambda a, b: F.abs(a - b))
    return rows.select("seq", F.array_max(gap).alias("drift"))


# Vector functions


def _with_reverse(spark, folder):
    return TB.vector_entries(spark, folder).select(
        "seq", "vector", F.reverse("vector").alias("other")
    )


@query
def vector_norms(spark, folder):
    doubled = F.transform("vector", lambda x: x * F.col("seq"))
    return _with_reverse(spark, folder).select("seq", F.round(V.norm(doubled), 6).alias("norm"))


@query
def vector_dot(spark, folder):
    rows = _with_reverse(spark, folder)
    return rows.select("seq", F.round(V.dot("vector", "other"), 6).alias("dot"))


@query
def vector_cosine(spark, folder):
    rows = _with_reverse(spark, folder)
    return rows.select("seq", F.round(V.cosine("vector", "other"), 6).alias("cosine"))


@query
def vector_l2(spark, folder):
    rows = _with_reverse(spark, folder)
    return rows.select(
        "seq", F.round(V.l2sq("vector", "other"), 6).alias("l2sq"),
        F.round(V.l2("vector", "other"), 6).alias("l2"),
    )


@query
def embed_hash(spark, folder):
    docs = TB.table(spark, folder, "documents").select("doc_id", F.col("text").alias("prompt"))
    filled = lambda n, b: F.when(n > 0, F.concat_ws(":", b, n.cast("int")))
    shown = F.array_join(F.transform("vector", filled), " ")  # leaves out the empty buckets
    return EM.embed_hash(docs, dim=CHAT_DIM).select("doc_id", shown.alias("buckets"))


def _letters(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A plugged-in model: how often each vowel is in a prompt."""
    for prompts in batches:
        yield prompts.map(lambda text: [float(text.count(c)) for c in "aeiou"])


@query
def embed_model(spark, folder):
    turns = VA.split(VA.clean_requests(TB.marred_turns(spark, folder)), VA.request_reason())[0]
    letters = [F.get("vector", i).cast("long").alias(c) for i, c in enumerate("aeiou")]
    return EM.embed_with(turns, _letters).select("request_id", *letters)


# Lookup


def _nearest(spark, folder, **options):
    found = L.nearest(
        TB.vector_requests(spark, folder, by_label=False),
        TB.vector_entries(spark, folder, by_label=False),
        **options,
    )
    return found.select("request_id", "entry_seq", _six("score"), *(["place"] if "k" in options else []))


@query
def nearest_cosine(spark, folder):
    return _nearest(spark, folder)


@query
def nearest_l2sq(spark, folder):
    return _nearest(spark, folder, metric="l2sq")


@query
def nearest_l2(spark, folder):
    return _nearest(spark, folder, metric="l2")


@query
def nearest_indexed(spark, folder):
    return _nearest(spark, folder, index="pivots", n_pivots=16, block_rows=256)


@query
def lookup_stored_index(spark, folder):
    """A lookup by a second instance, from a store that is its own index: two batches, then deletes."""
    path, entries = scratch_path(spark, "clustered"), TB.vector_entries(spark, folder)
    store = ClusteredStore(spark, path)
    store.append(entries.where("seq % 3 > 0"), 0)
    store.append(entries.where("seq % 3 = 0"), 1)
    store.delete(entries.where("seq % 7 = 2"), 2)
    found = ClusteredStore(spark, path).lookup(TB.vector_requests(spark, folder))
    return found.select("collection", "request_id", "found", "cached_response", "entry_id", _six("score"))


@query
def nearest_lsh(spark, folder):
    return _nearest(spark, folder, index="lsh")


@query
def top_k_by_cells(spark, folder):
    """The three closest entries without a threshold, from the cells that counts allow."""
    found = K.nearest_k(
        TB.vector_requests(spark, folder, by_label=False), TB.vector_entries(spark, folder, by_label=False), 3,
        n_pivots=16, block_rows=256,
    )
    return found.select("request_id", "entry_seq", _six("score"), "place")


@query
def top_k_matches(spark, folder):
    return _nearest(spark, folder, threshold=None, k=3)


def _label_lookup(spark, folder, **options):
    return L.lookup(
        TB.vector_requests(spark, folder), TB.vector_entries(spark, folder), **options
    )


@query
def lookup_result(spark, folder):
    return _label_lookup(spark, folder).select(
        "collection", "request_id", "found", F.col("cached_prompt").alias("prompt"),
        F.col("cached_response").alias("response"), "entry_id", _six("score"),
    )


@query
def hits_and_misses(spark, folder):
    found = _label_lookup(spark, folder, metric="l2sq", store="distance")
    hits = L.hits(found).select("request_id", F.lit("hit").alias("branch"), "entry_id")
    misses = L.misses(found).select("request_id", F.lit("miss").alias("branch"), "entry_id")
    return hits.unionByName(misses)


@query
def lookup_empty_collection(spark, folder):
    requests = TB.vector_requests(spark, folder).withColumn(
        "collection", F.concat(F.lit("unknown-"), "collection")
    )
    found = L.lookup(requests, TB.vector_entries(spark, folder))
    return found.select("collection", "request_id", "found", "cached_prompt", "cached_response")


@query
def baseline_policies(spark, folder):
    requests = TB.vector_requests(spark, folder)
    entries = TB.vector_entries(spark, folder)

    def report(store):
        outcome = RT.read_through(requests, entries, RT.fixed_answer(), store=store)
        return RP.hit_report(outcome.results).withColumn("policy", F.lit(store))

    return report("always_miss").unionByName(report("always_hit"))


# Store changes


@query
def touch_entries(spark, folder):
    found = _label_lookup(spark, folder)
    return E.touch(TB.vector_entries(spark, folder), L.hits(found)).select(
        "collection", "id", "seq", _seconds("last_accessed_at").alias("accessed_s")
    )


@query
def delete_entries(spark, folder):
    found = _label_lookup(spark, folder)
    victims = L.hits(found).select("collection", F.col("entry_id").alias("id"))
    return E.delete(TB.vector_entries(spark, folder), victims, key="id").select("collection", "id")


@query
def entry_counts(spark, folder):
    return E.counts(TB.log_entries(spark, folder))


@query
def assign_entry_ids(spark, folder):
    log = TB.request_log(spark, folder)
    even = F.when(F.col("collection").cast("long") % 2 == 0, F.lit(1000).cast("long"))
    issued = log.groupBy("collection").agg(F.first(even).alias("base"))
    return E.assign_ids(log, issued).select("collection", "seq", "id")


@query
def lru_victim(spark, folder):
    return EV.victim(TB.log_entries(spark, folder), "lru")


@query
def fifo_victim(spark, folder):
    return EV.victim(TB.log_entries(spark, folder), "fifo")


def _evict(spark, folder, policy):
    return EV.bounded_append(
        TB.log_entries(spark, folder), TB.log_inserts(spark, folder), EVICT_CAPACITY, policy
    ).select("collection", "id", "seq")


@query
def evict_lru(spark, folder):
    return _evict(spark, folder, "lru")


@query
def evict_fifo(spark, folder):
    return _evict(spark, folder, "fifo")


# Answers


@query
def recorded_answers(spark, folder):
    return A.recorded(TB.table(spark, folder, "conversations"))


def _chat_answers(spark, folder):
    rows = TB.dialogue(spark, folder).where("response IS NOT NULL")
    return A.answer_table(rows, ["seq"])


@query
def answer_misses(spark, folder):
    requests = VA.clean_requests(TB.dialogue(spark, folder)).drop("response")
    return A.attach(requests, _chat_answers(spark, folder)).select("request_id", "response")


def _echo(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for prompts in batches:
        yield "answer to " + prompts


@query
def generate_misses(spark, folder):
    requests = VA.clean_requests(TB.dialogue(spark, folder)).drop("response")
    return A.generate(requests, _echo).select("request_id", "response")


# Read-through


def _chat_embed(rows):
    return EM.embed_hash(rows, dim=CHAT_DIM)


def _chat_entries(spark, folder):
    """Every user turn with an answer, without its context, as a cached entry."""
    pairs = A.recorded(TB.table(spark, folder, "conversations"))
    rows = pairs.select(
        F.lit("chat").alias("collection"),
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        (F.shiftleft("conv_id", TB.TURN_BITS) + F.col("turn") - TB.BEFORE).alias("seq"),
        F.timestamp_seconds(F.lit(TB.START) + F.col("conv_id")).alias("ts"),
        "prompt", "response",
    )
    return materialize(E.new_entries(_chat_embed(rows))[0], "entries")


def _chat_read_through(spark, folder, entries):
    return RT.read_through(
        TB.dialogue(spark, folder).drop("response"),
        entries,
        RT.from_table(_chat_answers(spark, folder)),
        threshold=CHAT_THRESHOLD,
        embed=_chat_embed,
    )


def _result(results):
    return results.select("request_id", "response", "cache_hit", _six("score"), "entry_id")


@query
def read_through_snapshot(spark, folder):
    return _result(_chat_read_through(spark, folder, _chat_entries(spark, folder)).results)


@query
def repeat_run_hits(spark, folder):
    entries = _chat_entries(spark, folder)
    first = _chat_read_through(spark, folder, entries)
    second = _chat_read_through(spark, folder, RT.apply_to(entries, first))
    again = second.results.select("request_id", F.col("cache_hit").alias("second_hit"))
    return first.results.select("request_id", F.col("cache_hit").alias("first_hit")).join(
        again, "request_id"
    )


@query
def hit_report(spark, folder):
    outcome = RT.read_through(
        TB.vector_requests(spark, folder), TB.vector_entries(spark, folder), RT.fixed_answer()
    )
    return RP.hit_report(outcome.results)


@query
def read_through_ordered(spark, folder):
    requests = TB.vector_entries(spark, folder, by_label=False).withColumnRenamed("id", "request_id")
    served = O.read_through_ordered(requests, threshold=ORDERED_THRESHOLD)
    return served.select(
        "seq", "cache_hit", F.coalesce("entry_seq", F.lit(-1)).alias("entry_seq"), _six("score")
    )


@query
def nearest_sparse(spark, folder):
    """Token counts are mostly zeros: the closest cached turn of each turn by an inverted index."""
    entries = _chat_entries(spark, folder)
    asked = _chat_embed(VA.split(VA.clean_requests(TB.dialogue(spark, folder)), VA.request_reason())[0])
    asked = VA.split(asked, VA.request_reason(with_vector=True))[0]
    found = SP.nearest_sparse(asked, entries, CHAT_THRESHOLD)
    ids = entries.select("collection", F.col("seq").alias("entry_seq"), F.col("id").alias("entry_id"))
    return found.join(ids, ["collection", "entry_seq"]).select("request_id", "entry_id", _six("score"))


@query
def ordered_dialogue(spark, folder):
    """The dialogue in order: answers of earlier turns serve later ones, unanswered turns store nothing.

    Small blocks, so that the rounds of larger tables are taken here too.
    """
    outcome = RT.ordered_read_through(
        TB.dialogue(spark, folder).drop("response"), _chat_entries(spark, folder),
        RT.from_table(_chat_answers(spark, folder)), threshold=CHAT_THRESHOLD, embed=_chat_embed, block_rows=150,
    )
    return _result(outcome.results)


@query
def read_through_mixed_requests(spark, folder):
    """A snapshot read-through of requests of which some have no text or no comparable vector."""
    marred = TB.marred_vectors(spark, folder).withColumn(
        "prompt", F.when(F.col("seq") % 50 == 7, F.lit(" \t")).otherwise(F.col("prompt"))
    )
    outcome = RT.read_through(marred, TB.vector_entries(spark, folder), RT.fixed_answer())
    served = outcome.results.select("request_id", "cache_hit", F.lit(None).cast("string").alias("reason"))
    turned_away = outcome.rejected.select(
        "request_id", F.lit(None).cast("boolean").alias("cache_hit"), F.col("reject_reason").alias("reason")
    )
    return served.unionByName(turned_away)


@query
def lru_exact_read_through(spark, folder):
    log = TB.request_log(spark, folder)
    return _served(R.read_through_exact(log, "key", LOG_CAPACITY))


@query
def read_through_lru(spark, folder):
    log = TB.one_hot(TB.request_log(spark, folder))
    return _served(R.read_through_bounded(log, LOG_CAPACITY))


# Reports


@query
def cache_table_checks(spark, folder):
    checks = RP.table_checks(_marred_entries(spark, folder), max_capacity=40)
    return checks.select("name", "healthy", "message", "details", RP.line().alias("line"))


@query
def check_report(spark, folder):
    return RP.report_text(RP.table_checks(_marred_entries(spark, folder), max_capacity=40))


def _marred_entries(spark, folder):
    entries = TB.vector_entries(spark, folder)
    vectors = TB.marred_vectors(spark, folder).select("collection", "seq", "vector")
    blank = F.when(F.col("seq") % 20 == 4, F.lit("\t")).otherwise(F.col("prompt"))
    return entries.drop("vector").join(vectors, ["collection", "seq"]).withColumn("prompt", blank)


# Streams


@query
def stream_read_through_exact(spark, folder):
    return _streamed(spark, folder, "key")


@query
def stream_read_through_vectors(spark, folder):
    return _streamed(spark, folder, None)


def _streamed(spark, folder, key):
    log = TB.log_columns(TB.stream(spark, folder, "events"))
    requests = log if key else TB.one_hot(log)
    answered = stream_read_through(requests, LOG_CAPACITY, key=key)
    out = scratch_path(spark, "stream")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        run = (
            answered.writeStream.format("parquet").option("checkpointLocation", f"{out}-state")
            .trigger(availableNow=True).start(out)
        )
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return _served(spark.read.schema(answered.schema).parquet(out))


@query
def stream_bounded_batches(spark, folder):
    """The request log as a stream, each micro-batch replayed from the caches before it."""
    base = scratch_path(spark, "stream")
    events = TB.stream(spark, folder, "events")
    serve = serve_bounded_batch(base, max_capacity=LOG_CAPACITY, key="key")
    run = (
        TB.log_columns(events).writeStream.foreachBatch(serve)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return _served(spark.read.parquet(f"{base}/results"))


@query
def read_through_distance(spark, folder):
    """Snapshot read-through by squared distance; misses go to a generator."""
    outcome = RT.read_through(
        TB.vector_requests(spark, folder), TB.vector_entries(spark, folder),
        RT.from_generator(_echo), metric="l2sq", store="distance",
    )
    return _result(outcome.results)


@query
def bounded_read_through(spark, folder):
    """Entries left in each collection after a snapshot read-through within capacity."""
    entries = TB.vector_entries(spark, folder)
    requests = TB.vector_requests(spark, folder).withColumn("seq", F.col("seq") + TB.LATER)
    outcome = RT.read_through(requests, entries, RT.fixed_answer())
    kept = RT.apply_to(entries, outcome, max_capacity=STORE_CAPACITY)
    return kept.select("collection", "id", "seq", _seconds("last_accessed_at").alias("accessed_s"))


@query
def stream_snapshot_lookup(spark, folder):
    """The snapshot read-through of the dialogue, fed as a stream of stored requests."""
    base = scratch_path(spark, "stream")
    requests = TB.dialogue(spark, folder).drop("response")
    requests.write.parquet(f"{base}/requests")
    store = CacheStore(spark, f"{base}/store")
    store.append(_chat_entries(spark, folder), batch=-1)
    answer = RT.from_table(_chat_answers(spark, folder))
    serve = serve_batch(
        store, answer, f"{base}/results", threshold=CHAT_THRESHOLD, embed=_chat_embed
    )
    run = (
        spark.readStream.schema(requests.schema).parquet(f"{base}/requests")
        .writeStream.foreachBatch(serve).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return _result(spark.read.schema(S.RESULT).parquet(f"{base}/results"))
