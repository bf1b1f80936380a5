"""Read-through: serve hits, answer misses, and hand back what to store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators import answers as A
from echocache.operators import entries as E
from echocache.operators import lookup as L
from echocache.operators import ordered as O
from echocache.operators import validate as V
from echocache.operators.blockjoin import BLOCK_ROWS
from echocache.operators.evict import bounded_append
from echocache.operators.lookup import nearest
from echocache.scratch import materialize


@dataclass(frozen=True)
class ReadThrough:
    """``results`` has one row per answered request; the others say what changes in the store."""

    results: DataFrame
    touched: DataFrame
    rejected: DataFrame
    stored: DataFrame
    issued: DataFrame

    @cached_property
    def new_entries(self) -> DataFrame:
        """Answered misses as entries; ids are numbered only when this is asked for."""
        return E.new_entries(self.stored, issued=self.issued)[0]


def read_through(
    requests: DataFrame,
    entries: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    threshold: float = S.DEFAULT_THRESHOLD,
    metric: str | None = None,
    store: str | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    issued: DataFrame | None = None,
    on_invalid: str = "reject",
    **options,
) -> ReadThrough:
    """Serve all requests from the cache as it is now; every miss is answered and stored.

    ``requests``: collection, request_id, seq, ts, prompt and, without ``embed``, vector.
    ``answer`` adds ``response`` to the missed requests, e.g. from an answers table or a
    generator. ``issued`` continues entry numbers; by default after those in ``entries``.
    A request that cannot be compared with its collection is rejected alone; ``on_invalid="error"``
    fails the whole run instead. The lookup is written out once, because four tables come from it.
    """
    S.check_threshold(threshold)
    store, metric = S.resolve_metric(store, metric)
    cleaned, blank = V.split(V.clean_requests(requests), V.request_reason(), on_invalid)
    embedded = materialize(embed(cleaned), "embedded") if embed is not None else cleaned
    usable, unusable = V.split(embedded, V.request_reason(with_vector=True), on_invalid)
    uneven = usable.limit(0).withColumn("reject_reason", F.lit(""))
    if store in ("cosine", "distance"):
        sized = V.dimension_reason(usable, entries).withColumnRenamed("reject_reason", "_dimension")
        usable, uneven = (x.drop("_dimension") for x in V.split(sized, F.col("_dimension"), on_invalid))
    found = materialize(L.lookup(usable, entries, threshold, metric, store, **options), "lookup")
    served = L.hits(found).withColumn("response", F.col("cached_response"))
    answered = answer(L.misses(found).drop("cached_response"))
    if issued is None:
        issued = E.issued_ids(entries)
    # The answers, possibly from a slow generator, are fetched once.
    answered = materialize(answered, "answered")
    stored, failed = V.split(answered, V.entry_reason())
    columns = [
        "collection", "request_id", "prompt", "response", F.col("found").alias("cache_hit"),
        "score", "entry_id",
    ]
    rejected = [r.select(*S.REJECT.fieldNames()) for r in (blank, unusable, uneven, failed)]
    return ReadThrough(
        results=served.select(*columns).unionByName(stored.select(*columns)),
        touched=served.where("entry_seq IS NOT NULL").select("collection", "entry_seq", "ts"),
        rejected=reduce(DataFrame.unionByName, rejected),
        stored=stored,
        issued=issued,
    )


def ordered_read_through(
    requests: DataFrame,
    entries: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    threshold: float = S.DEFAULT_THRESHOLD,
    metric: str | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    issued: DataFrame | None = None,
    on_invalid: str = "reject",
    block_rows: int = BLOCK_ROWS,
) -> ReadThrough:
    """Requests in ``seq`` order: each sees the entries and what earlier requests have stored.

    A miss with a usable answer is stored and can serve later requests; a miss without one is
    rejected and stores nothing. ``answer`` gets misses only, in as many calls as answers depend on
    one another, and each miss once; a prompt that got no usable answer is not asked for again.
    Entries have smaller ``seq`` values than the requests. Other parameters and the result are those of
    ``read_through``; a hit on an earlier request has the id that its entry gets.
    """
    S.check_threshold(threshold)
    _, metric = S.resolve_metric(None, metric)
    cleaned, blank = V.split(V.clean_requests(requests), V.request_reason(), on_invalid)
    embedded = materialize(embed(cleaned), "embedded") if embed is not None else cleaned
    usable, unusable = V.split(embedded, V.request_reason(with_vector=True), on_invalid)
    sized = V.dimension_reason(usable, entries).withColumnRenamed("reject_reason", "_dimension")
    usable, uneven = (x.drop("_dimension") for x in V.split(sized, F.col("_dimension"), on_invalid))
    usable = materialize(usable, "usable")
    storable = V.entry_reason().isNull()
    answered = O.answered_in_order(usable, entries, answer, storable, threshold, metric, block_rows)
    answered = materialize(answered, "answered")

    keys = ["collection", "seq"]
    stored, blank_answers = V.split(answered, V.entry_reason())
    issued = E.issued_ids(entries) if issued is None else issued
    named = materialize(E.new_entries(stored, issued=issued)[0], "named")
    present = entries.select(*named.columns).unionByName(named)
    others = usable.join(stored.select(*keys), keys, "left_anti")
    found = nearest(others, present, threshold, metric, before=True, block_rows=block_rows)
    texts = present.select(
        "collection", F.col("seq").alias("entry_seq"), F.col("id").alias("entry_id"),
        F.col("response").alias("cached_response"),
    )
    served = others.join(found.join(texts, ["collection", "entry_seq"]), ["collection", "request_id"], "left")
    served = materialize(served, "served")
    hits = served.where("entry_seq IS NOT NULL")
    # A request that nobody serves had no usable answer, or one of its prompt had none.
    reasons = blank_answers.groupBy("prompt").agg(F.min("reject_reason").alias("reject_reason"))
    failed = served.where("entry_seq IS NULL").join(reasons, "prompt", "left")
    none = lambda kind: F.lit(None).cast(kind)
    results = hits.select(
        "collection", "request_id", "prompt", F.col("cached_response").alias("response"),
        F.lit(True).alias("cache_hit"), "score", "entry_id",
    ).unionByName(stored.select(
        "collection", "request_id", "prompt", "response", F.lit(False).alias("cache_hit"),
        none("double").alias("score"), none("string").alias("entry_id"),
    ))
    rejected = [r.select(*S.REJECT.fieldNames()) for r in (blank, unusable, uneven, failed)]
    return ReadThrough(
        results=results,
        touched=hits.select("collection", "entry_seq", "ts"),
        rejected=reduce(DataFrame.unionByName, rejected),
        stored=stored,
        issued=issued,
    )


def from_table(answers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Answers looked up by prompt in a table with unique prompts."""
    return lambda missed: A.attach(missed, answers)


def from_generator(generator, coalesce: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Answers of a generator of batches; with ``coalesce`` equal misses of one call are generated once."""
    ask = lambda missed: A.generate(missed, generator)
    return (lambda missed: A.coalesced(missed, ask)) if coalesce else ask


def fixed_answer(text: str = S.BASELINE_GENERATED_RESPONSE) -> Callable[[DataFrame], DataFrame]:
    return lambda missed: missed.withColumn("response", F.lit(text))


def apply_to(
    entries: DataFrame,
    outcome: ReadThrough,
    max_capacity: int | None = None,
    policy="lru",
) -> DataFrame:
    """The entries after a read-through: accesses recorded, new entries stored within capacity."""
    touched = E.touch(entries, outcome.touched)
    if max_capacity is None:
        return E.append(touched, outcome.new_entries)
    return bounded_append(touched, outcome.new_entries, max_capacity, policy)
