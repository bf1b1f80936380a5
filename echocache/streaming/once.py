"""Micro-batch read-through that serves every request once, in event-time order.

A ledger keeps the first answer of each ``(collection, request_id)``. A request that comes again, in its own batch, in a later one
or after a restart, gets that answer; it stores nothing, touches nothing and asks nobody. Inside a batch
requests are served in the order of their event times by the ordered read-through, so one may hit what an earlier one of
the same batch has stored. The ledger is bounded by a watermark, the largest event time of the batches before less a
delay: what is older is not looked up any more, and requests older than it are turned away as late, because nobody
could tell whether they were served. A request that comes again under a later event time, when the watermark has passed its
first one, is a new request.

    ledger/batch=N/slot=S   first answers of batch N by slot of event time; slots behind the watermark are not opened
    marks/batch=N           largest event time of batch N, one row
    results/batch=N         a row for each request of batch N that got an answer
    late/batch=N            requests of batch N without an answer, with the reason

All of a batch is written under its number and looks at smaller numbers only, so a batch that runs twice has the effect
of running once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocache import schema as S
from echocache.operators.entries import touch
from echocache.operators.evict import victims
from echocache.operators.rank import rank_within
from echocache.plans.read_through import ordered_read_through
from echocache.scratch import materialize
from echocache.sources.store import CacheStore

#: Seconds of event time in a slot of the ledger, and bits for the places of one batch's requests in arrival numbers.
SLOT, PLACE_BITS = 3_600, 40
LATE = "request is older than the watermark"

_LEDGER = T.StructType([*S.RESULT.fields, T.StructField("ts", T.TimestampType())])
_PLACES = [T.StructField("batch", T.LongType()), T.StructField("slot", T.LongType())]
_KEY = ["collection", "request_id"]


class Ledger:
    """First answers below ``path``."""

    def __init__(self, spark: SparkSession, path: str, delay_seconds: int, slot_seconds: int = SLOT):
        if delay_seconds < 0 or slot_seconds < 1:
            raise ValueError("delay_seconds must be at least 0 and slot_seconds at least 1")
        self.spark, self.path = spark, S.check_text(path, "ledger_path").rstrip("/")
        self.delay, self.slot = delay_seconds, slot_seconds

    def _table(self, name: str, fields: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(fields).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], fields)

    def watermark(self, before: int) -> int | None:
        """In seconds, from the batches before ``before``; None before the first."""
        marks = self._table("marks", T.StructType([T.StructField("seen", T.LongType()), _PLACES[0]]))
        seen = marks.where(F.col("batch") < before).agg(F.max("seen")).first()[0]
        return None if seen is None else seen - self.delay

    def known(self, before: int) -> DataFrame:
        """First answers that the watermark has not passed, given before batch ``before``."""
        rows = self._table("ledger", T.StructType([*_LEDGER.fields, *_PLACES])).where(F.col("batch") < before)
        low = self.watermark(before)
        if low is not None:
            rows = rows.where((F.col("slot") >= low // self.slot) & (F.unix_seconds("ts") >= low))
        return rows.select(*S.RESULT.fieldNames())

    def record(self, first: DataFrame, seen: DataFrame, batch: int) -> None:
        """``first`` answers with ``ts``; ``seen`` are all requests of the batch."""
        slotted = first.select(*_LEDGER.fieldNames(), F.floor(F.unix_seconds("ts") / self.slot).alias("slot"))
        slotted.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/ledger/batch={batch}")
        seen.agg(F.max(F.unix_seconds("ts")).alias("seen")).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")


def serve_once(
    store: CacheStore,
    answer: Callable[[DataFrame], DataFrame],
    path: str,
    delay_seconds: int,
    max_capacity: int | None = None,
    policy="lru",
    slot_seconds: int = SLOT,
    **options,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: every request is served once, earlier event times first.

    Entries that were there before the stream have smaller ``seq`` values than 2^40. ``options`` are those of
    ``ordered_read_through``.
    """
    ledger = Ledger(store.spark, path, delay_seconds, slot_seconds)

    def run(requests: DataFrame, batch: int) -> None:
        rows = materialize(requests, "batch")
        low = ledger.watermark(batch)
        late = F.lit(False) if low is None else F.coalesce(F.unix_seconds("ts") < low, F.lit(False))
        in_time = rows.where(~late)
        turned_away = rows.where(late).select(*_KEY, F.lit(LATE).alias("reject_reason"))
        # Of a request that comes more than once the earliest row counts.
        first = in_time.groupBy(*_KEY).agg(F.min(F.struct("ts", "seq")).alias("first")).select(*_KEY, "first.*")
        known = materialize(ledger.known(batch), "known")
        fresh = in_time.join(first, [*_KEY, "ts", "seq"], "left_semi").join(known, _KEY, "left_anti").dropDuplicates(_KEY)
        ranked = rank_within(fresh.select(*_KEY, "ts", "seq"), ["collection"], ["ts", "seq", "request_id"], "place")
        number = F.lit((batch + 1) << PLACE_BITS) + F.col("place")
        ordered = materialize(
            fresh.drop("seq").join(ranked.select(*_KEY, number.alias("seq")), _KEY).select(*rows.columns), "ordered"
        )
        before = store.entries(before=batch)
        outcome = ordered_read_through(ordered, before, answer, issued=store.issued(before=batch), **options)
        served = materialize(outcome.results.join(ordered.select(*_KEY, "ts"), _KEY), "served")
        told = known.select(*S.RESULT.fieldNames()).unionByName(served.select(*S.RESULT.fieldNames()))
        results = in_time.select(*_KEY).join(told, _KEY).select(*S.RESULT.fieldNames())
        results.write.mode("overwrite").parquet(f"{ledger.path}/results/batch={batch}")
        rejected = outcome.rejected.select(*_KEY, "reject_reason").unionByName(turned_away)
        rejected.write.mode("overwrite").parquet(f"{ledger.path}/late/batch={batch}")
        store.append(outcome.new_entries, batch)
        store.touch(outcome.touched, batch)
        if max_capacity is not None:
            current = touch(before, outcome.touched)
            store.delete(victims(current, outcome.new_entries, max_capacity, policy), batch)
        # The ledger comes last: a batch that is not in it is run again from the start.
        ledger.record(served, rows, batch)

    return run
