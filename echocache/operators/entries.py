"""Entry-table operators: append, ids, touch, delete, counts, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators.rank import rank_within
from echocache.operators.validate import clean_entries, entry_reason, split
from echocache.scratch import materialize

METADATA = ("collection", "id", "seq", "created_at", "last_accessed_at")


def metadata(entries: DataFrame) -> DataFrame:
    """What eviction needs to know; the scan reads no vectors and no texts."""
    return entries.select(*METADATA)


def counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("collection").agg(F.count(F.lit(1)).alias("entries"))


def issued_ids(entries: DataFrame) -> DataFrame:
    """Highest number per collection among ``entry-N`` ids."""
    number = F.regexp_extract("id", f"^{S.ENTRY_ID_PREFIX}([0-9]+)$", 1)
    return entries.groupBy("collection").agg(F.max(number.try_cast("long")).alias("base"))


def assign_ids(rows: DataFrame, issued: DataFrame | None = None) -> DataFrame:
    """Number new rows in arrival order, after the highest number ever issued.

    ``issued`` has collection and base; numbers of evicted entries are never used again.
    """
    keys = ["collection", "seq"]
    ranked = rank_within(rows.select(*keys), ["collection"], ["seq"])
    if issued is not None:
        ranked = ranked.join(issued, "collection", "left")
        number = F.coalesce("base", F.lit(0)) + F.col("rank")
    else:
        number = F.col("rank")
    ids = ranked.select(*keys, F.concat(F.lit(S.ENTRY_ID_PREFIX), number).alias("id"))
    return rows.drop("id").join(ids, keys)


def new_entries(rows: DataFrame, ids: str = "sequential", issued: DataFrame | None = None):
    """(entries ready to append, rejected rows) from collection, seq, ts, prompt, response, vector.

    ``ids``: ``sequential`` numbers them, ``uuid`` draws random ids.
    """
    if ids not in ("sequential", "uuid"):
        raise ValueError("ids must be 'sequential' or 'uuid'")
    valid, rejected = split(rows, entry_reason())
    timed = clean_entries(valid).withColumns({"created_at": F.col("ts"), "last_accessed_at": F.col("ts")})
    if ids == "sequential":
        named = assign_ids(timed, issued)
    else:
        # Written out: random ids must not change when a task is run again.
        named = materialize(timed.withColumn("id", F.uuid()), "entries")
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in S.ENTRY.fields]
    return named.select(*columns), rejected


def append(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Bag union: equal rows stay, as storing the same prompt twice keeps both."""
    return entries.unionByName(new.select(*entries.columns))


def touches(hits: DataFrame) -> DataFrame:
    """Latest access per hit entry from rows with collection, entry_seq, ts."""
    return hits.groupBy("collection", F.col("entry_seq").alias("seq")).agg(
        F.max("ts").alias("touched_at")
    )


def touch(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Move last_accessed_at of hit entries forward; nothing else changes."""
    moved = F.greatest("last_accessed_at", "touched_at")  # ignores the NULL of an unhit entry
    return (
        entries.join(touches(hits), ["collection", "seq"], "left")
        .withColumn("last_accessed_at", moved)
        .select(*entries.columns)
    )


def delete(entries: DataFrame, victims: DataFrame, key: str = "seq") -> DataFrame:
    """Entries that are not among the victims, matched by ``seq`` or ``id`` in their collection."""
    on = ["collection", key]
    return entries.join(victims.select(*on), on, "left_anti").select(*entries.columns)
