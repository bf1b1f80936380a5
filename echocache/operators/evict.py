"""Eviction: single victims and bounded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators.entries import METADATA, counts, delete
from echocache.operators.rank import rank_within
from echocache.scratch import materialize


def victim(entries: DataFrame, policy="lru") -> DataFrame:
    """The entry each collection would evict next. A collection without entries has no row."""
    order = S.resolve_policy(policy)
    if order is None:
        raise ValueError("policy 'none' has no victim")
    first = F.min_by("id", F.struct(*order))
    return entries.groupBy("collection").agg(first.alias("id"))


def victims(
    entries: DataFrame,
    inserts: DataFrame,
    max_capacity: int = S.DEFAULT_CAPACITY,
    policy="lru",
    shrink: bool = False,
) -> DataFrame:
    """Metadata of the rows that leave when ``inserts`` are stored one after the other.

    Each insert into a full collection evicts exactly one row, so n entries and k inserts lose
    least(k, n + k - capacity) rows. The insert that arrives last (by ``seq``) stays, as nothing is
    stored after it; the others lose the first rows in policy order, whatever their access times.
    A collection that is already over capacity therefore keeps its size, unless ``shrink`` trims it.
    Only collections that lose rows are ranked, and only their metadata is shuffled.
    """
    S.check_capacity(max_capacity)
    order = S.resolve_policy(policy)
    known = entries.select(*METADATA)
    arriving = inserts.select(*METADATA)
    if order is None:
        return known.limit(0)
    extra = [c for c in order if c not in METADATA]
    if extra:
        raise ValueError(f"eviction policy must order by {', '.join(METADATA)}. Got: {extra}")
    k = F.coalesce("k", F.lit(0))
    over = F.coalesce("n", F.lit(0)) + k - max_capacity
    # Written out, so that its real size decides how it meets the rows.
    need = materialize(
        counts(known).withColumnRenamed("entries", "n")
        .join(counts(arriving).withColumnRenamed("entries", "k"), "collection", "full")
        .select("collection", (over if shrink else F.least(k, over)).alias("leaving"))
        .where("leaving > 0"),
        "leaving",
    )
    last = arriving.groupBy("collection").agg(F.max("seq").alias("last"))
    need = need.join(last, "collection", "left")
    early = arriving.withColumn("arrives", F.col("seq")).unionByName(known, allowMissingColumns=True)
    pool = early.join(need, "collection").where("arrives IS NULL OR arrives <> last").drop("arrives", "last")
    ranked = rank_within(pool, ["collection"], list(order))
    return ranked.where("rank <= leaving").select(*METADATA)


def bounded_append(
    entries: DataFrame,
    inserts: DataFrame,
    max_capacity: int = S.DEFAULT_CAPACITY,
    policy="lru",
    shrink: bool = False,
) -> DataFrame:
    """Entries after storing ``inserts`` in a bounded collection."""
    leaving = victims(entries, inserts, max_capacity, policy, shrink)
    return delete(entries.unionByName(inserts.select(*entries.columns)), leaving)
