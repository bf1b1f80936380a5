"""Row numbers inside groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echocache.scratch import materialize

# Bits that monotonically_increasing_id gives to the row position inside a partition.
_POSITION_BITS = 33


def rank_within(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add ``name``: 1 for the first row of each group in ``order``, and so on.

    Rows are range-partitioned by group and order, so a hot group spreads over many partitions.
    Each partition numbers its rows locally; the few (group, partition) totals, added up, shift
    them to global numbers. The placed rows are written out once, so that both passes see the
    same partitions even when a task is retried. ``order`` must be unique inside a group.
    """
    keys = [*group, *order]
    placed = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_part", F.shiftright("_at", _POSITION_BITS))
    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    spans = (
        placed.groupBy(*group, "_part")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    number = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return (
        placed.join(spans, [*group, "_part"])
        .withColumn(name, number)
        .drop("_at", "_part", "_first", "_before")
    )
