"""Connected components of links between numbers, as joins and aggregations.

Two steps alternate. In the first every node tells its larger neighbours about the least node next
to it; in the second every node tells its smaller neighbours. Components shrink to stars around their
least node in a number of rounds that grows with the logarithm of their size; after each round the
links are written down, so that plans stay short and lost executors cost one round. Minima are
combined before the shuffle, and a node with very many links is the large side of a join whose
other side has one row for it, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocache.scratch import materialize


def _outward(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _inward(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node it is linked with, for every linked node but it.

    ``links`` has two columns of numbers; links of a node with itself, repeated and null ones do
    no harm. Nodes that are the least of their component, or have no link, are not in the result.
    """
    a, b = links.columns
    links = (
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    )
    links = materialize(links, "links")
    state = None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
        links = _inward(_outward(links).where("a <> b").distinct())
        links = materialize(
            links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
            "links",
        )
