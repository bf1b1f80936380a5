"""The given tables, and what the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the control characters from tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return found.select(*columns) if columns else found


def words(text: Column) -> Column:
    """Runs of other characters than spaces; none in a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Schema of arrays of numbers that are added up, as bytes, and how many of them come to the driver.
SUMS, LAST = "sums binary", 4


def total_batch(parts: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row with the sum of all arrays; none without arrays."""
    total = None
    for x in parts:
        total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def summed(parts: DataFrame, kind: type) -> np.ndarray | None:
    """The sum of all arrays of ``kind`` in a table of ``SUMS``; None of no rows.

    Each step of shuffles leaves an eighth of the arrays, so no task gets more of them as the table grows.
    """

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from total_batch(np.frombuffer(x.as_py(), kind) for b in batches for x in b.column(0))

    n = 8 * max(LAST, partitions(parts.sparkSession))
    while n > LAST:
        n = max(LAST, n // 8)
        parts = parts.repartition(n).mapInArrow(again, SUMS)
    found = [np.frombuffer(r.sums, kind) for r in parts.collect()]
    return sum(found[1:], found[0]) if found else None
