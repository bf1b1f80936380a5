"""A persistent set of collections as append-only parquet tables.

``entries/batch=N/collection=…`` holds stored entries, ``touches/batch=N`` the accesses of batch
N and ``deletes/batch=N`` the evicted keys. Nothing is rewritten to record an access or an eviction; the current
state is a join. Writing batch N again replaces it, so a retried batch is stored once.
``compact`` writes the current state to another path.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocache import schema as S
from echocache.operators import entries as E

_BATCH = T.StructField("batch", T.LongType())


class CacheStore:
    """Open-or-create; ``collection`` restricts reads to one named collection."""

    def __init__(self, spark: SparkSession, path: str, collection: str | None = None):
        self.spark = spark
        self.path = S.check_text(path, "persist_path").rstrip("/")
        self.collection = collection
        if collection is not None:
            S.check_text(collection, "collection_name")

    def _read(self, table: str, fields: T.StructType, before: int | None) -> DataFrame:
        full = T.StructType([*fields.fields, _BATCH])
        try:
            rows = self.spark.read.schema(full).parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], full)
        if self.collection is not None:
            rows = rows.where(F.col("collection") == self.collection)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return rows.select(*fields.fieldNames())

    def _write(self, table: str, rows: DataFrame, batch: int, partition: str | None = None) -> None:
        writer = rows.hint("rebalance", "collection").write.mode("overwrite")
        if partition:
            writer = writer.partitionBy(partition)
        writer.parquet(f"{self.path}/{table}/batch={int(batch)}")

    def stored(self, before: int | None = None) -> DataFrame:
        """Every entry ever stored, as stored."""
        return self._read("entries", S.ENTRY, before)

    def entries(self, before: int | None = None) -> DataFrame:
        """Current entries; with ``before``, as they were before that batch."""
        touched = self._read("touches", S.TOUCH, before)
        gone = self._read("deletes", S.KEY, before)
        hits = touched.withColumnsRenamed({"seq": "entry_seq", "touched_at": "ts"})
        return E.touch(E.delete(self.stored(before), gone), hits)

    def issued(self, before: int | None = None) -> DataFrame:
        """Highest entry number per collection, evicted entries included."""
        return E.issued_ids(self.stored(before))

    def append(self, new: DataFrame, batch: int) -> None:
        rows = new.select(*S.ENTRY.fieldNames())
        self._write("entries", rows, batch, partition="collection")

    def touch(self, hits: DataFrame, batch: int) -> None:
        """Record accesses from rows with collection, entry_seq, ts."""
        self._write("touches", E.touches(hits), batch)

    def delete(self, victims: DataFrame, batch: int) -> None:
        self._write("deletes", victims.select("collection", "seq"), batch)

    def compact(self, path: str, batch: int = 0) -> CacheStore:
        """Write the current entries to a new path and return the store there."""
        if path.rstrip("/") == self.path:
            raise ValueError("compact needs another path: the current one is being read")
        target = CacheStore(self.spark, path, self.collection)
        target.append(self.entries(), batch)
        return target
