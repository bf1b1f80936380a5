"""A persistent store that is its own search index.

Entries lie in the files of their cell, a ring around the nearest of a few pivots (see ``operators.cells``), and not
in a folder for each collection: the number of files does not depend on the number of collections, and
a lookup opens only the cells that may hold a match. Inside a cell rows are sorted by collection, so that
statistics of the files leave out other collections.

    model/generation=G             pivots, the edges of their rings, the metric
    entries/generation=G/batch=N   entries by cell, with their distance from the pivot
    spans/generation=G/batch=N     what each cell of the batch holds
    sizes/generation=G/batch=N     dimensions and the highest id number of each collection; marks the batch as whole
    touches/batch=N, deletes/batch=N, as in the plain store

A batch is written under the pivots that are there, so nothing is built anew when entries arrive; pivots come from
the first batch. ``fold`` writes the current entries under new pivots as a next generation, which becomes the one that is read when its
model is there; batches go on after it, so a stream may run on. Old generations stay on disk for readers that have begun.

The result of a lookup is that of comparing with all entries. Writing batch N again replaces it. There is one
writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocache import schema as S
from echocache.operators import blockjoin, cells
from echocache.operators import entries as E
from echocache.operators.lookup import with_texts
from echocache.scratch import materialize
from echocache.sources.store import CacheStore

#: Entries for each pivot when a generation is made, and the most pivots.
ENTRIES_PER_PIVOT, MAX_PIVOTS = 1_024, 1_024

_HELD = T.StructType([
    *S.ENTRY.fields, T.StructField("gap", T.DoubleType()), T.StructField("error", T.DoubleType()),
])
_PLACES = [T.StructField(n, T.LongType()) for n in ("generation", "batch")]
_SPANS = T.StructType([T.StructField("cell", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in "abe")])
_SIZES = T.StructType([
    T.StructField("collection", T.StringType()), T.StructField("low", T.IntegerType()),
    T.StructField("high", T.IntegerType()), T.StructField("base", T.LongType()),
])


@dataclass(frozen=True)
class Model:
    """Pivots of a generation, ring edges by pivot, and the last batch that was folded into it."""

    generation: int
    pivots: cells.Pivots
    edges: dict[int, list[float]]
    folded: int | None

    def cell(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, distance from its pivot and the error of that, squared, of each row."""
        pivot, gap, wrong = cells.measured(self.pivots, vectors)
        ring = np.array([np.searchsorted(self.edges.get(int(p), ()), g) for p, g in zip(pivot, gap)], int)
        return np.where(pivot < 0, pivot, pivot * cells.RINGS + ring), gap, wrong


class ClusteredStore(CacheStore):
    """Open-or-create; ``metric`` is that of the lookups."""

    def __init__(self, spark: SparkSession, path: str, collection: str | None = None, metric: str = "cosine"):
        super().__init__(spark, path, collection)
        self.metric = S.check_metric(metric)

    # Reading

    def _table(self, name: str, fields: T.StructType, *places: T.StructField) -> DataFrame:
        full = T.StructType([*fields.fields, *places])
        try:
            return self.spark.read.schema(full).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def model(self) -> Model | None:
        """The newest generation; at most ``MAX_PIVOTS`` vectors come to the driver."""
        fields = T.StructType([
            T.StructField("number", T.IntegerType()), T.StructField("vector", S.VECTOR),
            T.StructField("edges", S.VECTOR), T.StructField("metric", T.StringType()), T.StructField("folded", T.LongType()),
        ])
        rows = self._table("model", fields, _PLACES[0])
        newest = rows.agg(F.max("generation")).first()[0]
        if newest is None:
            return None
        found = rows.where(F.col("generation") == newest).collect()
        if {r.metric for r in found} != {self.metric}:
            raise ValueError(f"the store was made for metric '{found[0].metric}', not '{self.metric}'")
        listed = sorted((r for r in found if r.vector), key=lambda r: r.number)
        edges = {r.number: list(r.edges) for r in listed if r.edges}
        return Model(newest, cells.Pivots([list(r.vector) for r in listed], self.metric), edges, found[0].folded)

    def _batches(self, model: Model, before: int | None) -> list[int]:
        """Whole batches of a generation, found by the names of their folders."""
        if before is not None and model.folded is not None and before <= model.folded:
            raise ValueError(f"batches up to {model.folded} were folded; the state before batch {before} is gone")
        rows = self._table("sizes", _SIZES, *_PLACES).where(F.col("generation") == model.generation)
        found = [r.batch for r in rows.select("batch").distinct().collect()]
        return [n for n in found if before is None or n < before]

    def _part(self, name: str, fields: T.StructType, model: Model, before: int | None, *more: T.StructField) -> DataFrame:
        rows = self._table(name, fields, *_PLACES, *more)
        return rows.where((F.col("generation") == model.generation) & F.col("batch").isin(self._batches(model, before)))

    def _held(self, before: int | None = None, some: list[int] | None = None) -> DataFrame:
        """Entries with their cell, as stored; only those of ``some`` cells are opened."""
        places = [*_PLACES, T.StructField("cell", T.IntegerType())]
        model = self.model()
        if model is None:
            return self._table("none", _HELD, *places)
        rows = self._part("entries", _HELD, model, before, places[-1])
        if self.collection is not None:
            rows = rows.where(F.col("collection") == self.collection)
        return rows if some is None else rows.where(F.col("cell").isin(some))

    def stored(self, before: int | None = None) -> DataFrame:
        """Every entry stored since the last fold, and what that kept."""
        return self._held(before).select(*S.ENTRY.fieldNames())

    def issued(self, before: int | None = None) -> DataFrame:
        """Highest entry number per collection, evicted entries included; reads no entries."""
        model = self.model()
        if model is None:
            return self.spark.createDataFrame([], "collection string, base long")
        rows = self._part("sizes", _SIZES, model, before).where("base IS NOT NULL")
        if self.collection is not None:
            rows = rows.where(F.col("collection") == self.collection)
        return rows.groupBy("collection").agg(F.max("base").alias("base"))

    # Writing

    def _new_model(self, rows: DataFrame, generation: int, folded: int | None) -> Model:
        """Pivots and ring edges from ``rows``, written down by ``_publish``."""
        n = rows.count()
        wanted = min(MAX_PIVOTS, max(8, n // ENTRIES_PER_PIVOT))
        pivots = cells.Pivots(rows.select("collection", "seq", "vector"), self.metric, wanted if n else 0, n)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pivot, gap, _ = cells.measured(pivots, batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int32()), pa.array(gap)], ["pivot", "gap"])

        placed = rows.select("vector").mapInArrow(measure, "pivot int, gap double")
        edges = {r.pivot: sorted(r.edges) for r in cells.ring_edges(placed).collect()}
        return Model(generation, pivots, edges, folded)

    def _publish(self, model: Model) -> None:
        """From now on readers see this generation."""
        rows = [(i, v, model.edges.get(i), self.metric, model.folded) for i, v in enumerate(model.pivots.vectors)]
        rows = rows or [(0, None, None, self.metric, model.folded)]
        ddl = "number int, vector array<double>, edges array<double>, metric string, folded long"
        frame = self.spark.createDataFrame(rows, ddl).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/model/generation={model.generation}")

    def _place(self, rows: DataFrame, model: Model, batch: int, base: DataFrame | None = None) -> None:
        """Write a batch: entries, what cells hold, and at last the sizes, which make it count."""
        at = f"generation={model.generation}/batch={int(batch)}"

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                cell, gap, wrong = model.cell(part.column(part.schema.get_field_index("vector")))
                more = [pa.array(gap), pa.array(wrong), pa.array(cell, pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "gap", "error", "cell"])

        schema = T.StructType([*_HELD.fields, T.StructField("cell", T.IntegerType())])
        placed = rows.select(*S.ENTRY.fieldNames()).mapInArrow(assign, schema).hint("rebalance", "cell")
        placed = placed.sortWithinPartitions("cell", "collection", "seq")
        placed.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/entries/{at}")
        try:
            written = self.spark.read.schema(schema).parquet(f"{self.path}/entries/{at}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            written = self.spark.createDataFrame([], schema)
        spans = written.groupBy("cell").agg(F.min("gap").alias("a"), F.max("gap").alias("b"), F.max("error").alias("e"))
        spans.write.mode("overwrite").parquet(f"{self.path}/spans/{at}")
        size = F.size("vector")
        sizes = written.groupBy("collection").agg(F.min(size).alias("low"), F.max(size).alias("high"))
        sizes = sizes.join(E.issued_ids(written), "collection")
        if base is not None:  # numbers of entries that are gone stay taken
            sizes = sizes.withColumnRenamed("base", "own").join(base, "collection", "full")
            sizes = sizes.withColumn("base", F.greatest("own", "base"))
        sizes = sizes.select(*(F.col(f.name).cast(f.dataType) for f in _SIZES.fields))
        # One row without a collection, so that a batch without entries is whole too.
        none = self.spark.createDataFrame([(None, None, None, None)], _SIZES)
        sizes.union(none).hint("rebalance", "collection").sortWithinPartitions("collection").write.mode(
            "overwrite"
        ).parquet(f"{self.path}/sizes/{at}")

    def append(self, new: DataFrame, batch: int) -> None:
        rows = new.select(*S.ENTRY.fieldNames())
        model = self.model()
        if model is None:
            rows = materialize(rows, "first")
            model = self._new_model(rows, 0, None)
            self._place(rows, model, batch)
            self._publish(model)
        else:
            if model.folded is not None and batch <= model.folded:
                raise ValueError(f"batch {batch} was folded already")
            self._place(rows, model, batch)

    def fold(self, through: int) -> None:
        """Write the current entries under new pivots as one batch, numbered ``through``, the last batch so far."""
        model = self.model()
        if model is None:
            return
        if (last := max(self._batches(model, None), default=through)) > through:
            raise ValueError(f"batch {last} is after batch {through}")
        whole = ClusteredStore(self.spark, self.path, metric=self.metric)
        rows, base = materialize(whole.entries(), "folded"), materialize(whole.issued(), "issued")
        new = self._new_model(rows, model.generation + 1, None)
        new = Model(new.generation, new.pivots, new.edges, through)
        self._place(rows, new, through, base)
        self._publish(new)

    # Looking up

    def visits(self, requests: DataFrame, threshold: float, before: int | None = None) -> tuple[DataFrame, list[int]]:
        """The requests with their ``reach``, and the list of all cells that some of them has to look at."""
        return self._visits(requests, threshold, before)[:2]

    def _visits(self, requests: DataFrame, threshold: float, before: int | None) -> tuple[DataFrame, list[int], cells.Index]:
        model = self.model()
        if model is None:
            return self.spark.createDataFrame([], cells.ASKED_DDL), [], cells.Index(cells.Pivots([], self.metric), {})
        spans = self._part("spans", _SPANS, model, before)
        spans = spans.groupBy("cell").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("e").alias("e"))
        index = cells.Index(model.pivots, cells.ranges(spans))
        sizes = self._part("sizes", _SIZES, model, before).groupBy("collection").agg(
            F.min("low").alias("low"), F.max("high").alias("high")
        )
        size = F.size("vector")
        same = (size == F.col("low")) & (size == F.col("high"))
        uneven = F.raise_error(F.lit(S.VECTOR_DIMENSION)).cast(S.VECTOR)
        asked = requests.select(
            F.col("collection").cast("string").alias("collection"), F.col("request_id").cast("string").alias("request_id"),
            F.col("seq").cast("long").alias("seq"), F.col("vector").cast(S.VECTOR).alias("vector"),
        )
        asked = asked.join(sizes.where("low IS NOT NULL"), "collection").withColumn("vector", F.when(same, F.col("vector")).otherwise(uneven))
        if self.collection is not None:
            asked = asked.where(F.col("collection") == self.collection)
        reach = F.lit(cells.radius(threshold, self.metric))
        found = materialize(asked.withColumn("reach", reach).select(*cells.ASKED), "asked")
        return found, cells.any_looks_at(found, index), index

    def _current(self, some: list[int], before: int | None) -> DataFrame:
        return E.delete(self._held(before, some), self._read("deletes", S.KEY, before))

    def nearest(
        self, requests: DataFrame, threshold: float = S.DEFAULT_THRESHOLD, earlier: bool = False,
        before: int | None = None, block_rows: int = blockjoin.BLOCK_ROWS,
    ) -> DataFrame:
        """``operators.lookup.nearest`` over the current entries, of which it opens the visited cells only.

        ``earlier`` allows only entries with a smaller ``seq`` than the request; ``before`` is a batch.
        """
        S.check_threshold(threshold)
        found, some, index = self._visits(requests, threshold, before)
        return self._best(found, self._current(some, before), index, threshold, earlier, block_rows)

    def _best(
        self, found: DataFrame, held: DataFrame, index: cells.Index, threshold: float, earlier: bool, block_rows: int
    ) -> DataFrame:
        held = held.select("collection", "seq", F.col("vector").cast(S.VECTOR).alias("vector"), "cell", "gap", "error")
        floor = blockjoin.closeness_floor(threshold, self.metric)
        best = blockjoin.best_in_parts(found, held, index, self.metric, 1, floor, earlier, block_rows)
        score: Column = blockjoin.closeness_to_score(F.col("closeness"), self.metric)
        return best.withColumn("score", score).drop("closeness")

    def lookup(
        self, requests: DataFrame, threshold: float = S.DEFAULT_THRESHOLD, before: int | None = None,
        block_rows: int = blockjoin.BLOCK_ROWS,
    ) -> DataFrame:
        """``operators.lookup.lookup`` over the current entries: one row per request, texts from the visited cells."""
        S.check_threshold(threshold)
        found, some, index = self._visits(requests, threshold, before)
        held = self._current(some, before)
        best = materialize(self._best(found, held, index, threshold, False, block_rows), "best")
        return with_texts(requests, held, best)
