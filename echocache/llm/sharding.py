"""Shards of near equal bytes from sampled splitters.

A size-weighted sample of records gives quantile boundaries, and every record goes to the range
between two boundaries that holds it. Boundaries are whole records (key, hash of the other columns,
number), so a key that a third of all records share is cut like any other. The sample only shapes
the ranges: their records and bytes are then counted exactly, and an overfull range is subdivided by
splitters sampled inside it, until none is left. In a range, which so has a bounded share of the
records, a window numbers them and sums their sizes; the totals of the ranges before, one pair for
each range, make these places in the order of all records. The shard of a record is where its first
byte falls when all bytes are cut into equal parts, so shards differ by less than one record's size,
and each is one stretch of the key order.

The operator is meant for keys and sizes, not for the texts themselves: it writes its narrow input
down once, as the numbers of equal records must not change between passes.

Defined results: a null key sorts first, a null size counts as 0; records of one key are ordered by
a hash of their other columns, and wholly equal ones in any order; an empty table has no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echocache.scratch import materialize

#: Records and bytes aimed at in a range, the most ranges, samples for each, rounds of subdividing.
RANGE_ROWS, RANGE_BYTES, MAX_RANGES, SAMPLED, ROUNDS = 20_000, 1 << 36, 16_384, 32, 8

Cut = tuple[int, int, int]


def _range(cuts: list[Cut]) -> Column:
    """How many boundaries are at or below a record: by coarse steps, then by fine ones."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    record = F.struct("key", "tie", "number")

    def below(listed: list[Cut]) -> Column:
        rows = [{"key": k, "tie": t, "number": u} for k, t, u in listed]
        return F.from_json(
            F.lit(json.dumps(rows)), "array<struct<key: bigint, tie: bigint, number: bigint>>"
        )

    coarse = F.size(F.filter(below(cuts[step - 1 :: step]), lambda c: c <= record)) * step
    fine = F.filter(F.slice(below(cuts), coarse + 1, F.lit(step)), lambda c: c <= record)
    return coarse + F.size(fine)


def _held(rows: DataFrame, cuts: list[Cut]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The rows with their range, and the records and bytes of each range."""
    ranged = rows.withColumn("range", _range(cuts))
    sums = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return ranged, {r.range: (r.n, r.bytes) for r in sums.collect()}


def _sample(ranged: DataFrame, wanted: dict[int, int], n_bytes: int, seed: int) -> list[Cut]:
    """Boundaries inside the ranges of ``wanted``, each into that many parts of equal bytes.

    The chance of a record grows with its size: it is drawn if log(u) / size, with u from a hash, is above
    a cut that follows from the bytes of the ranges. At most four times ``MAX_RANGES * SAMPLED`` records are to be
    expected; each task sends only those it has drawn.
    """
    unit = (F.pmod(F.xxhash64("tie", "number", F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
    draw = F.log(unit) / F.greatest("size", F.lit(1))
    n = min(sum(wanted.values()), MAX_RANGES) * SAMPLED
    drawn = (
        ranged.where(F.col("range").isin(list(wanted)) & (draw > -4 * n / max(1, n_bytes)))
        .select("range", "key", "tie", "number")
        .collect()
    )
    cuts = []
    for at, parts in wanted.items():
        found = sorted((r.key, r.tie, r.number) for r in drawn if r.range == at)
        cuts += [found[len(found) * i // parts] for i in range(1, parts) if len(found) > 1]
    return cuts


def assign(
    df: DataFrame, n_shards: int, *, key: str, size: str, range_rows: int = RANGE_ROWS, seed: int = 0
) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (0, 1, … in each shard).

    ``key`` is an integer column to keep in order, ``size`` what to balance.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    taken = {c.lower() for c in df.columns}
    if clash := [c for c in ("shard", "slot") if c in taken]:
        raise ValueError(f"columns {clash} exist already; rename them first")
    others = [F.col("row")[c] for c in df.columns if c != key] or [F.lit(0)]
    least = -(1 << 63)  # a null key sorts first
    rows = materialize(
        df.select(F.struct("*").alias("row")).select(
            "row",
            F.coalesce(F.col("row")[key].cast("long"), F.lit(least)).alias("key"),
            F.coalesce(F.col("row")[size].cast("long"), F.lit(0)).alias("size"),
            F.xxhash64(*others).alias("tie"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "records",
    )
    cuts: list[Cut] = []
    for turn in range(ROUNDS):
        ranged, held = _held(rows, cuts)
        n_rows, n_bytes = (sum(x) for x in zip((0, 0), *held.values()))
        row_share = max(range_rows, -(-n_rows // MAX_RANGES))
        byte_share = max(1, min(RANGE_BYTES, -(-n_bytes // n_shards)), -(-n_bytes // MAX_RANGES))
        full = {at: max(-(-n // row_share), -(-b // byte_share)) for at, (n, b) in held.items() if n > 1}
        wanted = {at: 2 * parts for at, parts in full.items() if parts > (2 if turn else 1)}
        mass = sum(max(held[at]) for at in wanted)
        more = _sample(ranged, wanted, mass, seed + turn) if wanted else []
        if not set(more) - set(cuts):
            break
        cuts = sorted({*cuts, *more})
    else:
        ranged, held = _held(rows, cuts)

    before, at_row, at_byte = [], 0, 0
    for at in range(len(cuts) + 1):
        before.append({"n": at_row, "bytes": at_byte})
        n, b = held.get(at, (0, 0))
        at_row, at_byte = at_row + n, at_byte + b
    offsets = F.get(
        F.from_json(F.lit(json.dumps(before)), "array<struct<n: bigint, bytes: bigint>>"), F.col("range")
    )
    inside = Window.partitionBy("range").orderBy("key", "tie", "number")
    earlier = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = (earlier + offsets["bytes"]).cast("decimal(38,0)")
    part = F.expr(f"CAST(first * {n_shards} DIV CAST({max(1, at_byte)} AS DECIMAL(38,0)) AS INT)")
    placed = materialize(
        ranged.withColumn("first", first)
        .withColumn("place", F.row_number().over(inside) - 1 + offsets["n"])
        .select("row", "place", F.least(part, F.lit(n_shards - 1)).alias("shard")),
        "placed",
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "row.*", "shard", (F.col("place") - F.col("start")).alias("slot")
    )
