"""SimHash near-duplicates by ball hashing that meets in the middle.

Two fingerprints at most ``2 r`` bits apart have a number between them that is at most r bits from
each. So every distinct fingerprint stands for all its variants within r bits, and fingerprints that
share a variant are linked. A 64-bit fingerprint has 2,081 variants within two bits. They are
shuffled by their leading bits: a fingerprint is sent once to each prefix that one of its variants
has (29 for seven bits), and the variants with that prefix are made where they are compared. The
number of leading bits follows from the number of fingerprints, so that a group has a bounded number
of variants; a group that is larger, because fingerprints crowd, works through longer prefixes one
by one. Inside a group variants are sorted, equal ones give links, the links are checked by their
bit distance and thinned to one tree for each set of linked fingerprints.

Equal fingerprints are one fingerprint from the start, so thousands of copies cost what one does.

Defined results: a text without words, or null, has fingerprint zero and links like any other;
repeated rows are in one component; a null document number is a document that can be linked but
never names a component unless all its documents have none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocache.llm.bpe import extended, slices
from echocache.llm.components import components
from echocache.scratch import materialize

SHINGLE, MAX_DISTANCE, SEED = 4, 4, 42
#: Variants that a group should have, and how many of them are held at a time.
GROUP_VARIANTS, HELD_VARIANTS = 4_000_000, 6_000_000
#: Shingles whose bits are added up at a time.
BLOCK = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the shingles' hashes; a tie is 0."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII spaces
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    begins, ends = starts[:n].tolist(), (starts[min(shingle, len(words)) :][:n] - 1).tolist()
    hashed, sums = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = [
            hashed(joined[a:b], SEED)
            for a, b in zip(begins[at : at + BLOCK], ends[at : at + BLOCK])
        ]
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(
    df: DataFrame, *, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE, drop: tuple = ()
) -> DataFrame:
    """Add ``out``, the fingerprint as a signed 64-bit number; ``drop`` columns are not returned."""
    schema = extended(df.drop(*drop), {out: T.LongType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = batch.column(batch.schema.get_field_index(text))
            values = np.array([simhash(x.as_py(), shingle) for x in found], np.uint64).view(np.int64)
            kept = batch.drop_columns(list(drop)) if drop else batch
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(values)], [*kept.schema.names, out])

    return df.mapInArrow(run, schema)


def masks(bits: int, flips: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``flips`` of them set."""
    found = [sum(1 << i for i in x) for k in range(flips + 1) for x in combinations(range(bits), k)]
    return np.array(found, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers, so that high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` is linked with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        if not open_.any():
            break
        a, b = label[a[open_]], label[b[open_]]
    return label


def _collide(values: np.ndarray, prefix: int, bits: int, radius: int, reach: int) -> Iterator[tuple]:
    """Indices of values that share a variant whose leading ``bits`` are ``prefix``."""
    apart = np.bitwise_count((values >> np.uint64(64 - bits)) ^ np.uint64(prefix)) if bits else np.zeros(len(values), np.uint8)
    sizes = [sum(math.comb(64 - bits, k) for k in range(radius - d + 1)) for d in range(radius + 1)]
    near = apart <= radius
    total = sum(int((apart == d).sum()) * sizes[d] for d in range(radius + 1))
    if total > HELD_VARIANTS and bits < 60 and near.sum() > 1:
        some = np.flatnonzero(near)
        for longer in (2 * prefix, 2 * prefix + 1):
            for a, b in _collide(values[some], longer, bits + 1, radius, reach):
                yield some[a], some[b]
        return
    low = np.uint64((1 << (64 - bits)) - 1)
    variants, owners = [], []
    for d in range(radius + 1):
        at = np.flatnonzero(apart == d)
        if len(at):
            flips = masks(64 - bits, radius - d)
            variants.append(((values[at] & low)[:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(at.astype(np.uint64), len(flips)))
    if not variants:
        return
    width = np.uint64(max(1, int(len(values) - 1).bit_length()))
    packed = _mixed(np.concatenate(variants))
    packed = np.sort((packed >> width << width) | np.concatenate(owners))
    owner = (packed & np.uint64((1 << int(width)) - 1)).astype(np.int64)
    same = (packed[1:] >> width) == (packed[:-1] >> width)
    if not same.any():
        return
    a, b = owner[:-1][same], owner[1:][same]
    good = np.bitwise_count(values[a] ^ values[b]) <= reach
    yield a[good], b[good]
    if not good.all():  # different variants met in one scrambled prefix: compare all of that run
        run = np.cumsum(np.concatenate([[True], ~same]))
        for r in np.unique(run[1:][same][~good]):
            members = np.unique(owner[run == r])
            i, j = np.triu_indices(len(members), 1)
            i, j = members[i], members[j]
            good = np.bitwise_count(values[i] ^ values[j]) <= reach
            yield i[good], j[good]


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) between numbers of the one column of ``distinct`` that connect all near ones."""
    (name,) = distinct.columns
    radius = -(-max_distance // 2)
    ball = sum(math.comb(64, k) for k in range(radius + 1))
    bits = min(24, max(1, math.ceil(math.log2(max(1, distinct.count()) * ball / GROUP_VARIANTS + 1e-9))))
    flips = F.array(*(F.lit(int(x)) for x in masks(bits, radius)))
    prefix = F.shiftrightunsigned(name, 64 - bits)
    sent = distinct.select(
        F.col(name).alias("value"), F.explode(F.transform(flips, lambda m: prefix.bitwiseXOR(m))).alias("prefix")
    )

    def run(keys: tuple, group: pa.Table) -> pa.Table:
        values = np.unique(group.column("value").to_numpy().view(np.uint64))
        a, b = [], []
        for i, j in _collide(values, keys[0].as_py(), bits, radius, max_distance):
            label = _forest(len(values), np.concatenate([*a, i]), np.concatenate([*b, j]))
            a = [np.flatnonzero(label != np.arange(len(values)))]
            b = [label[a[0]]]
        pick = lambda x: values[x[0] if x else []].view(np.int64)
        return pa.table({"a": pick(a), "b": pick(b)})

    groups = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return (
        sent.repartition(max(groups, min(1 << bits, 4096)), "prefix")
        .groupBy("prefix")
        .applyInArrow(run, "a long, b long")
        .distinct()
    )


def _classes(docs: DataFrame, max_distance: int) -> DataFrame:
    """``fingerprint`` and ``class``, the number of its component, of all fingerprints in ``docs``."""
    known = materialize(docs.select("fingerprint").distinct(), "distinct")
    found = components(links(known, max_distance))
    return known.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("class")
    )


def near_duplicates(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """``key``, ``fingerprint`` and ``component_id``, the least key of the linked documents."""
    docs = materialize(
        fingerprints(df.select(F.col(key).alias("key"), F.col(text).alias("text")), shingle=shingle, drop=("text",)),
        "fingerprints",
    )
    least = docs.groupBy("fingerprint").agg(F.min("key").alias("least"))
    classes = materialize(_classes(docs, max_distance).join(least, "fingerprint"), "classes")
    named = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = materialize(classes.join(named, "class").select("fingerprint", "component_id"), "named")
    return docs.join(named, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def without_near_duplicates(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row of ``df`` of each set of linked documents: that of the least key, nulls last.

    Of several such rows the one whose text has the least hash stays, of equal ones any.
    """
    key_of = lambda c: F.coalesce(F.col(c).cast("long"), F.lit((1 << 63) - 1))
    version_of = lambda c: F.xxhash64(F.coalesce(F.col(c), F.lit("")))
    rows = df.select(key_of(key).alias("key"), version_of(text).alias("version"), F.col(text).alias("text"))
    docs = materialize(fingerprints(rows, shingle=shingle, drop=("text",)), "fingerprints")
    least = docs.groupBy("fingerprint").agg(F.min(F.struct("key", "version")).alias("least"))
    stays = (
        _classes(docs, max_distance).join(least, "fingerprint")
        .groupBy("class").agg(F.min("least").alias("stays"))
        .select("stays.key", "stays.version")
    )
    stays = materialize(stays, "stays")
    rows = df.select(
        F.struct("*").alias("row"), key_of(key).alias("key"), version_of(text).alias("version")
    )
    return rows.join(stays, ["key", "version"]).dropDuplicates(["key", "version"]).select("row.*")
