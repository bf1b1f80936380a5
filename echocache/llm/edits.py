"""Document fingerprints by a randomised edit embedding.

A shared random walk turns a text into a longer string: at step j the walk writes down the character
it stands on and then moves on or stays, by a random bit that depends on j and the character only.
Two texts walk in step until they differ; after an edit their walks are likely to meet again, so a
small edit distance becomes a small Hamming distance. The walk ends when the text does, after about
twice its length.

Of the embedded string only sampled places are kept, four bits of the character's hash for each. The
places are the same for all texts: the first 32, and 32 spread over each following stretch that is
as long as everything before it. So a text of any length has a short fingerprint, one block of 128
bits for each stretch that it reaches, and texts of different lengths can be compared. The likeness
of two fingerprints weighs each stretch by its length, up to the longer text.

Walks of many texts go on together as arrays, longest texts first, so that a step costs a few
nanoseconds for each text.

Near texts: a quarter of a block is a band. Texts with an equal band in one of the last three
stretches that they reach are candidates, and candidates of enough likeness are linked; see
``buckets.linked`` for how a bucket of any size is gone through.

Defined results: a null text is empty; the empty text has an empty fingerprint; likeness is 1 for
two empty texts and 0 if only one is empty; repeated rows follow one another in the order of their
texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocache.llm.bpe import slices
from echocache.llm.buckets import linked
from echocache.llm.tables import partitions
from echocache.scratch import materialize

#: Samples of a stretch, and the longest walk whose steps' random bits are made at a time.
SAMPLES, STEPS = 32, 4_096
#: Characters whose walks go on together, at most, beside one longer text.
HELD_CHARS = 12_000_000
#: Likeness from which two texts are near, rows aimed at in a stretch of keys, and the most stretches.
NEAR, STRETCH_ROWS, MAX_STRETCHES = 0.8, 4_000, 4_096
#: Samples of a band, and the last stretches that have bands.
BAND, BANDED = 8, 3


def _hash(*numbers: np.ndarray | int) -> np.ndarray:
    """A fixed scramble of 64-bit numbers."""
    x = np.uint64(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for n in numbers:
            x = (x ^ np.asarray(n, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(27))
    return x


def stretch(block: int) -> tuple[int, int]:
    """First step and length of a stretch."""
    return (0, SAMPLES) if block == 0 else (SAMPLES << (block - 1), SAMPLES << (block - 1))


def sampled(block: int, seed: int) -> np.ndarray:
    """The steps of a stretch that are kept, one in each of 32 equal parts."""
    first, length = stretch(block)
    part = length // SAMPLES
    at = np.arange(SAMPLES)
    return first + at * part + (_hash(seed, 1, block, at) % np.uint64(part)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    """Characters as numbers from 1 to 255; 0 is the end of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    return (1 + _hash(2, points) % np.uint64(255)).astype(np.uint8)


def embed(texts: list[str], seed: int = 0) -> list[bytes]:
    """Fingerprints: for each stretch reached, 32 samples of a byte each (0 for none, else 1 to 16)."""
    codes = [_codes(x) for x in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(codes[i]))
    order = [i for i in order if len(codes[i])]
    out: list[list[bytes]] = [[] for _ in texts]
    if order:
        flat = np.concatenate([np.append(codes[i], np.uint8(0)) for i in order])
        at = np.concatenate([[0], np.cumsum([len(codes[i]) + 1 for i in order])])[:-1].astype(np.int64)
        walkers = np.array(order)
        block, step, made = 0, 0, -STEPS
        alphabet = np.arange(256)
        label = (1 + _hash(seed, 3, alphabet) % np.uint64(16)).astype(np.uint8)
        label[0] = 0
        kept = np.zeros((SAMPLES, len(walkers)), np.uint8)
        places = sampled(0, seed).tolist()
        row = 0
        here = np.empty(len(walkers), np.uint8)
        moves = np.empty(len(walkers), np.uint8)
        while len(walkers):
            if step >= made + STEPS:
                made = step
                bits = _hash(seed, 4, np.arange(step, step + STEPS)[:, None], alphabet[None, :])
                table = ((bits >> np.uint64(40)) & np.uint64(1)).astype(np.uint8)
                table[:, 0] = 0  # nobody walks past the end
            np.take(flat, at, out=here)
            if row < SAMPLES and step == places[row]:
                kept[row] = label[here]
                row += 1
            np.take(table[step - made], here, out=moves)
            at += moves
            step += 1
            first, length = stretch(block)
            if step == first + length:
                for k, i in enumerate(walkers.tolist()):
                    out[i].append(kept[:, k].tobytes())
                going = flat[at] != 0
                at, walkers = at[going], walkers[going]
                here, moves = here[: len(at)].copy(), moves[: len(at)].copy()
                block, row = block + 1, 0
                places = sampled(block, seed).tolist()
                kept = np.zeros((SAMPLES, len(walkers)), np.uint8)
    return [b"".join(x) for x in out]


_DIGITS = np.frombuffer(b".0123456789abcdef", np.uint8)


def packed(fingerprint: np.ndarray) -> str:
    """A hexadecimal digit for each sample, and ``.`` for those after the end of the text."""
    return _DIGITS[fingerprint].tobytes().decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of steps of the longer walk at which both stand on like characters, by the samples."""
    n = max(len(a), len(b))
    if n == 0:
        return 1.0
    a, b = (np.pad(x, (0, n - len(x))) for x in (a, b))
    weight = np.repeat([stretch(k)[1] / SAMPLES for k in range(n // SAMPLES)], SAMPLES)
    walked = (a != 0) | (b != 0)
    return float(weight[walked & (a == b)].sum() / weight[walked].sum())


def unpacked(text: str) -> np.ndarray:
    """The samples of a packed fingerprint."""
    digits = np.frombuffer(text.encode(), np.uint8).astype(np.int16)
    return np.where(digits == 46, 0, np.where(digits >= 97, digits - 86, digits - 47)).astype(np.uint8)


def edited_text(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def beside_next(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """``at`` (a stretch of keys), ``ghost``, ``key`` and ``text``, each stretch sorted in one partition.

    The first row of a stretch is also, as a ghost, the last of the stretch before, and the first of
    all the last of the last. So every row has the next one behind it after one shuffle of the
    texts, which goes by quantiles of the keys. Quantiles are read from the keys alone.
    """
    ids = df.select(F.col(key).cast("long").alias("key"))
    seen = ids.agg(F.count("*"), F.min("key"), F.count_if(F.col("key").isNull())).first()
    n = min(MAX_STRETCHES, max(partitions(df.sparkSession), seen[0] // STRETCH_ROWS, 1))
    cuts = []
    if seen[1] is not None and n > 1:
        parts = [i / n for i in range(1, n)]
        found = ids.agg(F.percentile_approx("key", parts, 10 * n)).first()[0]
        cuts = sorted({k for k in found if k > seen[1]})
    every = F.from_json(F.lit(str(cuts)), "array<bigint>")
    at = F.when(F.col("key").isNull(), 0).otherwise(F.size(F.filter(every, lambda c: c <= F.col("key"))))
    first = F.col("key").isNull() if seen[2] else F.col("key").eqNullSafe(F.lit(seen[1]))
    head = (F.col("at") > 0) & (F.get(every, F.col("at") - 1) == F.col("key"))
    copy = lambda at, ghost: F.struct(at.cast("int").alias("at"), F.lit(ghost).alias("ghost"))
    copies = F.concat(
        F.array(copy(F.col("at"), 0)),
        F.when(F.coalesce(head, F.lit(False)), F.array(copy(F.col("at") - 1, 1))).otherwise(F.array()),
        F.when(first, F.array(copy(F.lit(len(cuts)), 1))).otherwise(F.array()),
    )
    rows = (
        df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("at", at)
        .withColumn("copy", F.explode(copies))
        .select("copy.at", "copy.ghost", "key", "text")
    )
    order = ["at", "ghost", F.asc_nulls_first("key"), "text"]
    return rows.repartition(len(cuts) + 1, "at").sortWithinPartitions(*order), len(cuts) + 1


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """For each row ``key``, ``n_chars``, the ``edited`` text and both fingerprints with likenesses.

    The edited text ends in the start of the next text by ascending key, the first after the last.
    """
    rows, _ = beside_next(df, key, text)

    def judged(held: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        edited = [edited_text(x, y) for _, x, y in held]
        distinct = list(dict.fromkeys([*(x for _, x, _ in held), *(y for *_, y in held), *edited]))
        found = dict(zip(distinct, (np.frombuffer(x, np.uint8) for x in embed(distinct, seed))))
        own = [found[x] for _, x, _ in held]
        return pa.RecordBatch.from_arrays([
            pa.array([k for k, _, _ in held], pa.int64()),
            pa.array([len(x) for _, x, _ in held], pa.int64()),
            pa.array(edited, pa.string()),
            pa.array([packed(x) for x in own], pa.string()),
            pa.array([packed(found[x]) for x in edited], pa.string()),
            pa.array([likeness(a, found[x]) for a, x in zip(own, edited)], pa.float64()),
            pa.array([likeness(a, found[x]) for a, (*_, x) in zip(own, held)], pa.float64()),
        ], ["key", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, last = [], 0, None
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] == row[0] and not last[1]:
                    held.append((last[2], last[3], row[3]))
                    chars += len(last[3])
                    if chars >= HELD_CHARS:
                        yield judged(held)
                        held, chars = [], 0
                last = row
        if held:
            yield judged(held)

    return rows.mapInArrow(
        run,
        "key long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    ).withColumnRenamed("key", key)


def near_documents(prints: DataFrame, *, key: str = "doc_id", likeness_of: float = NEAR) -> DataFrame:
    """``key`` and ``near_id``, the least key of the texts linked with it, itself included.

    ``prints`` has ``key`` and ``fingerprint``. Equal fingerprints, those of empty texts too, are one
    from the start. Keys that are null are linked but name nothing while another key is there.
    """
    rows = prints.select(F.col(key).alias("key"), "fingerprint", F.xxhash64("fingerprint").alias("node"))
    known = materialize(
        rows.groupBy("node").agg(F.min("key").alias("least"), F.min("fingerprint").alias("fingerprint")), "prints"
    )
    n_bands = BANDED * (SAMPLES // BAND)
    first = F.greatest(F.length("fingerprint") - BANDED * SAMPLES, F.lit(0))
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(n_bands - 1)),
        lambda i: F.struct((first + i * BAND).alias("at"), F.substring("fingerprint", first + i * BAND + 1, BAND).alias("band")),
    )
    # A band past the end of the walk, or of a shorter fingerprint, says nothing.
    bands = F.filter(bands, lambda b: (F.length(b["band"]) == BAND) & ~F.contains(b["band"], F.lit(".")))
    members = known.select("node", F.explode(bands).alias("b")).select(
        F.xxhash64("b.at", "b.band").alias("bucket"), "node", F.lit(0).cast("long").alias("of")
    )

    def check(pairs: DataFrame) -> DataFrame:
        side = lambda x: known.select(F.col("node").alias(x), F.col("fingerprint").alias(f"print_{x}"))
        both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, x, y = (batch[c].to_pylist() for c in ("a", "b", "print_a", "print_b"))
                near = [likeness(unpacked(p), unpacked(q)) >= likeness_of for p, q in zip(x, y)]
                keep = pa.array(near, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], ["a", "b"]
                )

        return both.mapInArrow(run, "a long, b long")

    found = linked(members, lambda a, b: F.lit(True), check)
    classes = known.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("class"))
    named = classes.groupBy("class").agg(F.min("least").alias("near_id"))
    named = materialize(classes.join(named, "class").select("node", "near_id"), "near")
    return rows.join(named, "node").select(F.col("key").alias(key), "near_id")
