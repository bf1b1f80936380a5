"""Repeated passages by difference-cover anchors.

A window is ``length`` consecutive words of one text. Words are removed that a window covers which
also starts in a text with a smaller key.

Hashing every window of the corpus would shuffle a number for each word. Instead shorter windows are
hashed, and only those that start at positions of a difference cover: a set D of remainders modulo a
period P such that any two offsets i and j have a shift below P that moves both into D. If two texts
share ``length`` words, then among the first P positions of the match there is one that is a cover
position in both, and the anchor that starts there, ``length - P + 1`` words long, lies inside the
match. So texts whose anchors nobody shares share nothing. With P = 31 and 6 remainders a fifth of
the positions is hashed.

Anchors that stand in two places are then extended: the full windows around them, P starts for
each, are hashed with 95 bits and sorted by hash and key; each that has a smaller key before it goes
back to its text as a position, and the words under the window are cut out.

No group is brought together. Texts are worked on a few thousand at a time; of an anchor that
several of them have only two go on to be compared, as the others are known to be shared, and of a
window only those of the least key. What is decided early travels along under a key of its own. So
a passage that a third of all texts have makes a few rows for each task, and the sorted runs are
read as streams.

Defined results: a null text has no words; texts shorter than a window lose nothing; windows are
judged on the input, not on what is left; rows with equal keys do not remove from one another, and
positions are checked against the row's own words before they are cut; rows with a null key neither
remove nor lose words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocache.llm.bpe import slices

LENGTH = 50
# A perfect difference set; every remainder is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

#: Texts and words worked on at a time.
SLICE_TEXTS, SLICE_WORDS = 4_096, 1_000_000
#: Odd factors of the two window hashes.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_START = (1 << 32) - 1


def split(text: str | None) -> list[bytes]:
    """Words as UTF-8; only the six ASCII spaces part them."""
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def windows(words: np.ndarray, length: int, odd: int = _FACTORS[0]) -> np.ndarray:
    """Hash of each ``length`` consecutive numbers: the sum of number times power of ``odd``."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Double the width while it fits, and join the pieces that the length's binary digits ask for.
    piece, width, power = words, 1, np.uint64(odd)
    out, done, factor = np.zeros(n, np.uint64), 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if length & width:
                out += piece[done : done + n] * factor
                done += width
                factor = factor * power
            if 2 * width > length:
                break
            piece = piece[: len(piece) - width] + piece[width:] * power
            width, power = 2 * width, power * power
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def cover_positions(n: int, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """Positions below ``n`` whose remainder is in the cover."""
    rows = np.arange(0, n + period, period)[:, None] + np.array(cover)[None, :]
    return np.sort(rows[rows < n])


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows, a few thousand or about a million words of them at a time; the second column is text."""
    rows, size = [], 0
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            size += len(row[1] or "") // 6
            if len(rows) >= SLICE_TEXTS or size >= SLICE_WORDS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _runs(ordered: np.ndarray) -> np.ndarray:
    """The index at which each element's run of equal ones begins."""
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def _own_keys(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys that scatter what needs no comparison."""
    x = (keys.astype(np.uint64) * np.uint64(_FACTORS[1])) ^ (at.astype(np.uint64) * np.uint64(_FACTORS[0]))
    return x ^ (x >> np.uint64(29))


def anchors(length: int, period: int, cover: tuple[int, ...]):
    """(hash, key, position) of the anchors of (key, text); decided ones have ``-1 - position``."""
    short = length - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in held(batches):
            hashes, keys, places = [], [], []
            for key, text in rows:
                words = split(text)
                if key is None or len(words) < length:
                    continue
                at = cover_positions(len(words) - short + 1, period, cover)
                hashes.append(windows(word_hashes(words), short)[at])
                keys.append(np.full(len(at), key, np.int64))
                places.append(at)
            if not hashes:
                continue
            h, key, at = np.concatenate(hashes), np.concatenate(keys), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            h, key, at = h[order], key[order], at[order]
            known = np.arange(len(h)) - _runs(h) >= 2
            h = np.where(known, _own_keys(key, at), h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(key), pa.array(np.where(known, -1 - at, at).astype(np.int32))],
                ["h", "key", "at"],
            )

    return run


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by hash: (key, position) of the anchors whose hash is there twice."""
    last = None  # the last row of the batch before, and whether it was handed on
    for batch in batches:
        if not batch.num_rows:
            continue
        h, key, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        twice = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        before = []
        if last is not None and h[0] == last[0]:
            twice[0] = True
            if not last[3]:
                before = [last[1:3]]
        twice |= at < 0
        last = (h[-1], key[-1], at[-1], bool(twice[-1]))
        found = np.where(at < 0, -1 - at, at)[twice]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.array([k for k, _ in before], np.int64), key[twice]])),
                pa.array(np.concatenate([np.array([p for _, p in before], np.int32), found]).astype(np.int32)),
            ],
            ["key", "at"],
        )


def _checks(words: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """31 further bits of the windows' hashes."""
    return (windows(words, length, _FACTORS[1])[starts] >> np.uint64(33)).astype(np.int64)


def extend(length: int, period: int):
    """From (key, text, anchors): (hash, key, check and start) of the windows around the anchors.

    Windows that a smaller key of the slice has too are decided: theirs is a negative number.
    """
    short = length - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in held(batches):
            hashes, keys, packed = [], [], []
            for key, text, at in rows:
                if not at:
                    continue
                words = word_hashes(split(text))
                n = len(words) - length + 1
                if n <= 0:
                    continue
                marks = np.zeros(len(words) + 1, np.int32)  # starts from which the anchor is inside
                at = np.array(at)
                at = at[at + short <= len(words)]
                np.add.at(marks, np.maximum(at - period + 1, 0), 1)
                np.add.at(marks, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(marks)[:n] > 0)
                hashes.append(windows(words, length)[starts])
                keys.append(np.full(len(starts), key, np.int64))
                packed.append(_checks(words, length, starts) << 32 | starts)
            if not hashes:
                continue
            h, key, at = np.concatenate(hashes), np.concatenate(keys), np.concatenate(packed)
            order = np.lexsort((key, at >> 32, h))
            h, key, at = h[order], key[order], at[order]
            first = _runs(h ^ (at >> 32).astype(np.uint64))
            known = key > key[first]
            h = np.where(known, _own_keys(key, at), h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(key), pa.array(np.where(known, -1 - at, at))],
                ["h", "key", "at"],
            )

    return run


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows sorted by hash, check and key: (key, check and start) of those to remove."""
    last = None  # hash, check and least key of the run that the batch before ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        h, key, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        check = at >> 32
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
        first = key[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        if last is not None and (h[0], check[0]) == last[:2]:
            end = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(h)
            first[:end] = last[2]
        last = (h[-1], check[-1], first[-1])
        out = (at < 0) | (key > first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[out]), pa.array(np.where(at < 0, -1 - at, at)[out])], ["key", "at"]
        )


def cut_out(words: list[bytes], at: list[int] | None, length: int) -> tuple[list[bytes], int]:
    """Words that no listed window covers, and how many were covered; others' windows are ignored."""
    if not at or len(words) < length:
        return words, 0
    found = np.unique(np.array(at, np.int64))
    starts = found & _START
    ok = starts <= len(words) - length
    found, starts = found[ok], starts[ok]
    starts = starts[_checks(word_hashes(words), length, starts) == found >> 32]
    marks = np.zeros(len(words) + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + length, -1)
    gone = np.cumsum(marks)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def remove_repeats(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    period: int = PERIOD, cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept``, the words that stay joined by spaces."""
    if period > length or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover needs every remainder as a difference, and a period up to the length")
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    row = "h long, key long, at "
    found = (
        docs.mapInArrow(anchors(length, period, cover), row + "int")
        .repartition(n, "h").sortWithinPartitions("h")
        .mapInArrow(shared, "key long, at int")
        .groupBy("key").agg(F.collect_list("at").alias("at"))
    )
    gone = (
        docs.join(found, "key", "left").select("key", "text", "at")
        .mapInArrow(extend(length, period), row + "long")
        .repartition(n, "h").sortWithinPartitions("h", F.shiftright("at", 32), "key")
        .mapInArrow(repeated, "key long, at long")
        .groupBy("key").agg(F.collect_list("at").alias("at"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, totals, cut, kept = [], [], [], []
            for k, x, at in zip(*(c.to_pylist() for c in batch.columns)):
                words = split(x)
                left, n_gone = cut_out(words, at, length)
                keys.append(k)
                totals.append(len(words))
                cut.append(n_gone)
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(totals, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.string())],
                ["key", "n_words", "n_removed", "kept"],
            )

    return (
        docs.join(gone, "key", "left").select("key", "text", "at")
        .mapInArrow(run, "key long, n_words long, n_removed long, kept string")
        .withColumnRenamed("key", key)
    )
