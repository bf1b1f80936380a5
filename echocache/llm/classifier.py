"""A quality classifier: random-indexing word vectors, pooled, and a network of two layers.

Words are runs of letters, of digits, or of other signs, and share ``SLOTS`` rows of a table by a checksum, so the table has
one size at any vocabulary. Every row has a sparse random index vector, made from a seed; the vector of a word
is the sum of the index vectors of the words up to ``WINDOW`` places from it, over the whole corpus. Each task adds
up its own whole-number table, and tables are added in two steps of shuffles; the sum does not depend on
the order. Vectors are scaled to one length around their mean.

A document is the mean of its words' vectors, the mean and spread over its distinct words, the share of
distinct words, and its length. The network learns from at most ``MAX_LABELLED`` labelled documents, drawn by a
checksum of the document number, and only their pooled numbers come to the driver. It is trained in numpy on
four fifths of them; on the rest one temperature is chosen that divides its outputs, so that scores are
probabilities. Then every document is scored where it lies: no text is shuffled.

Defined results: a null or empty text has no words and gets the score that the network gives to zeros; a document
that is labelled more than once has the mean of its labels; labels that are null, or of no document, are left out;
without labels every score is 0.5; rows with equal text get equal scores; an empty table has no rows. Texts
of any length are read in blocks of words. Other columns go through unchanged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocache.llm.bpe import extended, slices
from echocache.llm.tables import SUMS, summed, total_batch

#: Rows of the word table, entries of a vector, entries of an index vector that are not zero, words on each side.
SLOTS, WIDTH, SPIKES, WINDOW, SEED = 1 << 14, 48, 4, 2, 11
#: Labelled documents that the network learns from, at most; units of its first layer; rounds of training.
MAX_LABELLED, HIDDEN, ROUNDS = 20_000, 32, 60
#: Words that are worked on at a time, characters of a text that are split at once, and words remembered by a task.
BLOCK, AT_ONCE, REMEMBERED = 1 << 17, 1 << 20, 1 << 19
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
FEATURES = 3 * WIDTH + 2


class _Slots(dict):
    """Rows of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS
        return at

    def of(self, text: str | None) -> Iterator[np.ndarray]:
        """The rows of a text's words, in blocks."""
        if text and len(text) <= AT_ONCE:
            yield np.array([self[w] for w in _WORD.findall(text)], np.int64)
        elif text:
            found = (self[m[0]] for m in _WORD.finditer(text))
            while block := list(islice(found, BLOCK)):
                yield np.array(block, np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries that are not zero, for each row; one row more stands for no word."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((SLOTS + 1, WIDTH)), axis=1)[:, :SPIKES]
    signs = rng.choice([-1.0, 1.0], (SLOTS + 1, SPIKES))
    signs[SLOTS] = 0.0
    return places, signs


def _contexts(row: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The table that a sequence of words adds; ``SLOTS`` in it is no word."""
    at, weights = [], []
    for d in range(1, WINDOW + 1):
        for word, other in ((row[d:], row[:-d]), (row[:-d], row[d:])):
            at.append((word[:, None] * WIDTH + index[0][other]).ravel())
            weights.append(index[1][other].ravel())
    found = np.bincount(np.concatenate(at), np.concatenate(weights), (SLOTS + 1) * WIDTH)
    return found[: SLOTS * WIDTH].astype(np.int64)


def word_vectors(df: DataFrame, *, text: str = "text") -> np.ndarray:
    """The table of ``SLOTS`` word vectors of all texts; rows without a word are zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, slots, gap = index_vectors(), _Slots(), np.full(WINDOW, SLOTS)

        def parts() -> Iterator[np.ndarray]:
            held, n = [], 0
            for batch in batches:
                for x in batch.column(0):
                    before = gap
                    for block in slots.of(x.as_py()):
                        # The words before a block are its context too; they do not count again with one another.
                        if before is not gap:
                            yield -_contexts(before, index)
                        held += [before, block] if before is gap else [gap, before, block]
                        n, before = n + len(block), np.concatenate([before, block])[-WINDOW:]
                        if n >= BLOCK:
                            yield _contexts(np.concatenate([*held, gap]), index)
                            held, n = [], 0
            if held:
                yield _contexts(np.concatenate([*held, gap]), index)

        yield from total_batch(parts())

    found = summed(df.select(text).mapInArrow(run, SUMS), np.int64)
    table = (np.zeros(SLOTS * WIDTH) if found is None else found.astype(float)).reshape(SLOTS, WIDTH)
    used = np.abs(table).sum(axis=1) > 0
    if used.any():
        unit = table[used] / np.linalg.norm(table[used], axis=1, keepdims=True)
        unit -= unit.mean(axis=0)
        table[used] = unit / (np.linalg.norm(unit, axis=1, keepdims=True) + 1e-9)
    return table.astype(np.float32)


def pooled(blocks: Iterator[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The numbers of one document from its words' rows."""
    out, rows = np.zeros(FEATURES), [*blocks]
    if rows and sum(map(len, rows)):
        if len(rows) == 1:
            words, times = np.unique(rows[0], return_counts=True)
        else:
            times = sum(np.bincount(x, minlength=SLOTS) for x in rows)
            words = np.flatnonzero(times)
            times = times[words]
        vectors, n = table[words], times.sum()
        out[:WIDTH] = times @ vectors / n
        out[WIDTH : 2 * WIDTH] = vectors.mean(axis=0)
        out[2 * WIDTH : -2] = vectors.std(axis=0)
        out[-2:] = len(words) / n, np.log1p(n)
    return out


@dataclass(frozen=True)
class Network:
    """Two layers over standardised numbers; ``temperature`` divides the output."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logits(x) / self.temperature)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, rounds: int = ROUNDS, decay: float = 1e-3) -> Network:
    """Fit by Adam in shuffled batches; every fifth row is kept for the temperature."""
    rng = np.random.default_rng(SEED)
    check = np.arange(len(x)) % 5 == 4
    fit_x, fit_y = x[~check], y[~check]
    mean, scale = fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-6
    z = (fit_x - mean) / scale
    p = [rng.normal(size=(x.shape[1], hidden)) * (2 / x.shape[1]) ** 0.5, np.zeros(hidden), rng.normal(size=hidden) * hidden**-0.5, np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for turn in range(rounds):
        rate = 3e-3 * (1 - turn / rounds) + 1e-5
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            a, b = z[order[at : at + 256]], fit_y[order[at : at + 256]]
            inner = np.maximum(a @ p[0] + p[1], 0)
            off = (_logistic(inner @ p[2] + p[3]) - b) / len(a)
            back = np.outer(off, p[2]) * (inner > 0)
            gradients = [a.T @ back + decay * p[0], back.sum(axis=0), inner.T @ off + decay * p[2], off.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(gradients):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if not check.any():
        return net
    logits, few = net.logits(x[check]), 1 / (check.sum() + 2)
    told = y[check] * (1 - 2 * few) + few  # a few labels that are all met do not make certainty
    temperatures = np.exp(np.linspace(np.log(0.1), np.log(20), 200))
    best = min(temperatures, key=lambda t: _loss(logits / t, told))
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(best))


def held_out(key: Column) -> Column:
    """Whether a document's label is only for tests; never for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pool(df: DataFrame, table: np.ndarray, text: str, out: str) -> DataFrame:
    schema = extended(df.drop(text), {out: T.ArrayType(T.DoubleType())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in slices(batches):
            found = [pooled(slots.of(x.as_py()), table) for x in batch.column(batch.schema.get_field_index(text))]
            kept = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.list_(pa.float64()))], [*kept.schema.names, out])

    return df.mapInArrow(run, schema)


def fit(
    df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> tuple[np.ndarray, Network | None]:
    """Word vectors of all texts of ``df``, and the network learned from ``labels`` that are not held out.

    ``labels`` has ``key`` and ``label`` from 0 to 1. Documents are drawn by the least checksums.
    """
    table = word_vectors(df, text=text)
    draw = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 40))
    known = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"))
        .where(F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
        .groupBy("key").agg(F.avg("label").alias("label")).withColumn("draw", draw)
    )
    documents = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    n = known.count()
    if n > max_labelled:  # a cut that lets through the bound or a little less
        share = max(0.0, max_labelled - 4 * max_labelled**0.5) / n
        known = known.where(F.col("draw") < int(share * (1 << 40)))
    found = documents.join(F.broadcast(known), "key")
    rows = _pool(found, table, "text", "numbers").orderBy("draw", "key", "numbers").limit(max_labelled).collect()
    if not rows:
        return table, None
    return table, train(np.array([r.numbers for r in rows]), np.array([r.label for r in rows]))


def score(
    df: DataFrame, model: tuple[np.ndarray, Network | None], *, text: str = "text", out: str = "score", drop: tuple = ()
) -> DataFrame:
    """Add ``out``, the probability of label 1; ``drop`` columns are not returned."""
    table, net = model
    schema = extended(df.drop(*drop), {out: T.DoubleType()})
    if net is None:
        return df.drop(*drop).withColumn(out, F.lit(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in slices(batches):
            numbers = [pooled(slots.of(x.as_py()), table) for x in batch.column(batch.schema.get_field_index(text))]
            scores = net.scores(np.array(numbers)) if numbers else np.empty(0)
            kept = batch.drop_columns(list(drop)) if drop else batch
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores, pa.float64())], [*kept.schema.names, out])

    return df.mapInArrow(run, schema)
