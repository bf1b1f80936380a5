"""Token counts by a two-tier lookup; no pre-token is shuffled for its count.

Text is cut at single spaces between visible characters. A byte-level tokenizer without a
normaliser, whose pattern takes a space only at the start of a match, never joins across such a
cut, so the count of a text is the sum over its pre-tokens.

Tier one: a first pass over all texts counts pre-tokens in each task, in a table of bounded size;
only each task's most frequent few thousand go on, are summed, and the ``FREQUENT`` most frequent
get their lengths on the driver and are broadcast, packed. Tier two: what is not among them is
encoded by the library once and remembered in each worker, in a bounded cache. Both tiers decide
only how often the library is called, never a count.

Defined results: null text is the empty text with no tokens; special strings in a text are the
special token, as is the library's default; repeated rows are counted each.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocache.llm.bpe import Unclean, cut, extended, segments, slices, texts

#: Pre-tokens in the broadcast table, and what one task may hand on for it.
FREQUENT, PER_TASK = 65_536, 8_192
#: Bounds of a task's counters and of a worker's cache, in pre-tokens, and of their length.
MAX_COUNTED, MAX_CACHED, MAX_CHARS = 400_000, 250_000, 64


def unclean(chunks: list[str]) -> bool:
    return any(not x or x[0].isspace() or x[-1].isspace() for x in chunks)


class Lengths(dict):
    """Token counts of a space and a pre-token: the frequent ones, then two generations."""

    def __init__(self, frequent: dict[str, int], tokenizer) -> None:
        super().__init__(frequent)
        self.tokenizer, self.new, self.old = tokenizer, {}, {}

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def __missing__(self, chunk: str) -> int:
        n = self.new.get(chunk)
        if n is not None:
            return n
        n = self.old.get(chunk)
        if n is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise Unclean
            n = self.count(" " + chunk)
        if len(chunk) <= MAX_CHARS:
            if len(self.new) >= MAX_CACHED:
                self.old, self.new = self.new, {}
            self.new[chunk] = n
        return n

    def part(self, spaced: bool, text: str) -> int:
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise Unclean
            n = sum(map(self.__getitem__, rest))
        except Unclean:
            first, *rest = cut(text)
            n = sum(self.count(" " + x) for x in rest)
        return self.count(" " * spaced + first) + n

    def total(self, text: str) -> int:
        return sum(self.part(*x) for x in segments(text))


@functools.cache
def load(blob: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(blob.decode())


@functools.lru_cache(maxsize=2)
def _lengths(blob: bytes, packed: bytes, ends: bytes, counts: bytes) -> Lengths:
    """One per worker process, kept from task to task."""
    stops, text = np.frombuffer(ends, np.int32).tolist(), packed.decode("utf-32-le")
    frequent = {text[a:b]: n for a, b, n in zip([0, *stops], stops, array("i", counts))}
    return Lengths(frequent, load(blob))


def frequent_pretokens(df: DataFrame, text: str = "text") -> list[str]:
    """The most frequent pre-tokens of all texts, as far as the tasks' bounded counters see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in slices(batches):
            for x in texts(batch, text):
                for _, part in segments(x):
                    seen.update(part.split(" ")[1:])
            if len(seen) > MAX_COUNTED:
                seen = Counter(dict(seen.most_common(MAX_COUNTED // 4)))
        top = [(k, n) for k, n in seen.most_common(PER_TASK) if len(k) <= MAX_CHARS and not unclean([k])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            ["pretoken", "n"],
        )

    found = (
        df.select(text).mapInArrow(run, "pretoken string, n long")
        .groupBy("pretoken").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "pretoken").limit(FREQUENT)
    )
    return [row.pretoken for row in found.select("pretoken").collect()]


def count_tokens(
    df: DataFrame, tokenizer: str, *, text: str = "text", out: str = "n_tokens", drop: tuple = ()
) -> DataFrame:
    """Add ``out``, the number of tokens of ``text``; columns in ``drop`` are not returned.

    ``tokenizer`` is the place of a byte-level tokenizer file (.json) on the driver.
    """
    with open(tokenizer, "rb") as file:
        blob = file.read()
    model = load(blob)
    if model.normalizer is not None or "ByteLevel" not in str(model.pre_tokenizer):
        raise ValueError("only byte-level tokenizers without a normaliser can be counted by pre-token")
    schema = extended(df.drop(*drop), {out: T.LongType()})
    frequent = frequent_pretokens(df, text)
    found = model.encode_batch([" " + x for x in frequent], add_special_tokens=False)
    table = df.sparkSession.sparkContext.broadcast((
        blob,
        "".join(frequent).encode("utf-32-le"),
        np.cumsum([len(x) for x in frequent], dtype=np.int32).tobytes(),
        array("i", map(len, found)).tobytes(),
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(*table.value)
        for batch in slices(batches):
            totals = pa.array([lengths.total(x) for x in texts(batch, text)], pa.int64())
            kept = batch.drop_columns(list(drop)) if drop else batch
            yield pa.RecordBatch.from_arrays([*kept.columns, totals], [*kept.schema.names, out])

    return df.mapInArrow(run, schema)
