"""Spelling variants: words one code point apart, found by pivotal grams, and the common form of each.

Bigrams are ordered by how rare they are over all words. The prefix of a word is its three rarest bigrams,
with every place where one of them stands; a dynamic programme over the places picks the two of them that do
not overlap and are rarest together, the pivots. One edit cannot touch both pivots, and of two near words take
the one whose prefix ends at the rarer bigram: the pivot that the edit left whole is in the prefix of the
other. So pivots look up prefixes, never all bigrams of all words. The position limit is as sharp as one edit
allows. What lies on one side of the whole pivot is the same in both words, so a pivot is looked up together
with that side and the length of the other word: the first pivot with all before it, for edits behind it, and the
second with all after it, for edits at or before the first. A pair that comes up must then agree outside of the
stretch that the edit can be in, and its edit distance is computed. Each pair comes up once. Before that, counts of
letters, up to two of each kind as bits of one number, may differ in two bits only.

Words of more than ``LONG`` code points can repeat one bigram very often. A pair with such a word has either
the first or the second half of it in common, so these are looked up by halves.

Words are counted in Arrow batches, added up in bounded tables before the shuffle. Bigram counts, of which there are
at most ``len(LETTERS) ** 2``, are the only thing sent to all tasks. Lookup keys are 64-bit hashes; a
group of words under one key is one side of a join that adaptive execution splits, and nothing is gathered.
Forms are followed by doubling the steps, a round for each doubling of the longest chain that counts allow.

Defined results: a null or empty text has no words; a null document number is written as nothing before the
colon; rows with equal number and text count each; a word without a near one is a row with none; words are told
apart by code points, also where they look alike; an empty table has no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocache.scratch import materialize

#: Letters of words, after A-Z are lower-cased.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
MIN_LENGTH, MIN_COUNT, DROPPED, TIMES = 7, 2, 31, 10
#: Longest words with pivots, words counted before they are sent on, and characters of a text that are split at once.
LONG, HELD, AT_ONCE = 64, 200_000, 1 << 20
_PREFIX = 3


def _runs(text: str, least: int) -> Counter:
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes: A-Z only
    found = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    return Counter(found.findall(text) if len(text) <= AT_ONCE else (m[0] for m in found.finditer(text)))


def counted(df: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH, times: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n`` of the words of at least ``least`` code points that occur ``times`` times or more.

    One of ``DROPPED`` pairs of document and run loses a code point, both chosen by a checksum.
    """

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for number, x in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{number.as_py() if number.is_valid else ''}:".encode())
                for word, n in _runs(x.as_py() or "", least).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DROPPED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                    if len(held) >= HELD:
                        yield out(held)
                        held = Counter()
        if held:
            yield out(held)

    found = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Bigrams with their place in the order of rarity and their count; at most ``len(LETTERS) ** 2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                if len(word) <= LONG:
                    held.update(map("".join, zip(word, word[1:])))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: (i, r.n) for i, r in enumerate(sorted(rows, key=lambda r: (r.n, r.gram)))}


def pivots(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[int, int, int, list[int]]:
    """Places of the two pivots, the rank at which the prefix ends, and the places of the prefix."""
    grams = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(grams)[min(_PREFIX, len(grams)) - 1][0]
    prefix = [i for i, g in enumerate(grams) if g[0] <= last]
    best, single = None, None  # the best pair so far; the best place that ends before the one at hand
    waiting: list[int] = []
    for i in prefix:
        waiting.append(i)
        while waiting and waiting[0] <= i - 2:
            j = waiting.pop(0)
            if single is None or grams[j][1] < grams[single][1]:
                single = j
        if single is not None and (best is None or grams[single][1] + grams[i][1] < best[0]):
            best = (grams[single][1] + grams[i][1], single, i)
    return best[1], best[2], last, prefix


def _hashes(word: str) -> list[int]:
    """Hashes of the first 0, 1, … code points."""
    state, out = xxhash.xxh64(), []
    for c in word:
        out.append(state.intdigest())
        state.update(c.encode())
    return [*out, state.intdigest()]


def _key(side: int, hashed: int, length: int) -> int:
    """A signed number for what is on one side, in words of a length."""
    x = (hashed * 2 + side) * 0x9E3779B97F4A7C15 + length * 0xBF58476D1CE4E5B9
    x &= (1 << 64) - 1
    x = (x ^ (x >> 29)) * 0x94D049BB133111EB & (1 << 64) - 1
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


def letter_bits(word: str) -> int:
    """Two bits for each of 32 kinds of letters: whether there is one, and whether there are more.

    A letter more or less changes one bit at most.
    """
    once = twice = 0
    for c in word:
        bit = 1 << (ord(c) - 97 if c <= "z" else 26 + ord(c) % 6)
        twice |= once & bit
        once |= bit
    x = once | twice << 32
    return x - (1 << 64) if x >> 63 else x


#: What a key is for: the first pivot with all before it, the second with all after it, and halves.
_FIRST, _SECOND, _LEFT, _RIGHT = range(4)


def keys(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[int, int, int, list[int], list[tuple[int, int]]]:
    """Pivots, the end of the prefix, keys that the word is found under, and (kind, key) that it looks up."""
    size, before, after = len(word), _hashes(word), _hashes(word[::-1])
    held: list[int] = []
    asked: list[tuple[int, int]] = []
    p1 = p2 = last = 0
    if MIN_LENGTH - 1 <= size <= LONG:
        p1, p2, last, prefix = pivots(word, ranks)
        for i in prefix:
            held += (_key(_FIRST, before[i + 2], size), _key(_SECOND, after[size - i], size))
        for n in (size - 1, size, size + 1):
            asked += ((_FIRST, _key(_FIRST, before[p1 + 2], n)), (_SECOND, _key(_SECOND, after[size - p2], n)))
    if size >= LONG:
        half = size // 2
        held += (_key(_LEFT, before[half], size), _key(_RIGHT, after[size - half], size))
        for n in (size - 1, size, size + 1):
            asked += ((_LEFT, _key(_LEFT, before[n // 2], n)), (_RIGHT, _key(_RIGHT, after[n - n // 2], n)))
    return p1, p2, last, held, asked


def near_pairs(words: DataFrame) -> DataFrame:
    """``a``, ``n_a``, ``b`` and ``n_b`` of all words that are one edit apart, each pair once.

    ``words`` has ``word``, distinct words of ``LETTERS`` and at least six code points, and ``n``.
    """
    ranks = gram_ranks(words)
    schema = "word string, n long, bits long, p1 int, p2 int, last int, held array<long>, asked array<struct<kind: int, key: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64())]))
        for batch in batches:
            words = batch.column(0).to_pylist()
            p1, p2, last, held, asked = zip(*(keys(w, ranks) for w in words)) if words else [()] * 5
            bits = pa.array(map(letter_bits, words), pa.int64())
            asked = [[{"kind": k, "key": x} for k, x in one] for one in asked]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, bits, *(pa.array(x, pa.int32()) for x in (p1, p2, last)), pa.array(held, pa.list_(pa.int64())), pa.array(asked, kinds)],
                ["word", "n", "bits", "p1", "p2", "last", "held", "asked"],
            )

    signed = materialize(words.select("word", "n").mapInArrow(run, schema), "signed")
    side = lambda x, *more: [F.col(c).alias(f"{x}_{c}") for c in ("word", "n", "bits", "last", *more)]
    found = signed.select(F.explode("held").alias("key"), *side("b"))
    asking = signed.select(F.explode("asked").alias("asked"), *side("a", "p1", "p2")).select("asked.*", "*").drop("asked")

    a, b, p1, p2 = F.col("a_word"), F.col("b_word"), F.col("a_p1"), F.col("a_p2")
    shift = F.length(b) - F.length(a)
    start = lambda x, n: F.substring(x, F.lit(1), n)
    since = lambda x, n: F.substring(x, n + 1, F.length(x))
    same_start = lambda n: start(a, n) == start(b, n)
    same_end = lambda n: since(a, n) == since(b, n + shift)
    # The prefix of one word ends first; equal ends go by the word, so one of both asks for the other.
    first = (F.col("a_last") < F.col("b_last")) | ((F.col("a_last") == F.col("b_last")) & (a < b))
    short = (F.length(a) <= LONG) & (F.length(b) <= LONG)
    in_front = same_end(p1 + 2)  # the edit is at or before the first pivot
    behind = same_start(p2) | (same_start(p1 + 2) & same_end(p2))
    half = F.floor(F.length(b) / 2).cast("int")
    left, right = same_start(half), since(b, half) == since(a, F.length(a) - F.length(b) + half)
    fits = (
        F.when(F.col("kind") == _FIRST, short & first & behind & ~in_front)
        .when(F.col("kind") == _SECOND, short & first & in_front)
        .when(F.col("kind") == _LEFT, ~short & (a < b) & left & ~right)
        .otherwise(~short & (a < b) & right)
    )
    maybe = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2
    near = F.expr("levenshtein(a_word, b_word, 1) = 1")
    return asking.join(found, "key").where(maybe & fits & near).select(
        a.alias("a"), F.col("a_n").alias("n_a"), b.alias("b"), F.col("b_n").alias("n_b")
    )


def _roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """``word`` and ``root`` from ``word`` and ``form``, where a form occurs at least ``times`` times as often."""
    jump, steps, longest = forms.select("word", F.col("form").alias("root")), 1, 0
    while most >= times:
        longest, most = longest + 1, most // times
    while steps < longest:
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jump = jump.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        jump, steps = materialize(jump, "roots"), 2 * steps
    return jump


def group_variants(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH, count: int = MIN_COUNT, times: int = TIMES
) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of the texts.

    The form of a word is its most frequent near word (of equal ones the first in code-point order) if it occurs
    at least ``times`` times as often; the root is the last form of a chain of forms, or the word itself.
    """
    if least < MIN_LENGTH or times < 2:
        raise ValueError(f"words have at least {MIN_LENGTH} code points, and forms occur at least twice as often")
    words = materialize(counted(df, key=key, text=text, least=least, times=count), "words")
    pairs = near_pairs(words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("less"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("less"), F.col("a").alias("near")),
    )
    near = (
        pairs.select(F.explode(sides).alias("one")).groupBy("one.word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct("one.less", "one.near")).alias("most"))
    )
    near = near.select("word", "n_near", F.col("most.near").alias("near"), (-F.col("most.less")).alias("near_n"))
    judged = words.join(near, "word", "left").withColumn("chosen", F.coalesce(F.col("near_n") >= times * F.col("n"), F.lit(False)))
    judged = materialize(judged, "judged")
    most = judged.where("chosen").agg(F.max("near_n")).first()[0] or 0
    roots = _roots(judged.where("chosen").select("word", F.col("near").alias("form")), most, times)
    return judged.join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("chosen"), F.col("near")).alias("form"), F.when(F.col("chosen"), F.col("near_n")).alias("form_n"),
        F.coalesce("root", "word").alias("root"),
    )
