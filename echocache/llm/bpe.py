"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes.

Encoding. A token sequence is what the merges make of its bytes exactly if every two neighbours
stay as they are when merged as a pair. So the last token of the encoding of every prefix is
unique: the one vocabulary suffix that fits the last token of the prefix before it. The transducer
reads bytes; its state is the last emitted token and the bytes not yet emitted. Boundaries that a
later token may still start from are those where the bytes after them begin some longer token; what
all of them have in common is emitted. So output lags by a bounded number of bytes (twice the
longest token), and a run of any length takes linear time. States and transitions are built when
first met and are dropped when there are too many; they are a cache, never an approximation.

Text is first cut at single spaces between visible characters, where no match of the splitting
pattern can cross; such a chunk goes through the pattern and the transducer once per worker and is
remembered in a bounded table.

Decoding. Token bytes are joined block by block; the state machine finds how many bytes at a
block's end belong to an unfinished character, and these wait for the next block.

Defined results: null text is the empty text and has no tokens; repeated rows are encoded each;
ids outside the vocabulary are an error; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
import functools
import gc
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bounds of what a worker remembers; results do not depend on them.
MAX_STATES, MAX_CHUNKS, MAX_CHUNK_CHARS, MAX_PAIRS = 200_000, 250_000, 64, 500_000
#: A state's missing transition is built when it is asked for more often than this; before, the
#: rest of a match of at most so many bytes is run without building states that nobody may need.
COLD, AHEAD = 16, 256
#: Ids decoded at a time.
BLOCK = 65_536

#: A space between visible characters; written so that the search starts from the space.
_CUT = re.compile(r" (?=\S)(?<=\S )")


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from lines of ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in blob.splitlines() if x)}


class State:
    """The last emitted token and the bytes not yet emitted.

    ``tokens[j - 1]`` is (last token, its begin) of the pending prefix of length j; ``live`` are the
    boundaries, 0 among them, that a later token may start from.
    """

    __slots__ = ("last", "pending", "tokens", "live", "next", "cold", "_tail")

    def __init__(self, last: int | None, pending: bytes, tokens: tuple, live: tuple) -> None:
        self.last, self.pending, self.tokens, self.live = last, pending, tokens, live
        self.next: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.cold = 0
        self._tail: tuple[int, ...] | None = None


class Transducer:
    """Encodes byte strings, one match of the splitting pattern at a time."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        #: What a token may still grow from, with its own rank, or None if it is no token.
        self.open = {token[:k]: ranks.get(token[:k]) for token in ranks for k in range(1, len(token))}
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[bytes, float, float]]] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple[int | None, bytes], State] = {}
        self.start = self.state(None, b"", (), (0,))

    def state(self, last: int | None, pending: bytes, tokens: tuple, live: tuple) -> State:
        found = self.states.get((last, pending))
        if found is None:
            found = self.states[last, pending] = State(last, pending, tokens, live)
        return found

    def merged(self, piece: bytes, upto: int = 1) -> list[bytes]:
        """The merges themselves, lowest rank first, then left; ends at ``upto`` parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > upto:
            best = min(
                (self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
            )
            if best[0] == 1 << 62:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[bytes, float, float]]:
        """Parts at an edge of a token (0 left, 1 right) with the ranks between which they stand."""
        found = self.spines.get((token, side))
        if found is None:
            found, part, end = [], self.bytes_of[token], float("inf")
            while True:
                begin = self.ranks[part] if len(part) > 1 else -1
                found.append((part, begin, end))
                if len(part) == 1:
                    break
                part, end = self.merged(part, 2)[-side], begin
            self.spines[token, side] = found
        return found

    def fits(self, left: int | None, right: int) -> bool:
        """Whether the merges of both tokens' bytes end in these two tokens.

        They do not if parts that touch at the border, while both stand, merge with one another
        before they merge into their own token; of equal ranks the one further left goes first.
        """
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            if left is None:
                b = self.bytes_of[right]
                found = self.merged(b) == [b]
            else:
                found, rank = True, self.ranks.get
                for a, a_begin, a_end in self.spine(left, 1):
                    for b, b_begin, b_end in self.spine(right, 0):
                        if a_begin < b_end and b_begin < a_end:
                            cross = rank(a + b)
                            if cross is not None and cross < a_end and cross <= b_end:
                                found = False
            self.pairs[left, right] = found
        return found

    def build(self, at: State, byte: int) -> tuple[State, tuple[int, ...]]:
        pending = at.pending + bytes((byte,))
        n = len(pending)
        live, token, begin = [], None, 0
        opened, ranks, pairs = self.open, self.ranks, self.pairs
        for j in at.live:  # a token starts at a boundary that is still open
            part = pending[j:] if j else pending
            found = opened.get(part, -1)
            if found == -1:
                found = None if token is not None else ranks.get(part)
            else:
                live.append(j)
            if found is not None and token is None:
                left = at.tokens[j - 1][0] if j else at.last
                fits = pairs.get((left, found))
                if self.fits(left, found) if fits is None else fits:
                    token, begin = found, j
        if token is None:
            raise ValueError(f"the vocabulary has no way on at byte {byte}")
        tokens = (*at.tokens, (token, begin))
        live.append(n)
        cut = 0 if live[0] == 0 else n
        for j in live if cut else ():  # the last boundary that all live ones come from
            while j > cut:
                j = tokens[j - 1][1]
            while cut > j:
                cut = tokens[cut - 1][1]
                while j > cut:
                    j = tokens[j - 1][1]
        out, j = [], cut
        while j:
            out.append(tokens[j - 1][0])
            j = tokens[j - 1][1]
        if cut:
            rest = tuple((t, max(b - cut, 0)) for t, b in tokens[cut:])
            to = (out[0], pending[cut:], rest, tuple(j - cut for j in live))
        else:
            to = (at.last, pending, tokens, tuple(live))
        if len(self.states) >= MAX_STATES:
            self.reset()
            at.next.clear()
        step = at.next[byte] = (self.state(*to), tuple(out[::-1]))
        return step

    def run_on(self, at: State, rest: bytes) -> list[int]:
        """Ids of what is pending and a short rest, without building states for them."""
        data, live = at.pending + rest, at.live
        last, begins = [at.last, *(t for t, _ in at.tokens)], [0, *(b for _, b in at.tokens)]
        opened, ranks, pairs = self.open, self.ranks, self.pairs
        for n in range(len(at.pending) + 1, len(data) + 1):
            now, token, begin = [], None, 0
            for j in live:
                part = data[j:n]
                found = opened.get(part, -1)
                if found == -1:
                    found = None if token is not None else ranks.get(part)
                else:
                    now.append(j)
                if found is not None and token is None:
                    fits = pairs.get((last[j], found))
                    if self.fits(last[j], found) if fits is None else fits:
                        token, begin = found, j
            if token is None:
                raise ValueError(f"the vocabulary has no way on at byte {data[n - 1]}")
            last.append(token)
            begins.append(begin)
            now.append(n)
            live = now
        out, n = [], len(data)
        while n:
            out.append(last[n])
            n = begins[n]
        return out[::-1]

    def tail(self, at: State) -> tuple[int, ...]:
        if at._tail is None:
            out, j = [], len(at.pending)
            while j:
                token, j = at.tokens[j - 1]
                out.append(token)
            at._tail = tuple(out[::-1])
        return at._tail

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the splitting pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        at, out = self.start, []
        for i, byte in enumerate(piece):
            step = at.next.get(byte)
            if step is None:
                at.cold += 1
                if at.cold <= COLD and len(piece) - i <= AHEAD:
                    return out + self.run_on(at, piece[i:])
                step = self.build(at, byte)
            at = step[0]
            if step[1]:
                out += step[1]
        out += self.tail(at)
        return out


def segments(text: str, size: int = 1 << 20) -> Iterator[tuple[bool, str]]:
    """Cut a long text into parts of about ``size``; whether the space before a part was cut off."""
    at, spaced = 0, False
    while at + size < len(text) and (space := _CUT.search(text, at + size)):
        yield spaced, text[at : space.start()]
        at, spaced = space.end(), True
    yield spaced, text[at:]


def cut(part: str) -> list[str]:
    """Split at the spaces between visible characters."""
    return _CUT.split(part)


class Unclean(Exception):
    """A space without a visible character on both sides; the pattern may match across it."""


class Known(dict):
    """Packed ids of a space and a chunk, by chunk: what was used lately, in two generations."""

    def __init__(self, split: Callable[[str], list[str]], make: Callable[[list[str]], bytes]) -> None:
        self.split, self.make, self.old = split, make, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise Unclean
            ids = self.of_matches(self.split(" " + chunk), chunk)
            if len(chunk) > MAX_CHUNK_CHARS:
                return ids
        if len(self) >= MAX_CHUNKS:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def of_matches(self, matches: list[str], chunk: str) -> bytes:
        """A chunk of several matches, such as a word and a comma, is put together from known ones."""
        first = matches[0]
        if len(matches) == 1 or first[0] != " " or first == " ":
            return self.make(matches)
        word = first[1:]
        ids = self.get(word) or self.old.get(word)
        if ids is None:
            ids = self.make([first])
            if len(word) <= MAX_CHUNK_CHARS and len(self) < MAX_CHUNKS:
                self[word] = ids
        return ids + self.make(matches[1:])


class Encoder:
    """Ids of whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.known = Known(self.pattern.findall, self.packed)

    def packed(self, matches: list[str]) -> bytes:
        """Through the transducer; 32-bit ids, packed."""
        encode = self.transducer.encode
        return array("i", [i for match in matches for i in encode(match.encode())]).tobytes()

    def plain(self, text: str) -> bytes:
        """Through the pattern and the transducer."""
        return self.packed(self.pattern.findall(text))

    def part(self, spaced: bool, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise Unclean
            ids = b"".join(map(self.known.__getitem__, rest))
        except Unclean:
            first, *rest = cut(text)
            ids = b"".join([self.plain(" " + x) for x in rest])
        return self.plain(" " * spaced + first) + ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as 32-bit integers."""
        return np.frombuffer(b"".join([self.part(*x) for x in segments(text)]), np.int32)


def _machine() -> list[list[int]]:
    """next[state][byte] of UTF-8: state 0 is between characters, -1 is an error.

    States 1 to 3 await as many continuation bytes; 4 to 7 await a first continuation byte from
    a narrower range, after the lead bytes E0, ED, F0 and F4.
    """
    table = [[-1] * 256 for _ in range(8)]
    for first, last, to in (
        (0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5),
        (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7),
    ):
        table[0][first : last + 1] = [to] * (last + 1 - first)
    for state, first, last, to in (
        (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1),
        (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
    ):
        table[state][first : last + 1] = [to] * (last + 1 - first)
    return table


MACHINE = _machine()


class StreamDecoder:
    """Text from ids that arrive in blocks; a character split over blocks waits for its end."""

    def __init__(self, bytes_of: list[bytes]) -> None:
        self.bytes_of, self.held = bytes_of, b""

    def feed(self, ids: list[int]) -> str:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(4, cut + 1)):  # the last lead byte is at most three bytes back
            if data[-back] >= 0xC0:
                state = 0
                for byte in data[cut - back :]:
                    state = MACHINE[state][byte]
                    if state <= 0:
                        break
                cut -= back if state > 0 else 0
                break
            if data[-back] < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def decode_all(ids: np.ndarray, bytes_of: list[bytes]) -> str:
    decoder = StreamDecoder(bytes_of)
    parts = [decoder.feed(ids[at : at + BLOCK].tolist()) for at in range(0, len(ids), BLOCK)]
    return "".join((*parts, decoder.end()))


@functools.cache
def _encoder(blob: bytes, pattern: str) -> Encoder:
    """One per worker process, kept from task to task."""
    gc.set_threshold(200_000, 50, 100)  # tables of many small objects, none of them garbage
    return Encoder(read_ranks(blob), pattern)


def _vocabulary(spark: SparkSession, path: str):
    """The file's bytes, broadcast: a vocabulary has a fixed size, about a megabyte."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def extended(df: DataFrame, new: dict[str, T.DataType]) -> T.StructType:
    taken = {c.lower() for c in df.columns}
    if clash := [c for c in new if c.lower() in taken]:
        raise ValueError(f"columns {clash} exist already; choose other output names")
    return T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in new.items())])


def texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    values = batch.column(batch.schema.get_field_index(column))
    return (x.as_py() or "" for x in values)


def lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    values = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(
    df: DataFrame, vocabulary: str, pattern: str, *, text: str = "text", ids: str = "ids",
    decoded: str | None = None, drop: tuple = (),
) -> DataFrame:
    """Add ``ids``, the token ids of ``text`` (array<int>).

    ``vocabulary`` is the place of a rank file on the driver. With ``decoded``, a further column of
    that name has the text decoded again from the ids, in the same pass. Columns in ``drop`` are
    not returned.
    """
    new = {ids: T.ArrayType(T.IntegerType()), **({decoded: T.StringType()} if decoded else {})}
    schema = extended(df.drop(*drop), new)
    blob = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(blob.value, pattern)
        for batch in slices(batches):
            rows = [encoder.encode(x) for x in texts(batch, text)]
            kept = batch.drop_columns(list(drop)) if drop else batch
            columns = [*kept.columns, lists(rows)]
            if decoded:
                bytes_of = encoder.transducer.bytes_of
                columns.append(pa.array([decode_all(x, bytes_of) for x in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*kept.schema.names, *new])

    return df.mapInArrow(run, schema)


def decode(
    df: DataFrame, vocabulary: str, pattern: str, *, ids: str = "ids", text: str = "decoded"
) -> DataFrame:
    """Add ``text``, decoded from ``ids`` (null ids: the empty text)."""
    schema = extended(df, {text: T.StringType()})
    blob = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _encoder(blob.value, pattern).transducer.bytes_of
        for batch in slices(batches):
            rows = batch.column(batch.schema.get_field_index(ids))
            texts = [decode_all(np.array(x.as_py() or (), np.int32), bytes_of) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text]
            )

    return df.mapInArrow(run, schema)
