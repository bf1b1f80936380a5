"""The parts of the operators that run inside tasks, against libraries and brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from echocache.llm import bpe, counts, edits, simhash, substrings

TEXTS = [
    "", " ", "  a", "a b", "a  b \n c", "lead ", "x\ty", "it's we'll 12 3.4%% déjà vu", "日本 語 🙂🙂", "a" * 3000,
    " " * 500 + "x", "\n" * 30 + " b", "ab" * 700, "<|endoftext|> a <|endoftext|>b", "naïve\r\n text . end", "é" * 999,
]


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_transducer_is_the_library_on_random_tokens(ranks, library):
    rnd, tokens = random.Random(5), list(ranks)
    transducer = bpe.Transducer(ranks)
    for _ in range(3000):
        piece = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 5)))
        assert transducer.encode(piece) == library._encode_single_piece(piece)


def test_transducer_emits_after_a_bounded_number_of_bytes(ranks):
    transducer = bpe.Transducer(ranks)
    at, longest = transducer.start, max(map(len, ranks))
    for byte in b"ab" * 2000:
        step = at.next.get(byte) or transducer.build(at, byte)
        at = step[0]
        assert len(at.pending) <= 2 * longest


def test_forgetting_states_and_chunks_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 3)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 5)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    text = "the thing and then the other thing, thinking of nothing in particular " * 20
    assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_whole_texts_and_round_trip(ranks, library):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in TEXTS:
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), text[:20]
        assert bpe.decode_all(ids, encoder.transducer.bytes_of) == text


def test_long_texts_are_cut_where_nothing_joins(ranks, library):
    text = "one two  three\n four five 'll six " * 400
    parts = list(bpe.segments(text, 100))
    assert len(parts) > 50 and "".join(" " * spaced + part for spaced, part in parts) == text
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    ids = [i for x in parts for i in np.frombuffer(encoder.part(*x), np.int32)]
    assert ids == library.encode_ordinary(text)


def test_decoder_holds_back_unfinished_characters():
    bytes_of = [bytes((i,)) for i in range(256)]
    data = "aé日🙂".encode() + b"\xff\x80" + "é".encode()[:1]
    decoder = bpe.StreamDecoder(bytes_of)
    parts = [decoder.feed([b]) for b in data]
    assert "".join(parts[:10]) == "aé日🙂" and parts[1] == "" and parts[2] == "é"
    assert "".join((*parts, decoder.end())) == data.decode("utf-8", "replace")


def test_state_machine_accepts_exactly_utf8():
    rnd = random.Random(2)
    for _ in range(20000):
        data = bytes(rnd.choice((0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC1, 0xC3, 0xE0, 0xED, 0xEF, 0xF0, 0xF4, 0xF5)) for _ in range(rnd.randint(1, 5)))
        state = 0
        for byte in data:
            state = bpe.MACHINE[state][byte]
            if state < 0:
                break
        try:
            data.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        assert (state == 0) == valid


def test_lengths_are_the_librarys():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        model = counts.load(file.read())
    lengths = counts.Lengths({"the": 1}, model)
    for text in TEXTS:
        assert lengths.total(text) == len(model.encode(text, add_special_tokens=False)), text[:20]


def test_simhash_is_the_majority_of_bits():
    for text in ("", "one", "A b c", "a B c d", "x y z x y z x y z w " * 40):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashed = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))
        assert simhash.simhash(text) == (want if words else 0)


@pytest.mark.parametrize("held", [10**9, 3000])
def test_ball_hashing_connects_what_all_pairs_connect(monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD_VARIANTS", held)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(4)]))
    a, b = np.triu_indices(len(values), 1)
    near = np.bitwise_count(values[a] ^ values[b]) <= 4
    want = simhash._forest(len(values), a[near], b[near])
    found = [np.concatenate(x) for x in zip(*simhash._collide(values, 0, 0, 2, 4))]
    assert (simhash._forest(len(values), *found) == want).all()


def test_windows_hash_by_content_only():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    words[120:170] = words[20:70]
    for length in (1, 2, 7, 20, 50):
        found = substrings.windows(words, length)
        assert len(found) == 200 - length + 1 and found[20] == found[120]
        assert len(set(found.tolist())) >= 150 - length


def test_cover_aligns_every_pair_of_offsets():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any(
                (i + d) % substrings.PERIOD in substrings.COVER and (j + d) % substrings.PERIOD in substrings.COVER
                for d in range(substrings.PERIOD)
            )


def test_embedding_is_the_walk_step_by_step():
    text = "a walk over some characters, ünd more"
    codes, at, embedded = edits._codes(text), 0, []
    for step in range(10 * len(text)):
        code = codes[at] if at < len(codes) else 0
        embedded.append(0 if code == 0 else 1 + int(edits._hash(0, 3, code) % np.uint64(16)))
        if code:
            at += int((edits._hash(0, 4, step, code) >> np.uint64(40)) & np.uint64(1))
    found = edits.embed([text, "x", text + "y" * 50])[0]
    for block in range(len(found) // edits.SAMPLES):
        places = edits.sampled(block, 0)
        assert list(found[block * 32 : block * 32 + 32]) == [embedded[p] for p in places]


def test_likeness_falls_with_edits():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(1500)) for _ in range(60)]
    one = [x[:700] + "#" + x[700:] for x in texts]
    half = [edits.edited_text(x, y) for x, y in zip(texts, texts[1:] + texts[:1])]
    found = lambda xs: [np.frombuffer(x, np.uint8) for x in edits.embed(xs)]
    a, b, c, d = found(texts), found(one), found(half), found(texts[1:] + texts[:1])
    mean = lambda x: np.mean([edits.likeness(p, q) for p, q in zip(a, x)])
    assert mean(a) == 1 and mean(b) > 0.85 and 0.5 < mean(c) < 0.75 and mean(d) < 0.3
    empty = np.empty(0, np.uint8)
    assert edits.likeness(empty, empty) == 1 and edits.likeness(a[0], empty) == 0
    assert (edits.unpacked(edits.packed(a[0])) == a[0]).all()
