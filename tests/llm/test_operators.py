"""Operators on Spark: brute force, SQL, and rows that are odd in every way."""

import random
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from check import TABLES, canonical
from echocache.llm import (
    bpe,
    buckets,
    checks,
    components,
    counts,
    edits,
    lines,
    mixing,
    quality,
    queries,
    sharding,
    simhash,
    substrings,
    urls,
)
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PASSAGE = " ".join(f"w{i}" for i in range(60))
PROSE = "the house of the old man and the sea is what it was for all that we know to be a story"
ODD = [
    (1, PROSE, "en", "src1", 5), (2, None, "en", "src2", None), (3, "", None, None, 0), (4, "   \n\t ", "xx", "", 1),
    (5, PASSAGE + " tail one", "en", "src11", 9), (5, PASSAGE + " tail one", "en", "src11", 9),
    (6, "head two " + PASSAGE, "de", "src12", 9), (None, PASSAGE + " nobody", "fr", "src3", 9),
    (7, "long " * 40_000, "en", "src1", 9), (8, "x" * 150_000, "es", None, 9),
    (9, "One line here, with words.\nAnother line there.\none LINE here with words", "en", "src2", 9),
    (10, "Another line there.\n\n### ***\n" + PROSE, "en", "src13", 9), (11, "ünïcödé 🙂 日本", "fr", "srcX", 9),
    (12, PROSE + " again", "en", "src1", 9),
]
#: Names that the operators use inside.
CLASHES = (
    "key", "row", "at", "h", "node", "label", "bucket", "of", "doc", "version", "place", "verdict", "leaf", "epoch", "tokens",
    "tie", "number", "size", "range", "fingerprint", "class", "stays", "gone", "split", "kept", "words", "url", "found",
)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def empty(df):
    return df.where("doc_id > 1000000000")


def apply_all(df):
    """Every operator on a table with the columns of documents and more."""
    path, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    return {
        "bpe": lambda: bpe.decode(bpe.encode(df, path, pattern), path, pattern, text="back"),
        "counts": lambda: counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")),
        "edits": lambda: edits.fingerprints(df),
        "lines": lambda: lines.dedup_lines(df),
        "mixing": lambda: queries.mixed(df),
        "quality": lambda: quality.measure(df),
        "accepted": lambda: quality.accepted(df),
        "sharding": lambda: sharding.assign(df, 3, key="doc_id", size="n_chars"),
        "simhash": lambda: simhash.near_duplicates(df),
        "one_of_each": lambda: simhash.without_near_duplicates(df),
        "substrings": lambda: substrings.remove_repeats(df),
        "urls": lambda: urls.judge(df, queries.URL_RULES, url="text").drop("html"),
    }


OPERATORS = (
    "bpe counts edits lines mixing quality accepted sharding simhash one_of_each substrings urls"
).split()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_clashing_names(odd, name):
    df = empty(odd) if name not in ("urls",) else empty(odd).drop("verdict")
    found = apply_all(df)[name]()
    assert found.count() == 0


@pytest.fixture(scope="module")
def plain(odd):
    return odd.drop("verdict")


def rows_by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


def test_odd_bpe(plain):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path(queries.RANKS), "rb").read()),
    )
    found = apply_all(plain)["bpe"]()
    assert found.columns == [*plain.columns, "ids", "back"]
    got = sorted((repr(r.doc_id), r.ids, r.back) for r in found.collect())
    assert got == sorted((repr(r[0]), library.encode_ordinary(r[1] or ""), r[1] or "") for r in ODD)


def test_odd_counts(plain):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows_by_id(apply_all(plain)["counts"](), "n_tokens")
    want = [(r[0], len(model.encode(r[1] or "", add_special_tokens=False))) for r in ODD]
    assert got == sorted(want, key=repr)


def test_odd_quality(plain):
    got = [(r.doc_id, r.quality) for r in apply_all(plain)["quality"]().collect()]
    assert len(got) == len(ODD)
    text = {r[0]: r[1] for r in ODD}
    for key, q in got:
        assert q.n_words == len(brute.words(text[key])) and q.n_repeat_words == brute.repeat_words(text[key])
        assert not (q.kept and q.base_failed)
    kept = {key for key, q in got if q.kept}
    assert rows_by_id(apply_all(plain)["accepted"]()) == sorted(((k,) for k in kept for _ in range([r[0] for r in ODD].count(k))), key=repr)


def test_odd_simhash(plain):
    got = apply_all(plain)["simhash"]().collect()
    last = 1 << 60  # the document without a number may link others, but names no group
    text = {last if r[0] is None else r[0]: r[1] for r in ODD}
    want = brute.simhash_groups(text)
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint % (1 << 64) == brute.shingle_print(text[r.doc_id])
            assert r.component_id == want[r.doc_id]
    one = apply_all(plain)["one_of_each"]()
    kept = [r.doc_id for r in one.collect()]
    assert len(kept) == len(set(kept)) and one.columns == plain.columns
    assert {last if k is None else k for k in kept} == set(want.values())


def test_odd_substrings(plain):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in apply_all(plain)["substrings"]().collect()}
    want = brute.removed_words({r[0]: r[1] for r in ODD if r[0] is not None})
    assert {x for x in got if x[0] is not None} == {(k, *x) for k, x in want.items()}
    assert [x[2] for x in got if x[0] is None] == [0]
    assert want[6][1] == 60  # the passage goes where it comes again


def test_odd_lines(plain):
    found = apply_all(plain)["lines"]()
    assert found.columns == plain.columns
    got = rows_by_id(found, "text")
    text = {r[0]: r[1] for r in ODD if r[0] is not None}
    want = brute.kept_lines(text)
    for key, x in got:
        if key is not None:
            assert x == want[key][1], key
    assert [x for k, x in got if k is None] == [""] and len(got) == len(ODD)  # like the line of 5


def test_odd_edits(plain):
    got = apply_all(plain)["edits"]().collect()
    assert sorted(repr((r.doc_id, r.n_chars)) for r in got) == sorted(repr((r[0], len(r[1] or ""))) for r in ODD)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = {}
    for i, r in enumerate(order):
        x, y = r[1] or "", order[(i + 1) % len(order)][1] or ""
        want.setdefault(r[0], []).append(edits.edited_text(x, y))
    for r in got:
        assert r.edited in want[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {r.doc_id: r.fingerprint for r in got}
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1 and prints[2] == prints[3] == ""


def test_odd_mixing(plain):
    got = apply_all(plain)["mixing"]().collect()
    times = Counter(r.doc_id for r in got)
    held = sum(len(brute.words(r[1])) for r in ODD)
    assert sum(r.mix.n_tokens for r in got) <= held + max(len(brute.words(r[1])) for r in ODD) * 14
    assert max(times.values()) <= 2 * mixing.MAX_EPOCHS
    assert {r.mix.domain for r in got} <= {"crawl", "curated", "unknown"}


@pytest.mark.parametrize("range_rows", [1, 3, 20_000])
def test_sharding_of_one_hot_key(spark, range_rows):
    rows = [(7, i % 5, "same") for i in range(60)] + [(None, 3, "x"), (1, None, "y"), (9, 500, "z")]
    df = spark.createDataFrame(rows, "key long, size long, note string")
    got = sharding.assign(df, 4, key="key", size="size", range_rows=range_rows).collect()
    assert len(got) == len(rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.key or 0 for r in order] == sorted(r.key or 0 for r in got)
    total, at = sum(r.size or 0 for r in got), 0
    for r in order:
        assert r.shard == min(3, at * 4 // total)
        at += r.size or 0


def test_hot_stretches_of_keys(spark):
    rows = [(i // 3 if i % 7 else None, f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = edits.fingerprints(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter((r[0], edits.edited_text(r[1], order[(i + 1) % 40][1])) for i, r in enumerate(order))
    assert Counter((r.doc_id, r.edited) for r in got) == want


def test_near_documents(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijk") for _ in range(6)) for _ in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(160)) for _ in range(30)]
    near = [x[:400] + "#" + x[400:] for x in base[:10]]
    rows = list(enumerate([*base, *near, base[3], "", None]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = edits.fingerprints(df).select("doc_id", "fingerprint")
    got = {r.doc_id: r.near_id for r in edits.near_documents(prints).collect()}
    assert got[40] == 3 and got[41] == got[42] == 41 and len(got) == 43
    held = {r.doc_id: edits.unpacked(r.fingerprint) for r in prints.collect()}
    groups = brute.Groups(range(43))
    for i in range(43):
        for j in range(i):
            if edits.likeness(held[i], held[j]) >= 0.8:
                groups.join(i, j)
    want = {i: groups.find(i) for i in range(43)}
    assert all(got[i] in (want[i], i) for i in got)
    assert sum(got[i] == want[i] for i in got) >= 40 and sum(want[30 + i] == i for i in range(10)) >= 6


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 99), (99, 98), (5, 5), (None, 3), (200, 100)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 1) for i in range(2, 61)} | {(99, 98), (100, 98), (200, 98)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_buckets_lose_no_link(spark):
    # Numbers are linked if at most two apart; the least of the bucket is near to nothing.
    rows = [(1, n, n) for n in (0, 50, 52, 54, 56, 70, 71, 90)] + [(2, n, n) for n in (56, 58, 70)]
    members = spark.createDataFrame(rows, "bucket long, node long, of long")
    seen = []

    def check(pairs):
        seen.append(pairs)
        return pairs.where("abs(a - b) <= 2")

    got = buckets.linked(members, lambda a, b: F.abs(a - b) < 40, check).collect()
    assert {(r.node, r.component) for r in got} == {(52, 50), (54, 50), (56, 50), (58, 50), (71, 70)}


def test_documents_by_brute_force(spark, texts):
    one = {r.doc_id: r for r in queries.op1_byte_bpe(spark, FOLDER).collect()}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path(queries.RANKS), "rb").read()),
    )
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    four = {r.doc_id: r for r in queries.op4_token_counts(spark, FOLDER).collect()}
    for key, text in texts.items():
        ids = library.encode_ordinary(text)
        assert (one[key].n_tokens, one[key].ids_sha256) == (len(ids), brute.digest(" ".join(map(str, ids))))
        assert one[key].decoded_sha256 == brute.digest(text)
        n = len(model.encode(text, add_special_tokens=False))
        assert (four[key].n_bytes, four[key].n_tokens, four[key].over_limit) == (len(text.encode()), n, n > 1024)


def test_substrings_by_brute_force(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_substring_dedup(spark, FOLDER).collect()}
    assert got == {k: (n, m, brute.digest(x)) for k, (n, m, x) in brute.removed_words(texts).items()}


def test_simhash_by_brute_force(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, FOLDER).collect()}
    want = brute.simhash_groups(texts)
    assert got == {k: (format(brute.shingle_print(texts[k]), "016x"), want[k]) for k in texts}


def test_lines_by_brute_force(spark, texts):
    got = {r.doc_id: (r.n_removed, r.text_sha256) for r in queries.op8_line_dedup(spark, FOLDER).collect()}
    assert got == {k: (n, brute.digest(x)) for k, (n, x) in brute.kept_lines(texts).items()}


def test_lines_one_edit_apart_are_linked(spark, texts):
    plain = sorted({brute.normalised(x) for t in texts.values() for x in (t or "").split("\n")})
    rng, rows = random.Random(3), []
    for low, high in ((10, 30), (31, 39), (40, 41), (42, 120), (121, 199), (201, 600), (601, 3000)):
        fits = [x for x in plain if low <= len(x) <= high]
        for x in rng.sample(fits, min(25, len(fits))):
            at = rng.choice([i for i, c in enumerate(x) if 0 < i < len(x) - 1 and " " not in x[i - 1 : i + 2]])
            y = rng.choice([x[:at] + "q" + x[at:], x[:at] + x[at + 1 :], x[:at] + ("q" if x[at] != "q" else "z") + x[at + 1 :]])
            rows.append((2 * len(rows), x, y))
    df = spark.createDataFrame([r for k, x, y in rows for r in ((k, x), (k + 1, y))], "doc_id long, text string")
    found, grouped = lines.groups(df, "doc_id", "text", lines.SIMILARITY)
    own = {r.text_hash: r.group for r in grouped.collect()}
    group = {r.doc: own[r.text_hash] for r in found.collect()}
    assert all(group[k] == group[k + 1] for k, _, _ in rows) and len(rows) > 120


def test_line_fingerprints(spark):
    found = ["one two three four five six seven", "a" * 700, "ab cd " * 400, "x", " ".join(f"word{i}" for i in range(900)), "ünï " * 9]
    found = [brute.normalised(x) for x in found]
    df = spark.createDataFrame([(x,) for x in found], "plain string").repartition(1)
    bits = {r[0]: r[1] for r in df.select("plain", lines._majority(lines.sample_hashes(F.col("plain")))).collect()}
    assert bits == {x: brute.line_bits(x) for x in found}


def test_lines_of_like_length_and_bits_share_a_key(spark):
    rows = [(1, n, 1 << (n % 60)) for n in range(31, 400)]
    df = spark.createDataFrame(rows, "one int, size int, bits long")
    keyed = {r.size: (r.bits, set(r.k)) for r in df.select("size", "bits", lines.block_keys(F.col("bits"), F.col("size"), 0.9).alias("k")).collect()}
    for a, (x, ka) in keyed.items():
        for b, (y, kb) in keyed.items():
            if a <= b and a >= 0.9 * b - 1e-6:
                assert bool(ka & kb) == brute.two_blocks(x, y)


def test_line_keys_are_those_of_blocks_holes_and_pieces(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("ab ") for _ in range(n)).strip() + "e" for n in (9, 20, 39, 40, 41, 90, 199)]
    rows = base + [x[:i] + rng.choice(["", "b", x[i] + "a"]) + x[i + 1 :] for x in base for i in (0, len(x) // 2, len(x) - 1)]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    got = [(r.x, set(r.h), set(r.p)) for r in df.select("x", lines._hole_keys(F.col("x")).alias("h"), lines._piece_keys(F.col("x")).alias("p")).collect()]
    for a, ha, pa in got:
        for b, hb, pb in got:
            assert bool(ha & hb) == bool(brute.holes(a) & brute.holes(b))
            assert bool(pa & pb) == bool(brute.pieces(a) & brute.pieces(b)), (a, b)
            if brute.edit_distance(a, b) == 1:
                assert ha & hb and pa & pb


def test_methods_made_for_lines_are_short_enough_to_be_compiled(spark, capsys):
    df = spark.createDataFrame([(1, "a line of words")], "doc_id long, text string")
    lines._lines(df, "doc_id", "text").explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000  # longer ones stay bytecode, which the JVM interprets


def test_crowded_buckets_go_another_way(spark, monkeypatch):
    rows = [(b, n, n) for b in range(300) for n in range(b, b + (40 if b == 7 else b % 3))]
    members = spark.createDataFrame(rows, "bucket long, node long, of long")
    plain = {tuple(r) for r in buckets._headed(members).collect()}
    monkeypatch.setattr(buckets, "COUNTED", 1)
    monkeypatch.setattr(buckets, "CROWD", 10)
    monkeypatch.setattr(buckets, "TIMES", 2)
    assert {tuple(r) for r in buckets._headed(members).collect()} == plain
    assert plain == {(b, n, b) for b in range(300) for n in range(b, b + (40 if b == 7 else b % 3)) if b == 7 or b % 3 == 2}


def test_output_names_of_counts_must_be_free(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n_lines long")
    with pytest.raises(ValueError, match="N_lines"):
        lines.dedup_lines(df, lines="N_lines")


def test_clean_text_of_a_language_without_reference_is_kept(spark):
    text = (
        "Утром старый рыбак вышел к реке, чтобы проверить сети и найти лодку, которую унесло ночью далеко от берега. "
        "Его внук шёл рядом и спрашивал, почему вода весной такая мутная и куда улетают птицы, когда становится холодно. "
        "Дед отвечал не сразу, он долго смотрел на другой берег, где стоял лес, и потом рассказывал о том, как жил здесь раньше. "
        "К полудню они вернулись домой, сварили уху, позвали соседей и до самого вечера говорили о погоде и урожае."
    )
    rows = [(1, text, "ru"), (2, text, None), (3, text, "en"), (4, text[:60], "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: (r.quality.kept, r.quality.base_failed) for r in quality.measure(df).collect()}
    assert kept[3] == (False, kept[1][1]) and kept[4] == (False, True)
    assert {r.doc_id for r in quality.accepted(df).collect()} == {k for k, x in kept.items() if x[0]} == {1, 2}


def test_near_copies_of_a_very_long_line_are_linked(spark):
    long = [f"w{i * 7919 % 40_009}" for i in range(33_000)]
    near = [*long[:20_000], "other", *long[20_001:]]
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:16_000]))], "doc_id long, text string")
    got = {r.doc_id: len(r.text.split()) for r in lines.dedup_lines(df).collect()}
    assert got == {1: 33_000, 2: 0, 3: 16_000}


def test_shards_by_brute_force(spark, texts):
    got = {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in queries.op10_sharding(spark, FOLDER).collect()}
    total, at, slots = sum(len(x.encode()) + 1 for x in texts.values()), 0, Counter()
    for key in sorted(texts):
        data = texts[key].encode()
        shard = min(7, at * 8 // total)
        assert got[key] == (len(data) + 1, zlib.crc32(data), shard, slots[shard])
        slots[shard] += 1
        at += len(data) + 1


@pytest.mark.parametrize("name", list(queries.CHECKS))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = canonical(queries.QUERIES[name](spark, FOLDER).toPandas())
    want = canonical(db.sql(queries.CHECKS[name]).df())
    assert list(got.columns) == list(want.columns) and got.map(repr).equals(want.map(repr))


def test_urls_odd(spark):
    found = [
        None, "no scheme", "http://", "http://NET", "http://a.NET/", "http://example.net/en/x?y#z", "x://example.net:80/en/",
        "http://sub.Example.COM/de/", "http://example.com/fr/", "http://o.org/fr/a", "http://badexample.net/en/", "ftp://a.net?b/c://d.org/fr/",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(found)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, queries.URL_RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("net", "", None, "allow"),
        4: ("a.net", "/", "net/", "block"), 5: ("example.net", "/en/x", "example.net/en/", "allow"),
        6: ("example.net:80", "/en/", None, "allow"), 7: ("sub.example.com", "/de/", "example.com/de/", "block"),
        8: ("example.com", "/fr/", None, "allow"), 9: ("o.org", "/fr/a", "org/fr/", "allow"),
        10: ("badexample.net", "/en/", "net/", "block"), 11: ("a.net", "", None, "allow"),
    }


def test_urls_run_only_rules_under_their_rarest_token():
    rule = urls.Rule("example.net/en/", "allow")
    assert rule.tokens() == ["h:example", "h:net", "p:en"]
    assert urls.Rule("a.net/en", "block").tokens() == ["h:a", "h:net"]


def test_mixing_redistributes_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 5), ("c", None, 30)],
        "d string, l string, tokens long",
    )
    got = {
        (r.d, r.l): r.budget
        for r in mixing.budgets(leaves, ["d", "l"], {"a": 50, "b": 40, "c": 10, "a/x": 1, "a/y": 1}, 600, 1).collect()
    }
    # c holds 30 of its 60; the other 30 go to a and b by 5 : 4. In a, y takes what x cannot use.
    assert got == {("a", "x"): 10, ("a", "y"): 306, ("b", "x"): 248, ("b", "y"): 5, ("c", None): 30}


def test_a_weight_of_zero_leaves_its_share_to_others(spark):
    leaves = spark.createDataFrame(
        [("crawl", "en", 1000), ("crawl", "de", 10), ("curated", "en", 1000), ("curated", "de", 1000)], "d string, l string, tokens long"
    )
    weights = {"crawl": 50, "curated": 50, "crawl/en": 0}
    got = {(r.d, r.l): r.budget for r in mixing.budgets(leaves, ["d", "l"], weights, 600, 1).collect()}
    # crawl holds 10 of its 300; the other 290 go to curated.
    assert got == {("crawl", "en"): 0, ("crawl", "de"): 10, ("curated", "en"): 295, ("curated", "de"): 295}


@pytest.mark.parametrize("more", [{}, {"crawl/en": 0}, {"curated": 0}, {"crawl/de/src3": 0, "crawl/en": 0}])
def test_mixing_equals_sql_with_weights_of_zero(spark, docs, more):
    documents = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src3").otherwise("src11")).toPandas()  # noqa: F841
    weights = queries.MIX_WEIGHTS | more
    want = canonical(duckdb.sql(checks.mixing_sql(weights, 5)).df())
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    found = mixing.mix(spark.createDataFrame(documents), queries.mix_levels(), weights, key="doc_id", tokens=n_words, seed=5)
    got = found.select("doc_id", "mix.domain", "mix.lang", "mix.source", "mix.n_tokens", F.col("mix.epoch").cast("long").alias("epoch"))
    got = canonical(got.toPandas())
    assert list(got.columns) == list(want.columns) and got.map(repr).equals(want.map(repr)) and len(got)


def test_quality_equals_sql_on_a_fifth_language(spark, docs):
    documents = docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "ru").when(F.col("doc_id") % 4 == 1, None).otherwise(F.col("lang"))).toPandas()
    want = dict(duckdb.sql(f"SELECT doc_id, kept FROM ({checks.quality_sql()})").fetchall())
    got = {r.doc_id: r.quality.kept for r in quality.measure(spark.createDataFrame(documents)).collect()}
    assert got == want


def test_a_sample_of_splitters_is_bounded(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("key"), F.lit(0).cast("long").alias("tie"), F.col("id").alias("number"),
        F.when(F.col("id") == 7, 10_000_000).otherwise(100).cast("long").alias("size"), F.lit(0).alias("range"),
    )
    cuts = sharding._sample(rows, {0: 20}, 12_000_000, 1)
    assert 5 <= len(cuts) <= 20 and cuts == sorted(cuts)
