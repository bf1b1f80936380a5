"""Spelling variants against all pairs, and words that are odd in every way."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echocache.llm import queries, variants
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def counted(rows):
    counts = Counter()
    for key, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_words(words):
    """By a list for every word with a hole in it: words that share one may be near. All pairs of very long words."""
    holes = {"long": {w for w in words if len(w) > 1000}}
    for w in set(words) - holes["long"]:
        for i in range(len(w) + 1):
            holes.setdefault((w[:i], w[i:]), set()).add(w)  # something put in here
            if i < len(w):
                holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for found in holes.values():
        for a in found:
            near[a] |= {b for b in found if one_apart(a, b)}
    return near


def grouped(rows):
    counts = counted(rows)
    near, forms = near_words(counts), {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (n, len(near[w]), forms[w], forms[w] and counts[forms[w]], root)
    return out


def rows_of(df):
    found = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found}
    assert len(out) == len(found)
    return out


def test_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got, want = rows_of(queries.op13_spelling_variants(spark, FOLDER)), grouped([(r.doc_id, r.text) for r in docs])
    assert got == want and sum(x[2] is not None for x in want.values()) > 0


def test_words_of_few_letters_and_of_any_length(spark):
    rng, words = random.Random(4), set()
    for size in (*range(7, 13), 30, 62, 63, 64, 65, 66, 67, 130):
        for _ in range(40 if size < 30 else 6):
            w = "".join(rng.choice("abé" if size < 30 else "ab") for _ in range(size))
            words.add(w)
            for _ in range(3):
                i, c = rng.randrange(len(w)), rng.choice("abé")
                words |= {w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]}
    words |= {"a" * n for n in (7, 8, 9, 20, 63, 64, 65, 66, 500)} | {"ab" * n for n in (4, 5, 32, 33)} | {"ab" * 32 + "a"}
    words = {w for w in words if len(w) >= 7}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long").repartition(5)
    got = variants.near_pairs(df).collect()
    pairs = [tuple(sorted((r.a, r.b))) for r in got]
    near = near_words(words)
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in near for b in near[a] if a < b}
    assert len(pairs) > 2000 and sum(len(b) > variants.LONG for _, b in pairs) > 20


ODD = [
    (1, "Strasse strasse STRASSE strässe strässe"), (2, None), (3, ""), (None, "orphaned orphaned orphanet orphanet"),
    (4, "common " * 300 + "commons commons comnon comnon kommons kommons"), (4, "commons " * 60), (4, "commons " * 60),
    (5, "x" * 150_000 + " " + "x" * 150_000 + " " + "x" * 149_999), (6, "a1b2c3 × ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷"),
    (7, "kommonss kommonss kommmonss kommmonss straße straßen straßen ŁĄCZNIE łącznie"), (8, "Ünïcödé ünïcödé Ünïcödé " * 3),
]


def test_odd_rows_and_clashing_names(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "word", "n", "form", "gram")})
    got, want = rows_of(variants.group_variants(df)), grouped(ODD)
    assert got == want and {w[0] for w in got} >= {"o", "÷", "x", "c"}
    assert variants.group_variants(df.where("doc_id = 2")).count() == 0


def test_chains_of_forms(spark):
    chain = ["chained", "chainedd", "chaineddd", "chainedddd"]
    rows = [(w, 3 * 10**i) for i, w in enumerate(chain)] + [("unrelated", 5)]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(rows)]
    for seed in range(40):  # numbers for which no code point is left out
        keyed = [(seed * 100 + i, x) for i, x in rows]
        if counted(keyed) == {w: 3 * 10**i for i, w in enumerate(chain)} | {"unrelated": 5}:
            break
    got = rows_of(variants.group_variants(spark.createDataFrame(keyed, "doc_id long, text string")))
    assert got == grouped(keyed) and {got[w][4] for w in chain} == {chain[-1]} and got["unrelated"][4] == "unrelated"


def test_pivots_are_rare_apart_and_in_the_prefix():
    ranks = {g: (i, n) for i, (g, n) in enumerate([("cd", 1), ("de", 2), ("ab", 3), ("ef", 9), ("bc", 50), ("fg", 60)])}
    p1, p2, last, prefix = variants.pivots("abcdefg", ranks)
    assert (p1, p2, last, prefix) == (0, 2, 2, [0, 2, 3])  # ab and cd, as cd and de overlap
    with pytest.raises(ValueError):
        variants.group_variants(None, least=3)


def test_counts_are_sent_on_in_bounded_tables(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 3)
    monkeypatch.setattr(variants, "AT_ONCE", 40)
    rows = [(i, " ".join(f"word{chr(97 + j % 7)}word" for j in range(i * 3))) for i in range(20)]
    got = {r.word: r.n for r in variants.counted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == counted(rows)


def test_surrogates_are_no_letters():
    assert brute.lower("ÀA") == "Àa" and variants._runs("ÀAAAAAAÀ", 7) == {"ÀaaaaaaÀ": 1}
