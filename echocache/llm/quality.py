"""Quality rules and the divergence of a document from its language.

Two histograms of each document, of character classes and of common words, are compared with the
reference of its language by Jensen-Shannon distance (base 2, so between 0 and 1). A document is
kept if it passes the base rules and the mean of both distances is at most ``MAX_DISTANCE``. The
distance counts only from ``MIN_WORDS`` words on: shorter histograms are mostly noise. A document
in a language without a reference, or in none, has the distances to the nearest of all references,
but only the base rules decide whether it is kept: its script and words say nothing about quality.

Everything is an expression over one row, so nothing is shuffled. Arrays that are used more than
once get a column of their own; repeated windows are found by sorting packed 64-bit numbers, and
only windows whose high hash bits repeat are compared by their whole hash.

Defined results: a null or empty text has no words, all counts are 0, it fails the base rules and
is not kept; its distances are null. Repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocache.llm.tables import words

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_DISTANCE = 50, 50, 0.24

# The most common words of each language, most common first, and their shares of all
# words in thousandths, by rank; the rest of the thousand is every other word.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from",
    "de": "der die und in den von zu das mit sich des für im auf ist ein nicht dem eine als",
    "fr": "de la le et les des en un du une que pour qui est dans sur par au pas avec",
    "es": "de la que el en y los se del las un por una con no su lo para es al",
}
COMMON_SHARES = (62, 36, 26, 20, 16, 14, 12, 11, 9, 8, 8, 7, 6, 6, 6, 5, 5, 5, 4, 4)
# Shares of the character classes of running text in thousandths.
CHARACTER_CLASSES = ("upper", "beyond ASCII", "digit", "space", "punctuation", "symbol", "other")
CHARACTER_SHARES = {
    "en": (14, 1, 1, 167, 23, 1, 793),
    "de": (13, 39, 1, 155, 22, 1, 769),
    "fr": (11, 88, 1, 166, 23, 1, 710),
    "es": (12, 78, 1, 162, 22, 1, 724),
}
CLASS_PATTERNS = (
    "[A-Z]", "[^\\x00-\\x7F]", "[0-9]", "[\\x20\\x09-\\x0D]", "[.,;:!?'\"()/@_+-]",
    "[#*$%&|<>=~^{}\\[\\]\\\\`]",
)
WORD_ENDS = "[\\x20\\x09-\\x0D.,;:!?]+"

#: Low bits of a packed window that hold its place. A text of more than 2^28 words is an error.
_PLACE_BITS = 28


def js_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of counts and shares in thousandths."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def term(a: Column, b: Column) -> Column:
        mid = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / mid) / 2).otherwise(0.0)
        return part(a) + part(b)

    terms = F.zip_with(counts, shares, lambda n, s: term(n / total, s / 1000))
    sum_of = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(sum_of, F.lit(0.0))))


def _longs(values: tuple[int, ...]) -> Column:
    return F.array(*(F.lit(x).cast("long") for x in values))


def _count_of(joined: Column, word: str) -> Column:
    """Times ``word`` stands in a text of words that each have a space before and after."""
    cut = F.replace(joined, F.lit(f" {word} "), F.lit(""))
    return ((F.length(joined) - F.length(cut)) / (len(word) + 2)).cast("long")


def _by_language(lang: Column, of: dict[str, Column], otherwise: Column) -> Column:
    found = F
    for name, column in of.items():
        found = found.when(lang == name, column)
    return found.otherwise(otherwise)


def _judged(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``row``, the whole input row, and ``verdict``. In a struct no input name can clash."""
    out = df.select(F.struct("*").alias("row"))
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    lang = F.col("row")[lang]
    out = out.withColumn("_q_words", words(F.col("row")[text]))
    w = F.col("_q_words")
    n = F.size(w)

    # Windows of three words: hash, and the high bits of the hash packed with the place.
    long = F.raise_error(F.lit(f"a text has more than {1 << _PLACE_BITS} words")).cast("array<bigint>")
    out = out.withColumn(
        "_q_hashes",
        F.when(n > 1 << _PLACE_BITS, long).when(
            n >= 3,
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    low = (1 << _PLACE_BITS) - 1
    # Most texts have no window twice, and are done here.
    out = out.withColumn("_q_twice", F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes"))
    packed = F.transform("_q_hashes", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    none = F.array().cast("array<bigint>")
    out = out.withColumn("_q_packed", F.when(F.col("_q_twice"), F.sort_array(packed)).otherwise(none))
    packed, hashes = F.col("_q_packed"), F.col("_q_hashes")
    high = lambda x: F.shiftright(x, _PLACE_BITS)
    out = out.withColumn(
        "_q_places",
        F.transform(
            F.filter(
                packed,
                lambda x, i: F.coalesce(high(x) == high(F.get(packed, i - 1)), F.lit(False))
                | F.coalesce(high(x) == high(F.get(packed, i + 1)), F.lit(False)),
            ),
            lambda x: x.bitwiseAND(F.lit(low)).cast("int"),
        ),
    )
    places = F.col("_q_places")
    out = out.withColumn(
        "_q_equal",
        F.array_sort(F.transform(places, lambda i: F.struct(hashes[i].alias("h"), i.alias("i")))),
    )
    equal = F.col("_q_equal")
    out = out.withColumn(
        "_q_starts",
        F.sort_array(
            F.transform(
                F.filter(
                    equal,
                    lambda x, i: F.coalesce(x["h"] == F.get(equal, i - 1)["h"], F.lit(False))
                    | F.coalesce(x["h"] == F.get(equal, i + 1)["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    starts = F.col("_q_starts")
    # A window covers three words, or fewer if the next one starts before.
    covered = F.aggregate(
        F.transform(starts, lambda x, i: F.least(F.coalesce(F.get(starts, i + 1) - x, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )

    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = [F.regexp_count(whole, F.lit(p)).cast("long") for p in CLASS_PATTERNS]
    out = out.withColumn("_q_lines", lines).withColumn(
        "_q_classes", F.array(*counts, F.length(whole) - sum(counts[1:], counts[0]))
    )
    listing = lambda found: F.array(*(F.lit(x) for x in found))
    every = sorted({x for listed in COMMON_WORDS.values() for x in listed.split()})
    lists = {name: listing(listed.split()) for name, listed in COMMON_WORDS.items()}
    out = out.withColumn("_q_list", _by_language(lang, lists, listing(every)))
    found = F.filter(
        F.split(F.lower(whole), WORD_ENDS), lambda x: F.array_contains("_q_list", x)
    )
    out = out.withColumn("_q_common", F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")))
    joined = F.col("_q_common")
    out = out.select(
        "row",
        n.cast("long").alias("_q_n"),
        (F.length(whole) - F.col("_q_classes")[3]).cast("long").alias("_q_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("_q_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_dup"),
        covered.alias("_q_repeat"),
        "_q_classes",
        F.struct(*(
            F.array(*(_count_of(joined, x) for x in listed.split())).alias(name)
            for name, listed in COMMON_WORDS.items()
        )).alias("_q_listed"),
    )
    n = F.col("_q_n")
    rest = lambda a: F.greatest(n - F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
    shares = _longs((*COMMON_SHARES, 1000 - sum(COMMON_SHARES)))
    by_words = {
        name: js_distance(F.concat(F.col(f"_q_listed.{name}"), F.array(rest(F.col(f"_q_listed.{name}")))), shares)
        for name in COMMON_WORDS
    }
    by_chars = {name: js_distance(F.col("_q_classes"), _longs(x)) for name, x in CHARACTER_SHARES.items()}
    out = out.select(
        "row",
        F.struct(
            n.alias("n_words"), F.col("_q_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"),
            F.col("_q_dup").alias("n_dup_lines"), F.col("_q_repeat").alias("n_repeat_words"),
            ((n < MIN_WORDS) | (100 * F.col("_q_repeat") > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
            _by_language(lang, by_chars, F.least(*by_chars.values())).alias("char_distance"),
            _by_language(lang, by_words, F.least(*by_words.values())).alias("word_distance"),
            F.coalesce(lang.isin(*COMMON_WORDS), F.lit(False)).alias("referenced"),
        ).alias("_q"),
    )
    mean = (F.col("_q.char_distance") + F.col("_q.word_distance")) / 2
    far = F.coalesce(F.col("_q.referenced") & (F.col("_q.n_words") >= MIN_WORDS) & (mean > MAX_DISTANCE), F.lit(False))
    kept = (~F.col("_q.base_failed") & ~far).alias("kept")
    return out.select("row", F.struct("_q.*", kept).dropFields("referenced").alias("verdict"))


def measure(
    df: DataFrame, *, text: str = "text", lang: str = "lang", out: str = "quality"
) -> DataFrame:
    """Add the struct ``out``: the counts, ``base_failed``, both distances and ``kept``."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out} already; choose another output name")
    return _judged(df, text, lang).select("row.*", F.col("verdict").alias(out))


def accepted(df: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that are kept, with their own columns.

    The number beside the verdict keeps the filter above the projections: pushed below them, it
    would hold a copy of every expression for each use of each column.
    """
    judged = _judged(df, text, lang).withColumn("number", F.monotonically_increasing_id())
    return judged.where("verdict.kept AND number >= 0").select("row.*")
