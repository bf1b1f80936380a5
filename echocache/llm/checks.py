"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from echocache.llm.mixing import DEFAULT_WEIGHT, MAX_EPOCHS
from echocache.llm.quality import (
    CHARACTER_SHARES,
    CLASS_PATTERNS,
    COMMON_SHARES,
    COMMON_WORDS,
    MAX_DISTANCE,
    MAX_REPEAT_PERCENT,
    MIN_WORDS,
    WORD_ENDS,
)

_WORD = "[^\\x20\\x09-\\x0D]+"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _js(counts: str, shares: str) -> str:
    """Jensen-Shannon distance of two lists, counts and thousandths."""
    p, q = f"({counts}[i] / list_sum({counts})::DOUBLE)", f"({shares}[i] / 1000.0::DOUBLE)"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) / 2 ELSE 0 END"
    terms = f"list_transform(range(1, len({counts}) + 1), lambda i: {part(p)} + {part(q)})"
    return f"CASE WHEN list_sum({counts}) > 0 THEN sqrt(greatest(list_sum({terms}), 0)) END"


def quality_sql() -> str:
    classes = ", ".join(
        f"len(regexp_extract_all(t, {_text(p)}))" for p in CLASS_PATTERNS
    )
    shares = [*COMMON_SHARES, 1000 - sum(COMMON_SHARES)]
    cases = lambda f: "CASE lang " + " ".join(f"WHEN '{x}' THEN {f(x)}" for x in COMMON_WORDS)
    least = lambda f: f"least({', '.join(f(x) for x in COMMON_WORDS)})"
    listed = lambda x: "[" + ", ".join(_text(w) for w in COMMON_WORDS[x].split()) + "]"
    counts = lambda x: f"list_transform({listed(x)}, lambda w: len(list_filter(plain, lambda y: y = w)))"
    full = lambda x: f"list_append(c_{x}, greatest(n_words - list_sum(c_{x}), 0))"
    word = lambda x: f"w_{x}"
    char = lambda x: f"h_{x}"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines,
        string_split_regex(lower(t), '{WORD_ENDS}') AS plain,
        [{classes}] AS c FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS j
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM g) WHERE k > 1) GROUP BY 1),
m AS (SELECT s.doc_id, lang, len(w)::BIGINT AS n_words,
        list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        list_append(c, length(t) - list_sum(c)) AS classes,
        {', '.join(f'{counts(x)} AS c_{x}' for x in COMMON_WORDS)}
      FROM s LEFT JOIN r USING (doc_id)),
f AS (SELECT *, {', '.join(f'{full(x)} AS f_{x}' for x in COMMON_WORDS)} FROM m),
h AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        {', '.join(f"{_js(f'f_{x}', str(shares))} AS w_{x}" for x in COMMON_WORDS)},
        {', '.join(f"{_js('classes', str(list(CHARACTER_SHARES[x])))} AS h_{x}" for x in COMMON_WORDS)} FROM f),
v AS (SELECT *, ({cases(char)} ELSE {least(char)} END + {cases(word)} ELSE {least(word)} END) / 2 AS mean FROM h)
SELECT doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(lang IN ({', '.join(_text(x) for x in COMMON_WORDS)}) AND n_words >= {MIN_WORDS} AND mean > {MAX_DISTANCE}, false) AS kept,
       round(mean, 6) AS divergence
FROM v"""


def urls_sql(rules: list[tuple[str, str]]) -> str:
    fits = [
        (x, v, f"(host = {_text(h)} OR ends_with(host, {_text('.' + h)})) AND starts_with(path, {_text('/' + p)})")
        for x, v in sorted(rules, key=lambda r: (-len(r[0]), r[0]))
        for h, _, p in (x.partition("/"),)
    ]
    rule = "CASE " + " ".join(f"WHEN {c} THEN {_text(x)}" for x, _, c in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN {_text(v)}" for _, v, c in fits) + " ELSE 'allow' END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{upper}', '{lower}') AS host,
        regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM p"""


def _share_out(name: str, nodes: str, keys: str, order: str) -> str:
    """Common table expressions that give the rows of ``nodes`` a budget; see ``mixing.share_out``."""
    return f"""
{name}_o AS (SELECT *, coalesce(sum(held) OVER w, 0)::HUGEINT AS held_before,
    (sum(weight) OVER g - coalesce(sum(weight) OVER w, 0))::HUGEINT AS weight_left
  FROM {nodes} WHERE weight > 0
  WINDOW g AS (PARTITION BY {keys}),
    w AS (PARTITION BY {keys} ORDER BY held::DOUBLE / weight::DOUBLE, {order} NULLS FIRST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_f AS (SELECT *, held::HUGEINT * weight_left <= weight * greatest(total - held_before, 0) AS is_full FROM {name}_o),
{name}_s AS (SELECT *, sum(CASE WHEN NOT is_full THEN weight END) OVER g AS shared,
    greatest(total - coalesce(sum(CASE WHEN is_full THEN held END) OVER g, 0), 0)::HUGEINT AS rest
  FROM {name}_f WINDOW g AS (PARTITION BY {keys})),
{name} AS (SELECT *, (CASE WHEN is_full THEN held ELSE weight * rest // shared END)::BIGINT AS budget FROM {name}_s)"""


def mixing_sql(weights: dict[str, int], seed: int) -> str:
    listed = ", ".join(f"({_text(k)}, {w})" for k, w in weights.items())
    weight = f"coalesce(w.weight, {DEFAULT_WEIGHT})::BIGINT AS weight"
    place = "md5(concat({}, ':', {}, ':', doc_id))"
    return f"""
WITH weights(path, weight) AS (VALUES {listed}),
d AS (SELECT doc_id, lang, source, TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) AS number,
        len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens FROM documents),
t AS (SELECT *, CASE WHEN number < 10 THEN 'crawl' WHEN number >= 10 THEN 'curated' ELSE 'unknown' END AS domain FROM d),
every AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY ALL),
none AS (SELECT path FROM weights WHERE weight <= 0),
leaves AS (SELECT * FROM every WHERE concat(domain) NOT IN (SELECT path FROM none)
  AND concat(domain, '/', lang) NOT IN (SELECT path FROM none)
  AND concat(domain, '/', lang, '/', source) NOT IN (SELECT path FROM none)),
n1 AS (SELECT domain, sum(tokens)::BIGINT * {MAX_EPOCHS} AS held, any_value(w.weight) AS given,
         (SELECT sum(tokens) FROM every)::BIGINT AS total
       FROM leaves LEFT JOIN weights w ON w.path = domain GROUP BY domain),
m1 AS (SELECT *, coalesce(given, {DEFAULT_WEIGHT})::BIGINT AS weight, 0 AS root FROM n1),
{_share_out('b1', 'm1', 'root', 'domain')},
n2 AS (SELECT l.domain, l.lang, sum(l.tokens)::BIGINT * {MAX_EPOCHS} AS held FROM leaves l GROUP BY ALL),
m2 AS (SELECT n2.*, {weight}, b1.budget AS total FROM n2 JOIN b1 USING (domain)
       LEFT JOIN weights w ON w.path = concat(n2.domain, '/', n2.lang)),
{_share_out('b2', 'm2', 'domain', 'lang')},
m3 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.tokens * {MAX_EPOCHS} AS held, {weight}, b2.budget AS total
       FROM leaves l JOIN b2 ON b2.domain = l.domain AND b2.lang IS NOT DISTINCT FROM l.lang
       LEFT JOIN weights w ON w.path = concat(l.domain, '/', l.lang, '/', l.source)),
{_share_out('b3', 'm3', 'domain, lang', 'source')},
plan AS (SELECT domain, lang, source, tokens,
           CASE WHEN tokens > 0 THEN least(budget // tokens, {MAX_EPOCHS}) ELSE 0 END AS whole, budget FROM b3 WHERE budget > 0),
rows AS (SELECT t.*, whole, budget - whole * tokens AS rest, {place.format(seed, 'whole')} AS place
         FROM t JOIN plan p ON p.domain = t.domain AND p.lang IS NOT DISTINCT FROM t.lang AND p.source IS NOT DISTINCT FROM t.source),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rows),
taken AS (SELECT *, whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS times FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, times::BIGINT)) AS epoch FROM taken"""
