"""The same queries as SQL over the same tables, for comparison."""

from __future__ import annotations

from echocache import schema as S
from echocache.functions.text import WHITESPACE
from echocache.plans.queries import (
    CHAT_DIM, CHAT_THRESHOLD, EVICT_CAPACITY, LOG_CAPACITY, ORDERED_THRESHOLD, STORE_CAPACITY,
)
from echocache.sources.tables import LATER, START, TURN_BITS, WEIGHTS


def _strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


def _filled(text: str) -> str:
    return f"coalesce(length({_strip(text)}) > 0, false)"


_WEIGHT = "CASE vec_id % 4 " + " ".join(
    f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(WEIGHTS)
) + " END"

_ENTRIES = f"""entries AS (
  SELECT 'c' || label AS collection, 'entry-' || (vec_id + 1) AS id, vec_id AS seq,
         'prompt ' || vec_id AS prompt, 'response ' || vec_id AS response,
         embedding::DOUBLE[] AS v, {START} + vec_id AS created_s,
         {START} + vec_id + vec_id * 7919 % 1000 AS accessed_s
  FROM embeddings)"""

_REQUESTS = f"""requests AS (
  SELECT 'c' || label AS collection, 'r' || vec_id AS request_id, vec_id AS seq,
         {LATER} + vec_id AS ts, 'prompt ' || vec_id AS prompt,
         list_transform(list_zip(v, list_reverse(v)), lambda z: z[1] + z[2] * w) AS v
  FROM (SELECT *, embedding::DOUBLE[] AS v, {_WEIGHT} AS w FROM embeddings))"""

_SCORE = {
    "cosine": "list_cosine_similarity(r.v, e.v)",
    "l2sq": "list_distance(r.v, e.v) ** 2",
    "l2": "list_distance(r.v, e.v)",
}


def _pairs(metric: str, same_collection: bool) -> str:
    on = "r.collection = e.collection" if same_collection else "true"
    sign = "-" if metric == "cosine" else ""
    return f"""pairs AS (
  SELECT r.collection, r.request_id, r.ts, e.seq AS entry_seq, e.id AS entry_id, s AS score,
         row_number() OVER (PARTITION BY r.request_id ORDER BY {sign}round(s, 9), e.seq) AS place
  FROM requests r JOIN entries e ON {on}, LATERAL (SELECT {_SCORE[metric]} AS s))"""


def _best(metric: str, same_collection: bool, threshold: float = 0.8) -> str:
    test = ">=" if metric == "cosine" else "<="
    return f"""{_pairs(metric, same_collection)},
best AS (SELECT * FROM pairs WHERE place = 1 AND score {test} {threshold})"""


def _nearest(metric: str) -> str:
    return f"""WITH {_ENTRIES}, {_REQUESTS}, {_best(metric, False)}
SELECT request_id, entry_seq, round(score, 6) AS score FROM best"""


_TURNS = f"""turns AS (
  SELECT role AS collection, conv_id || '-' || turn AS request_id,
         CASE WHEN conv_id % 10 = 0 THEN ' \t\n' WHEN conv_id % 10 = 1
              THEN '\t  ' || text || '  \n' ELSE text END AS prompt,
         CASE WHEN conv_id % 10 = 2 THEN NULL WHEN conv_id % 10 = 3 THEN '\n' ELSE text END AS response
  FROM conversations)"""

_MARRED = f"""{_REQUESTS}, marred AS (
  SELECT * REPLACE (CASE seq % 50 WHEN 0 THEN []::DOUBLE[] WHEN 1 THEN list_transform(v, lambda x: 0::DOUBLE)
    WHEN 2 THEN v[1:32] WHEN 3 THEN list_append(v, 'nan'::DOUBLE) ELSE v END AS v) FROM requests),
reasons AS (
  SELECT *, CASE WHEN len(v) = 0 THEN '{S.VECTOR_EMPTY}'
    WHEN len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0 THEN '{S.VECTOR_NOT_FINITE}'
    WHEN len(list_filter(v, lambda x: x <> 0)) = 0 THEN '{S.VECTOR_ZERO}' END AS reason FROM marred)"""

_TEXT_REASON = f"""CASE WHEN NOT {_filled('prompt')} THEN '{S.PROMPT_BLANK}'
  WHEN NOT {_filled('response')} THEN '{S.RESPONSE_BLANK}' END"""

_LOG = f"""log AS (
  SELECT user_id::VARCHAR AS collection, event_id AS seq, json_extract_string(props, '$.k') AS key
  FROM events)"""

_LOG_ENTRIES = f"""old AS (
  SELECT user_id::VARCHAR AS collection, 'entry-' || (event_id + 1) AS id, event_id AS seq,
         {START} + event_id + floor(value * 100)::BIGINT AS accessed_s FROM events),
fresh AS (
  SELECT user_id::VARCHAR AS collection, 'new-' || event_id AS id, event_id + {LATER} AS seq,
         {LATER} + event_id AS accessed_s FROM events)"""

_LRU = f"""WITH {_LOG}, again AS (
  SELECT *, lag(seq) OVER (PARTITION BY collection, key ORDER BY seq) AS previous FROM log),
distances AS (
  SELECT a.collection, a.key, a.seq, a.previous, count(DISTINCT b.key) AS between_keys
  FROM again a LEFT JOIN log b
    ON b.collection = a.collection AND b.seq > a.previous AND b.seq < a.seq
  GROUP BY ALL),
marked AS (
  SELECT *, previous IS NOT NULL AND between_keys < {LOG_CAPACITY} AS cache_hit FROM distances),
served AS (
  SELECT *, max(CASE WHEN NOT cache_hit THEN seq END) OVER (
    PARTITION BY collection, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_miss
  FROM marked)
SELECT seq, cache_hit, CASE WHEN cache_hit THEN last_miss ELSE -1 END AS entry_seq FROM served"""


def _evict(order: str) -> str:
    return f"""WITH {_LOG_ENTRIES}, pool AS (
  SELECT *, row_number() OVER (PARTITION BY collection ORDER BY {order}) AS place
  FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh)),
n AS (SELECT collection, count(*) AS n FROM old GROUP BY 1),
k AS (SELECT collection, count(*) AS k FROM fresh GROUP BY 1),
leaving AS (SELECT collection, greatest(0, least(k, n + k - {EVICT_CAPACITY})) AS x FROM n JOIN k USING (collection))
SELECT collection, id, seq FROM pool JOIN leaving USING (collection) WHERE place > x"""


_DIALOGUE = f"""asked AS (SELECT * FROM conversations WHERE role = 'user'),
dialogue AS (
  SELECT a.conv_id || '-' || a.turn AS request_id, (a.conv_id << {TURN_BITS}) + a.turn AS seq,
         {_strip("concat_ws(' ', b.text, a.text)")} AS prompt, c.text AS response
  FROM asked a
  LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
  LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 1 AND c.role = 'assistant'),
recorded AS (
  SELECT prompt, arg_min(response, seq) AS response FROM dialogue WHERE response IS NOT NULL GROUP BY 1)"""

_PAIRS_ASKED = """SELECT conv_id, turn, text AS prompt, next_text AS response
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'"""


def _buckets(name: str, source: str, key: str, text: str) -> str:
    return f"""{name} AS (
  SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT % {CHAT_DIM} AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT {key}, unnest(string_split_regex(lower({_strip(text)}), '[\\t\\n\\x0b\\f\\r ]+')) AS token FROM {source})
  WHERE token <> '' GROUP BY ALL)"""


def _match(name: str, left: str, right: str) -> str:
    """Best pair per left key between two bucket tables (cosine at the chat threshold)."""
    return f"""{name} AS (
  SELECT q, arg_min(e, (-round(s, 9), e)) AS e, max(s) AS score FROM (
    SELECT q, e, sum(a.n * b.n) / (any_value(x.length) * any_value(y.length)) AS s
    FROM {left} a JOIN {right} b USING (bucket)
    JOIN (SELECT q, sqrt(sum(n * n)) AS length FROM {left} GROUP BY 1) x USING (q)
    JOIN (SELECT e, sqrt(sum(n * n)) AS length FROM {right} GROUP BY 1) y USING (e)
    GROUP BY q, e)
  GROUP BY 1)"""


_CHAT = f"""WITH {_DIALOGUE}, pairs AS ({_PAIRS_ASKED}),
cached AS (SELECT (conv_id << {TURN_BITS}) + turn AS e, prompt, response,
  'entry-' || row_number() OVER (ORDER BY conv_id, turn) AS id FROM pairs),
asks AS (SELECT seq AS q, prompt FROM dialogue),
{_buckets('ask_buckets', 'asks', 'q', 'prompt')},
{_buckets('cache_buckets', 'cached', 'e', 'prompt')},
{_match('best', 'ask_buckets', 'cache_buckets')},
first_run AS (
  SELECT d.request_id, d.seq, d.prompt, b.score >= {CHAT_THRESHOLD} AS hit, b.score, b.e, r.response AS answer
  FROM dialogue d JOIN best b ON b.q = d.seq LEFT JOIN recorded r ON r.prompt = d.prompt),
results AS (
  SELECT f.request_id, f.seq, f.prompt, CASE WHEN hit THEN c.response ELSE answer END AS response, hit AS cache_hit,
         CASE WHEN hit THEN round(score, 6) END AS score, CASE WHEN hit THEN c.id END AS entry_id
  FROM first_run f JOIN cached c ON c.e = f.e WHERE hit OR {_filled('answer')})"""

_SNAPSHOT = f"{_CHAT} SELECT request_id, response, cache_hit, score, entry_id FROM results"

_REPEAT = f"""{_CHAT},
added AS (SELECT seq + (1::BIGINT << 60) AS e, prompt FROM results WHERE NOT cache_hit),
{_buckets('added_buckets', 'added', 'e', 'prompt')},
all_buckets AS (SELECT * FROM cache_buckets UNION ALL SELECT * FROM added_buckets),
{_match('second', 'ask_buckets', 'all_buckets')}
SELECT request_id, cache_hit AS first_hit, s.score >= {CHAT_THRESHOLD} AS second_hit
FROM results r JOIN second s ON s.q = r.seq"""

_EARLIER = "(1::BIGINT << 60)"  # entries come before all requests

_ORDERED = f"""{_CHAT.replace('WITH', 'WITH RECURSIVE', 1)},
present_buckets AS (
  SELECT e - {_EARLIER} AS e, bucket, n FROM cache_buckets UNION ALL SELECT q, bucket, n FROM ask_buckets),
lengths AS (SELECT e, sqrt(sum(n * n)) AS length FROM present_buckets GROUP BY 1),
sims AS MATERIALIZED (
  SELECT a.q AS i, b.e AS j, sum(a.n * b.n) / (any_value(x.length) * any_value(y.length)) AS s
  FROM ask_buckets a JOIN present_buckets b ON b.bucket = a.bucket AND b.e < a.q
  JOIN lengths x ON x.e = a.q JOIN lengths y ON y.e = b.e GROUP BY 1, 2),
steps AS (
  SELECT row_number() OVER (ORDER BY d.seq) AS n, d.seq AS i, d.request_id, d.prompt, r.response AS answer,
         coalesce({_filled('r.response')}, false) AS usable
  FROM dialogue d LEFT JOIN recorded r ON r.prompt = d.prompt WHERE d.seq IN (SELECT q FROM ask_buckets)),
near AS (
  SELECT n, any_value(steps.i) AS i, any_value(usable) AS usable, coalesce(list(j) FILTER (s >= {CHAT_THRESHOLD}), []) AS js
  FROM steps LEFT JOIN sims ON sims.i = steps.i GROUP BY 1),
run(n, stored, state) AS (
  SELECT 0::BIGINT, []::BIGINT[], ''
  UNION ALL
  SELECT near.n,
    CASE WHEN usable AND NOT list_has_any(run.stored, js) AND len(list_filter(js, lambda j: j < 0)) = 0
         THEN list_append(run.stored, near.i) ELSE run.stored END,
    CASE WHEN list_has_any(run.stored, js) OR len(list_filter(js, lambda j: j < 0)) > 0 THEN 'hit'
         WHEN usable THEN 'stored' ELSE 'none' END
  FROM run JOIN near ON near.n = run.n + 1),
decided AS (SELECT steps.*, state FROM steps JOIN run USING (n)),
present AS (
  SELECT e - {_EARLIER} AS j, response, id FROM cached
  UNION ALL SELECT i, answer, 'entry-' || ((SELECT count(*) FROM cached) + row_number() OVER (ORDER BY i))
  FROM decided WHERE state = 'stored'),
served AS (
  SELECT sims.i, arg_min(j, (-round(s, 9), j)) AS j, max(s) AS score FROM sims JOIN present USING (j) GROUP BY 1)
SELECT request_id, CASE WHEN state = 'hit' THEN p.response ELSE answer END AS response, state = 'hit' AS cache_hit,
       CASE WHEN state = 'hit' THEN round(score, 6) END AS score, CASE WHEN state = 'hit' THEN p.id END AS entry_id
FROM decided d LEFT JOIN served v ON v.i = d.i LEFT JOIN present p ON p.j = v.j WHERE state <> 'none'"""

_REPORT_COLUMNS = """count(*) AS requests, count(*) FILTER (cache_hit) AS hits,
  count(*) FILTER (NOT cache_hit) AS misses, count(*) FILTER (NOT cache_hit) AS inserts,
  avg(cache_hit::INT::DOUBLE) AS hit_rate"""

_CHECKS = f"""WITH {_ENTRIES}, {_MARRED},
stored AS (
  SELECT e.collection, CASE WHEN e.seq % 20 = 4 THEN '\t' ELSE e.prompt END AS prompt, e.response, r.v, r.reason,
         e.created_s, e.accessed_s FROM entries e JOIN reasons r ON r.seq = e.seq),
groups AS (
  SELECT collection, count(*) AS n, count(*) FILTER (NOT {_filled('prompt')}) AS prompts,
         count(*) FILTER (NOT {_filled('response')}) AS responses, count(*) FILTER (reason IS NOT NULL) AS vectors,
         min(len(v)) AS low, max(len(v)) AS high, count(*) FILTER (accessed_s < created_s) AS times
  FROM stored GROUP BY 1),
found AS (
  SELECT 'prompts' AS name, sum(prompts) AS x, 'entries with a blank prompt' AS what FROM groups
  UNION ALL SELECT 'responses', sum(responses), 'entries with a blank response' FROM groups
  UNION ALL SELECT 'vectors', sum(vectors), 'entries with an unusable vector' FROM groups
  UNION ALL SELECT 'dimensions', count(*) FILTER (low <> high), 'collections with mixed dimensions' FROM groups
  UNION ALL SELECT 'capacity', count(*) FILTER (n > 40), 'collections over capacity' FROM groups
  UNION ALL SELECT 'times', sum(times), 'entries accessed before creation' FROM groups),
checks AS (
  SELECT name, x = 0 AS healthy, CASE WHEN x = 0 THEN 'no ' || what ELSE what END AS message,
         CASE WHEN x > 0 THEN x::BIGINT || ' found' END AS details FROM found),
lines AS (
  SELECT *, CASE WHEN healthy THEN '[OK] ' ELSE '[FAIL] ' END || name || ': ' || message ||
    coalesce(chr(10) || '       ' || details, '') AS line FROM checks)"""

_DOC_BUCKETS = _buckets("b", "documents", "doc_id", "text")

CHECKS: dict[str, str] = {
    "collection_roundtrip": f"""WITH {_ENTRIES}
SELECT collection, id, seq, prompt, response, v[1] AS first_value, len(v)::INT AS dim, created_s FROM entries""",
    "store_append": f"""WITH {_ENTRIES}, kept AS (SELECT * FROM entries WHERE seq % 50 <> 3),
base AS (SELECT collection, max(seq + 1) AS base FROM entries GROUP BY 1),
fresh AS (
  SELECT k.collection, 'entry-' || (base + row_number() OVER (PARTITION BY k.collection ORDER BY seq)) AS id,
         seq + {LATER} AS seq, prompt, response || ' ' AS response, v, {LATER} + seq AS accessed_s
  FROM kept k JOIN base USING (collection)),
both_sides AS (
  SELECT collection, id, seq, prompt, response, v, accessed_s FROM entries UNION ALL SELECT * FROM fresh)
SELECT collection, id, seq, prompt, response, round(sqrt(list_inner_product(v, v)), 6) AS norm, accessed_s FROM both_sides""",
    "entry_metadata": f"WITH {_ENTRIES} SELECT collection, id, seq, created_s, accessed_s FROM entries",
    "clean_prompts": f"WITH {_TURNS} SELECT request_id, {_strip('prompt')} AS prompt FROM turns",
    "validate_requests": f"""WITH {_TURNS}
SELECT request_id, {_strip('prompt')} AS prompt FROM turns WHERE {_filled('prompt')}""",
    "validate_entries": f"""WITH {_TURNS} SELECT request_id, {_strip('prompt')} AS prompt, response
FROM turns WHERE {_filled('prompt')} AND {_filled('response')}""",
    "validate_vectors": f"WITH {_MARRED} SELECT request_id, reason AS reject_reason FROM reasons",
    "dimension_mismatch": f"""WITH {_MARRED}
SELECT collection, request_id, CASE WHEN len(v) <> 64 THEN '{S.VECTOR_DIMENSION}' END AS reject_reason FROM marred""",
    "rejected_rows": f"""WITH {_TURNS}, {_MARRED}
SELECT collection, request_id, reject_reason
FROM (SELECT *, {_TEXT_REASON} AS reject_reason FROM turns) WHERE reject_reason IS NOT NULL
UNION ALL SELECT collection, request_id, reason FROM reasons WHERE reason IS NOT NULL""",
    "float32_drift": f"""WITH {_ENTRIES}
SELECT seq, list_max(list_transform(v, lambda x: abs(x / 3 - (x / 3)::FLOAT::DOUBLE))) AS drift FROM entries""",
    "vector_norms": f"""WITH {_ENTRIES}
SELECT seq, round(sqrt(list_sum(list_transform(v, lambda x: (x * seq) * (x * seq)))), 6) AS norm FROM entries""",
    "vector_dot": f"""WITH {_ENTRIES}
SELECT seq, round(list_inner_product(v, list_reverse(v)), 6) AS dot FROM entries""",
    "vector_cosine": f"""WITH {_ENTRIES}
SELECT seq, round(list_cosine_similarity(v, list_reverse(v)), 6) AS cosine FROM entries""",
    "vector_l2": f"""WITH {_ENTRIES}
SELECT seq, round(list_distance(v, list_reverse(v)) ** 2, 6) AS l2sq,
       round(list_distance(v, list_reverse(v)), 6) AS l2 FROM entries""",
    "embed_hash": f"""WITH {_DOC_BUCKETS}, shown AS (
  SELECT doc_id, string_agg(bucket || ':' || n::INT, ' ' ORDER BY bucket) AS buckets FROM b GROUP BY 1)
SELECT doc_id, coalesce(buckets, '') AS buckets FROM documents LEFT JOIN shown USING (doc_id)""",
    "embed_model": f"""WITH {_TURNS}, plain AS (SELECT request_id, {_strip('prompt')} AS p FROM turns WHERE {_filled('prompt')})
SELECT request_id, {', '.join(f"(length(p) - length(replace(p, '{c}', '')))::BIGINT AS {c}" for c in 'aeiou')} FROM plain""",
    "nearest_cosine": _nearest("cosine"),
    "nearest_indexed": _nearest("cosine"),
    "nearest_l2sq": _nearest("l2sq"),
    "nearest_l2": _nearest("l2"),
    "top_k_by_cells": f"""WITH {_ENTRIES}, {_REQUESTS}, {_pairs('cosine', False)}
SELECT request_id, entry_seq, round(score, 6) AS score, place::INT AS place FROM pairs WHERE place <= 3""",
    "top_k_matches": f"""WITH {_ENTRIES}, {_REQUESTS}, {_pairs('cosine', False)}
SELECT request_id, entry_seq, round(score, 6) AS score, place::INT AS place FROM pairs WHERE place <= 3""",
    "lookup_result": f"""WITH {_ENTRIES}, {_REQUESTS}, {_best('cosine', True)}
SELECT r.collection, r.request_id, b.entry_id IS NOT NULL AS found, coalesce(e.prompt, '') AS prompt,
       coalesce(e.response, '') AS response, b.entry_id, round(b.score, 6) AS score
FROM requests r LEFT JOIN best b USING (request_id) LEFT JOIN entries e ON e.id = b.entry_id""",
    "lookup_stored_index": f"""WITH {_ENTRIES.replace('FROM embeddings)', 'FROM embeddings WHERE vec_id % 7 <> 2)')}, {_REQUESTS}, {_best('cosine', True)}
SELECT r.collection, r.request_id, b.entry_id IS NOT NULL AS found, coalesce(e.response, '') AS cached_response, b.entry_id,
       round(b.score, 6) AS score
FROM requests r LEFT JOIN best b USING (request_id) LEFT JOIN entries e ON e.id = b.entry_id""",
    "hits_and_misses": f"""WITH {_ENTRIES}, {_REQUESTS}, {_best('l2sq', True)}
SELECT r.request_id, CASE WHEN b.entry_id IS NULL THEN 'miss' ELSE 'hit' END AS branch, b.entry_id
FROM requests r LEFT JOIN best b USING (request_id)""",
    "read_through_mixed_requests": f"""WITH {_ENTRIES}, {_MARRED}, {_best('cosine', True)}
SELECT m.request_id, CASE WHEN problem IS NULL THEN b.entry_id IS NOT NULL END AS cache_hit, problem AS reason
FROM (SELECT *, CASE WHEN seq % 50 = 7 THEN '{S.PROMPT_BLANK}' WHEN reason IS NOT NULL THEN reason
             WHEN len(v) <> 64 THEN '{S.VECTOR_DIMENSION}' END AS problem FROM reasons) m
LEFT JOIN best b USING (request_id)""",
    "nearest_sparse": f"{_CHAT} SELECT request_id, c.id AS entry_id, round(score, 6) AS score FROM first_run f JOIN cached c ON c.e = f.e WHERE hit",
    "ordered_dialogue": _ORDERED,
    "lookup_empty_collection": f"""WITH {_REQUESTS}
SELECT 'unknown-' || collection AS collection, request_id, false AS found, '' AS cached_prompt,
       '' AS cached_response FROM requests""",
    "baseline_policies": f"""WITH {_REQUESTS}, results AS (
  SELECT collection, false AS cache_hit, 'always_miss' AS policy FROM requests
  UNION ALL SELECT collection, true, 'always_hit' FROM requests)
SELECT collection, policy, {_REPORT_COLUMNS} FROM results GROUP BY collection, policy""",
    "touch_entries": f"""WITH {_ENTRIES}, {_REQUESTS}, {_best('cosine', True)},
hit AS (SELECT entry_id, max(ts) AS ts FROM best GROUP BY 1)
SELECT collection, id, seq, greatest(accessed_s, coalesce(ts, 0)) AS accessed_s
FROM entries LEFT JOIN hit ON entry_id = id""",
    "delete_entries": f"""WITH {_ENTRIES}, {_REQUESTS}, {_best('cosine', True)}
SELECT collection, id FROM entries WHERE id NOT IN (SELECT entry_id FROM best)""",
    "entry_counts": "SELECT user_id::VARCHAR AS collection, count(*) AS entries FROM events GROUP BY 1",
    "assign_entry_ids": f"""WITH {_LOG}
SELECT collection, seq, 'entry-' || (row_number() OVER (PARTITION BY collection ORDER BY seq)
  + CASE WHEN collection::BIGINT % 2 = 0 THEN 1000 ELSE 0 END) AS id FROM log""",
    "lru_victim": f"""WITH {_LOG_ENTRIES}
SELECT collection, arg_min(id, (accessed_s, seq)) AS id FROM old GROUP BY 1""",
    "fifo_victim": f"WITH {_LOG_ENTRIES} SELECT collection, arg_min(id, seq) AS id FROM old GROUP BY 1",
    "evict_lru": _evict("accessed_s, seq"),
    "evict_fifo": _evict("seq"),
    "recorded_answers": _PAIRS_ASKED,
    "answer_misses": f"""WITH {_DIALOGUE}
SELECT request_id, r.response FROM dialogue d LEFT JOIN recorded r ON r.prompt = d.prompt""",
    "generate_misses": f"WITH {_DIALOGUE} SELECT request_id, 'answer to ' || prompt AS response FROM dialogue",
    "read_through_snapshot": _SNAPSHOT,
    "stream_snapshot_lookup": _SNAPSHOT,
    "repeat_run_hits": _REPEAT,
    "hit_report": f"""WITH {_ENTRIES}, {_REQUESTS}, {_best('cosine', True)},
results AS (
  SELECT r.collection, b.entry_id IS NOT NULL AS cache_hit FROM requests r LEFT JOIN best b USING (request_id))
SELECT collection, {_REPORT_COLUMNS} FROM results GROUP BY collection""",
    "read_through_ordered": f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings),
sims AS MATERIALIZED (
  SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.v, b.v) AS s
  FROM e a JOIN e b ON b.vec_id < a.vec_id),
nb AS MATERIALIZED (
  SELECT e.vec_id AS i, coalesce(list(j) FILTER (s >= {ORDERED_THRESHOLD}), []) AS nbrs
  FROM e LEFT JOIN sims ON i = e.vec_id GROUP BY 1),
run(i, stored, hit) AS (
  SELECT -1::BIGINT, []::BIGINT[], false
  UNION ALL
  SELECT nb.i,
         CASE WHEN list_has_any(run.stored, nb.nbrs) THEN run.stored ELSE list_append(run.stored, nb.i) END,
         list_has_any(run.stored, nb.nbrs)
  FROM run JOIN nb ON nb.i = run.i + 1),
kept AS (SELECT i FROM run WHERE i >= 0 AND NOT hit),
serving AS (
  SELECT s.i, arg_min(j, (-round(s, 9), j)) AS j, max(s) AS s FROM sims s JOIN kept k ON k.i = s.j GROUP BY 1)
SELECT run.i AS seq, hit AS cache_hit, CASE WHEN hit THEN j ELSE -1 END AS entry_seq,
       CASE WHEN hit THEN round(s, 6) END AS score
FROM run LEFT JOIN serving ON serving.i = run.i WHERE run.i >= 0""",
    "lru_exact_read_through": _LRU,
    "read_through_lru": _LRU,
    "stream_bounded_batches": _LRU,
    "read_through_distance": f"""WITH {_ENTRIES}, {_REQUESTS}, {_best('l2sq', True)}
SELECT r.request_id, coalesce(e.response, 'answer to ' || r.prompt) AS response, b.entry_id IS NOT NULL AS cache_hit,
       round(b.score, 6) AS score, b.entry_id
FROM requests r LEFT JOIN best b USING (request_id) LEFT JOIN entries e ON e.id = b.entry_id""",
    "bounded_read_through": f"""WITH {_ENTRIES}, {_REQUESTS}, {_best('cosine', True)},
hit AS (SELECT entry_id, max(ts) AS ts FROM best GROUP BY 1),
old AS (SELECT collection, id, seq, greatest(accessed_s, coalesce(ts, 0)) AS accessed_s
        FROM entries LEFT JOIN hit ON entry_id = id),
base AS (SELECT collection, max(seq + 1) AS base FROM entries GROUP BY 1),
fresh AS (
  SELECT r.collection, 'entry-' || (base + row_number() OVER (PARTITION BY r.collection ORDER BY r.seq)) AS id,
         r.seq + {LATER} AS seq, r.ts AS accessed_s
  FROM requests r JOIN base USING (collection) WHERE r.request_id NOT IN (SELECT request_id FROM best)),
n AS (SELECT collection, count(*) AS n FROM old GROUP BY 1),
k AS (SELECT collection, count(*) AS k FROM fresh GROUP BY 1),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY collection ORDER BY accessed_s, seq) AS place
  FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh))
SELECT collection, id, seq, accessed_s
FROM pool LEFT JOIN n USING (collection) LEFT JOIN k USING (collection)
WHERE place > greatest(0, least(coalesce(k, 0), coalesce(n, 0) + coalesce(k, 0) - {STORE_CAPACITY}))""",
    "stream_read_through_exact": _LRU,
    "stream_read_through_vectors": _LRU,
    "cache_table_checks": f"{_CHECKS} SELECT name, healthy, message, details, line FROM lines",
    "check_report": f"""{_CHECKS}
SELECT bool_and(healthy) AS all_healthy,
       CASE WHEN bool_and(healthy) THEN 'Setup check passed.' ELSE 'Setup check failed.' END || chr(10) || chr(10)
       || string_agg(line, chr(10) ORDER BY name) AS report FROM lines""",
}
