"""The whole query of document fingerprints against a walk in plain Python."""

import numpy as np

from echocache.llm import edits, queries
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def walked(text, seed=0):
    """One character after another: at each step a bit of the step and the character says whether to go on."""
    if not text:
        return ""
    codes = [*edits._codes(text).tolist(), 0]
    alphabet = np.arange(256)
    label = [0, *(1 + edits._hash(seed, 3, alphabet) % np.uint64(16)).astype(int).tolist()[1:]]
    out, at, step, block, table, made = [], 0, 0, 0, None, 0
    while True:
        first, length = edits.stretch(block)
        kept = set(edits.sampled(block, seed).tolist())
        for _ in range(length):
            if table is None or step == made + 1024:
                made = step
                bits = edits._hash(seed, 4, np.arange(step, step + 1024)[:, None], alphabet[None, :])
                table = ((bits >> np.uint64(40)) & np.uint64(1)).astype(int).tolist()
            if step in kept:
                out.append(label[codes[at]])
            at += codes[at] and table[step - made][codes[at]]
            step += 1
        block += 1
        if codes[at] == 0:
            return "".join(".0123456789abcdef"[x] for x in out)


def test_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    text = {r.doc_id: r.text or "" for r in docs}
    keys = sorted(text)
    got = {r.doc_id: r for r in queries.op5_fingerprints(spark, FOLDER).collect()}
    assert sorted(got) == keys
    known, like = {}, lambda a, b: edits.likeness(edits.unpacked(a), edits.unpacked(b))
    for i, k in enumerate(keys):
        following = text[keys[(i + 1) % len(keys)]]
        n = len(text[k])
        edited = text[k][: n - n // 2] + following[: n // 2]
        row = got[k]
        assert (row.n_chars, row.edited_sha256) == (n, brute.digest(edited))
        for x in (text[k], edited):
            known[x] = known.get(x) or walked(x)
        assert (row.fingerprint, row.edited_fingerprint) == (known[text[k]], known[edited])
        assert abs(row.near_edited - like(row.fingerprint, row.edited_fingerprint)) < 1e-12
        assert abs(row.near_next - like(row.fingerprint, got[keys[(i + 1) % len(keys)]].fingerprint)) < 1e-12
    # Half of a text like the original tells more than an unrelated neighbour.
    long = [got[k] for k in keys if got[k].n_chars > 200]
    assert np.median([r.near_edited for r in long]) > 0.4 > 0.2 > np.median([r.near_next for r in long])
