"""Every stage of the pipeline on what its predecessor kept, by SQL or plain Python."""

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from echocache.llm import bpe, queries
from echocache.scratch import materialize
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name, input rows and output rows of each stage."""
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, FOLDER), name)
        found[name] = (docs, out)
        docs = out
    return {name: tuple([r.asDict() for r in df.collect()] for df in pair) for name, pair in found.items()}


def by_sql(rows, name):
    documents = pd.DataFrame(rows)  # noqa: F841  read by its name
    return duckdb.sql(queries.CHECKS[name]).df().to_dict("records")


def in_order(rows):
    return sorted(rows, key=lambda r: (r["doc_id"], r["text"]))


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_duplicates", "source_mixture", "token_ids",
    ]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(r) == columns for name, (_, out) in stages.items() if name != "token_ids" for r in out)


def test_quality_stage(stages):
    rows, out = stages["quality_rules"]
    kept = {r["doc_id"] for r in by_sql(rows, "op9_quality_rules") if r["kept"]}
    assert in_order(out) == in_order(r for r in rows if r["doc_id"] in kept) and len(out) < len(rows)


def test_line_stage(stages):
    rows, out = stages["line_dedup"]
    want = brute.kept_lines({r["doc_id"]: r["text"] for r in rows})
    texts = [r | {"text": want[r["doc_id"]][1], "n_chars": len(want[r["doc_id"]][1])} for r in rows]
    assert in_order(out) == in_order(texts)


def test_near_duplicate_stage(stages):
    rows, out = stages["near_duplicates"]
    groups = brute.simhash_groups({r["doc_id"]: r["text"] for r in rows})
    assert in_order(out) == in_order(r for r in rows if groups[r["doc_id"]] == r["doc_id"])


def test_mixing_stage(stages):
    rows, out = stages["source_mixture"]
    by_id = {r["doc_id"]: r for r in rows}
    want = [by_id[r["doc_id"]] for r in by_sql(rows, "op2_source_mixing")]
    assert in_order(out) == in_order(want)


def test_token_stage(stages):
    rows, out = stages["token_ids"]
    with open(public_tokenizers.path(queries.RANKS), "rb") as file:
        ranks = bpe.read_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = library.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), brute.digest(" ".join(map(str, ids))), brute.digest(r["text"])))
    assert sorted(tuple(r.values()) for r in out) == sorted(want)


PROSE = "the house of the old man and the sea is what it was for all that we know to be a story " * 4
ODD = [
    (1, PROSE, "en", "src1", 5), (2, None, "en", "src2", None), (3, "", None, None, 0), (4, " \n\t", "xx", "", 1),
    (None, PROSE + "and more", "en", None, 9), (5, "one line of a text\nanother line of it\none line of a text", "de", "src12", 9),
    (5, "one line of a text\nanother line of it\none line of a text", "de", "src12", 9), (6, "long " * 60_000, "en", "src3", 9),
    (7, "ünïcödé 🙂 日本\none line of a test", "fr", "srcX", 9),
]


def test_every_stage_takes_odd_and_empty_tables(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), FOLDER).count() == 0
        out = materialize(stage(spark, odd, FOLDER), name)
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert name == "token_ids" or out.columns == odd.columns
        if name == "quality_rules":
            assert not {2, 3, 4} & set(ids)
        if name == "line_dedup":
            text = {r.doc_id: r.text for r in rows}
            assert len(ids) == len(ODD) and text[2] is None and text[3] == "" and text[4] == " \n\t"
            assert text[5] == "one line of a text\nanother line of it" and text[7] == "ünïcödé 🙂 日本"
        if name == "near_duplicates":
            assert len(ids) == len(set(ids)) and len({2, 3, 4} & set(ids)) == 1 and {1, 5, 6} <= set(ids)
        if name == "token_ids":
            assert sorted(map(repr, ids)) == sorted(repr(r[0]) for r in ODD)
            assert [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [0, 0]
