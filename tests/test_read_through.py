import pytest
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators import answers as A
from echocache.operators import report as RP
from echocache.plans import read_through as RT
from tests.rows import at, collected, entries, requests


def fixed_vector(rows):
    return rows.withColumn("vector", F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)))


def ask(spark, rows, collection="c"):
    full = [(collection, f"r{seq}", seq, at(1000 + seq), prompt) for seq, prompt in rows]
    return spark.createDataFrame(full, "collection string, request_id string, seq long, ts timestamp, prompt string")


def test_a_miss_generates_and_stores_once(spark):
    out = RT.read_through(
        ask(spark, [(1, " What? ")]), entries(spark, []), RT.fixed_answer(), store="always_miss", embed=fixed_vector
    )
    assert collected(out.results, "prompt", "response", "cache_hit") == [("What?", "generated answer", False)]
    assert collected(out.new_entries, "id", "prompt", "response") == [("entry-1", "What?", "generated answer")]
    report = RP.hit_report(out.results).first()
    assert (report.requests, report.hits, report.misses, report.inserts) == (1, 0, 1, 1)


def test_a_hit_neither_generates_nor_stores(spark):
    out = RT.read_through(
        ask(spark, [(1, "What?")]), entries(spark, []), RT.fixed_answer(), store="always_hit", embed=fixed_vector
    )
    assert collected(out.results, "response", "cache_hit") == [("cached answer", True)]
    assert out.new_entries.isEmpty() and out.touched.isEmpty()
    report = RP.hit_report(out.results).first()
    assert (report.hits, report.misses, report.inserts, report.hit_rate) == (1, 0, 0, 1.0)


def test_second_run_is_all_hits(spark):
    held, asked = entries(spark, []), ask(spark, [(1, "What?")])
    first = RT.read_through(asked, held, RT.fixed_answer("a"), embed=fixed_vector)
    held = RT.apply_to(held, first)
    second = RT.read_through(ask(spark, [(2, "What?")]), held, RT.fixed_answer("b"), embed=fixed_vector)
    assert collected(first.results, "response", "cache_hit") == [("a", False)]
    assert collected(second.results, "response", "cache_hit", "entry_id") == [("a", True, "entry-1")]
    assert second.new_entries.isEmpty()


def test_all_requests_see_the_same_snapshot(spark):
    out = RT.read_through(
        ask(spark, [(1, "same"), (2, "same")]), entries(spark, []), RT.fixed_answer(), embed=fixed_vector
    )
    assert collected(out.results, "cache_hit") == [(False,), (False,)]
    assert collected(out.new_entries, "id", "seq") == [("entry-1", 1), ("entry-2", 2)]


def test_rejects_name_the_reason_and_store_nothing(spark):
    asked = requests(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0], " \t"), (4, [0.0, 1.0])])
    answers = spark.createDataFrame([("prompt 1", "yes"), ("prompt 4", " ")], "prompt string, response string")
    out = RT.read_through(asked, entries(spark, []), RT.from_table(answers))
    assert collected(out.results, "request_id", "response") == [("r1", "yes")]
    assert collected(out.rejected, "request_id", "reject_reason") == [
        ("r2", S.VECTOR_ZERO), ("r3", S.PROMPT_BLANK), ("r4", S.RESPONSE_BLANK)
    ]
    assert collected(out.new_entries, "seq") == [(1,)]


def test_hits_are_touched_and_capacity_holds(spark):
    held = entries(spark, [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2)])
    asked = requests(spark, [(11, [1.0, 0.0]), (12, [-1.0, 0.0])])
    out = RT.read_through(asked, held, RT.fixed_answer())
    kept = RT.apply_to(held, out, max_capacity=2)
    assert collected(kept, "id", "last_accessed_at") == [("entry-1", at(1011)), ("entry-3", at(1012))]


def test_the_generator_is_called_once_per_miss(spark):
    calls = spark.sparkContext.accumulator(0)

    def generator(batches):
        for prompts in batches:
            calls.add(len(prompts))
            yield prompts.str.upper()

    asked = requests(spark, [(i, [1.0, float(i)]) for i in range(5)])
    out = RT.read_through(asked, entries(spark, []), RT.from_generator(generator), threshold=1.0)
    assert out.results.count() == out.new_entries.count() == 5
    assert collected(out.results, "response")[0] == ("PROMPT 0",)
    assert calls.value == 5


def test_equal_misses_are_generated_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def generator(batches):
        for prompts in batches:
            calls.add(len(prompts))
            yield prompts.str.replace("fails", "")

    # A third of all rows has one prompt; one prompt has no answer.
    prompt = lambda i: "hot" if i % 3 == 0 else "fails" if i % 3 == 1 and i < 30 else f"p{i % 7}"
    asked = requests(spark, [(i, [1.0, float(i)], prompt(i)) for i in range(90)])
    out = RT.read_through(asked, entries(spark, []), RT.from_generator(generator), threshold=1.0)
    distinct = {prompt(i) for i in range(90)}
    assert out.results.count() == 80 and {r.response for r in out.results.collect()} == distinct - {"fails"}
    assert calls.value == len(distinct)
    report = RP.hit_report(out.results, out.rejected).first()
    assert (report.requests, report.misses, report.inserts, report.hits) == (90, 90, 80, 0)
    calls.value = 0
    every = RT.read_through(asked, entries(spark, []), RT.from_generator(generator, coalesce=False), threshold=1.0)
    assert every.results.count() == 80 and calls.value == 90


def test_a_hot_prompt_is_answered_in_parts(spark):
    asked = requests(spark, [(i, [1.0, float(i)], "hot" if i % 3 else f"p{i}") for i in range(60)])
    seen = []

    def answer(missed):
        seen.extend(r.seq for r in missed.collect())
        return missed.withColumn("response", F.concat(F.lit("re "), "prompt"))

    got = A.coalesced(asked, answer, hot_rows=4)
    assert sorted(seen) == sorted([1] + [i for i in range(60) if i % 3 == 0])
    assert collected(got, "seq", "response") == [(i, "re hot" if i % 3 else f"re p{i}") for i in range(60)]
    assert got.columns == [*asked.columns, "response"]
    assert A.coalesced(asked.where("false"), answer).count() == 0


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError, match="similarity_threshold"):
        RT.read_through(None, None, None, threshold=-0.1)


def test_recorded_answers_follow_their_question(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"),
         (2, 0, "user", "d"), (2, 1, "user", "e"), (2, 2, "assistant", "f"),
         (3, 5, "user", "g"), (3, 9, "assistant", "h")],
        "conv_id long, turn long, role string, text string",
    )
    assert collected(A.recorded(turns), "prompt", "response") == [("a", "b"), ("e", "f"), ("g", "h")]


def test_one_request_of_another_dimension_is_rejected_alone(spark):
    asked = requests(spark, [(1, [1.0, 0.0]), (2, [1.0])]).withColumn("prompt", F.concat(F.lit("p"), "seq"))
    held = entries(spark, [(7, [1.0, 0.1])])
    out = RT.read_through(asked, held, RT.fixed_answer())
    assert collected(out.results, "request_id", "cache_hit") == [("r1", True)]
    assert collected(out.rejected, "request_id", "reject_reason") == [("r2", S.VECTOR_DIMENSION)]
    with pytest.raises(Exception, match=S.VECTOR_DIMENSION):
        RT.read_through(asked, held, RT.fixed_answer(), on_invalid="error").results.collect()


def test_first_recorded_answer_wins(spark):
    rows = spark.createDataFrame([(2, " p", "late"), (1, "p ", "early")], "seq long, prompt string, response string")
    assert collected(A.answer_table(rows, ["seq"]), "prompt", "response") == [("p", "early")]
