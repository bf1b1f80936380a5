import math

import pytest

from echocache import schema as S
from echocache.functions import embed as EM
from echocache.functions import text as TX
from echocache.functions import vectors as V
from echocache.operators import validate as VA
from tests.rows import entries, requests

SPACES = [chr(c) for c in range(0x3100) if chr(c).isspace()]


def test_clean_strips_what_python_strips(spark):
    texts = ["  a b ", "\t\nx\r\n", "", "   ", None, "a"] + [f"{c}a{c}b{c}" for c in SPACES]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.c for r in rows.select(TX.clean("t").alias("c")).collect()]
    assert got == [None if t is None else t.strip() for t in texts]


def test_filled(spark):
    rows = spark.createDataFrame([("a",), (" \n",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(TX.is_filled("t")).collect()] == [True, False, False, False]


@pytest.mark.parametrize("vector,reason", [
    ([1.0, 0.0], None), ([], S.VECTOR_EMPTY), (None, S.VECTOR_EMPTY), ([0.0, -0.0], S.VECTOR_ZERO),
    ([1.0, math.nan], S.VECTOR_NOT_FINITE), ([math.inf], S.VECTOR_NOT_FINITE),
    ([1.0, None], S.VECTOR_NOT_FINITE), ([1e-200, 0.0], S.VECTOR_ZERO),
])
def test_vector_reason(spark, vector, reason):
    rows = spark.createDataFrame([(vector,)], "v array<double>")
    assert rows.select(V.vector_reason("v")).first()[0] == reason


def test_vector_arithmetic(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    got = rows.select(V.norm("a"), V.dot("a", "b"), V.cosine("a", "b"), V.l2sq("a", "b"), V.l2("a", "b")).first()
    assert tuple(got) == pytest.approx((5.0, 24.0, 0.96, 2.0, math.sqrt(2)))


def test_arithmetic_on_unequal_lengths_fails(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match=S.VECTOR_DIMENSION):
        rows.select(V.dot("a", "b")).collect()


def test_cosine_of_zero_fails(spark):
    rows = spark.createDataFrame([([0.0], [4.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match=S.VECTOR_ZERO):
        rows.select(V.cosine("a", "b")).collect()


def test_float32_is_only_approximate(spark):
    rows = spark.createDataFrame([([0.1, 0.2, 0.3],)], "v array<double>")
    got = rows.select(V.to_float32("v")).first()[0]
    assert got != [0.1, 0.2, 0.3] and got == pytest.approx([0.1, 0.2, 0.3])


def test_hash_vector_counts_whole_text(spark):
    long_text = "alpha " * 30000 + "Beta\tbeta\n"
    rows = spark.createDataFrame([(long_text,), ("  ",), (None,), ("beta",)], "prompt string")
    got = [r.vector for r in EM.embed_hash(rows, dim=16).collect()]
    assert all(len(v) == 16 for v in got)
    assert sorted(x for x in got[0] if x) in ([2.0, 30000.0], [30002.0])
    assert sum(got[1]) == sum(got[2]) == 0 and sum(got[3]) == 1
    assert got[0][got[3].index(1.0)] >= 2


def test_user_embedder_sees_clean_prompts_and_loads_once_per_worker(spark):
    def model(batches):
        for prompts in batches:
            yield prompts.map(lambda p: [float(len(p)), 1.0] if p != "none" else [])

    rows = spark.createDataFrame([(" abc ",), ("none",)], "prompt string")
    got = EM.embed_with(rows, model)
    assert [r.vector for r in got.collect()] == [[3.0, 1.0], []]
    _, rejected = VA.split(got, VA.request_reason(with_vector=True))
    assert [r.reject_reason for r in rejected.collect()] == [S.VECTOR_EMPTY]


def test_reason_order_is_prompt_response_vector(spark):
    rows = spark.createDataFrame(
        [("", "", []), ("p", " ", []), ("p", "r", []), ("p", "r", [1.0])],
        "prompt string, response string, vector array<double>",
    )
    got = [r[0] for r in rows.select(VA.entry_reason()).collect()]
    assert got == [S.PROMPT_BLANK, S.RESPONSE_BLANK, S.VECTOR_EMPTY, None]


def test_split_can_fail_instead(spark):
    rows = spark.createDataFrame([("p",), (" ",)], "prompt string")
    valid, rejected = VA.split(rows, VA.request_reason(), on_invalid="error")
    assert rejected.isEmpty()
    with pytest.raises(Exception, match=S.PROMPT_BLANK):
        valid.collect()
    good, _ = VA.split(rows.limit(1), VA.request_reason(), on_invalid="error")
    assert good.count() == 1


def test_dimension_rejects(spark):
    asked = requests(spark, [(1, [1.0, 0.0]), (2, [1.0])]).unionByName(requests(spark, [(3, [1.0])], "other"))
    got = VA.dimension_reason(asked, entries(spark, [(1, [1.0, 0.0])]))
    assert {r.request_id: r.reject_reason for r in got.collect()} == {
        "r1": None, "r2": S.VECTOR_DIMENSION, "r3": None
    }

