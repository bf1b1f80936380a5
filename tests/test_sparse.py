"""The inverted index for sparse vectors: the rows of comparing all, from few pairs."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echocache import schema as S
from echocache.operators import lookup as L
from echocache.operators import sparse
from echocache.plans import queries as Q
from echocache.sources import tables as TB
from tests.rows import entries, requests


def counts(seed, n, dim=40, words=8):
    """Token counts: some dimensions are in many rows, most in few."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, dim + 1)
    rows = []
    for _ in range(n):
        v = np.zeros(dim)
        np.add.at(v, rng.choice(dim, rng.integers(1, words), p=share / share.sum()), 1)
        rows.append([float(x) for x in v])
    return rows


def found_by(df):
    return sorted((r.collection, r.request_id, r.entry_seq, round(r.score, 10)) for r in df.collect())


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_equals_comparing_with_all(spark, monkeypatch, threshold):
    held = entries(spark, list(enumerate(counts(1, 150)))).unionByName(entries(spark, list(enumerate(counts(2, 40, 12))), "d"))
    asked = requests(spark, [(60 + i, v) for i, v in enumerate(counts(3, 60) + counts(1, 20))]).unionByName(
        requests(spark, [(20 + i, v) for i, v in enumerate(counts(4, 30, 12))], "d")).unionByName(
        requests(spark, [(7, [1.0] * 5)], "none"))
    for before in (False, True):
        want = found_by(L.nearest(asked, held, threshold, before=before, index="none"))
        assert found_by(sparse.nearest_sparse(asked, held, threshold, before)) == want and want
    monkeypatch.setattr(sparse, "HOT_ROWS", 3)  # hot dimensions in many parts
    assert found_by(sparse.nearest_sparse(asked, held, threshold)) == found_by(L.nearest(asked, held, threshold, index="none"))


def test_negative_weights_and_one_hot_rows(spark):
    held = entries(spark, [(1, [1.0, -1.0, 0.0]), (2, [0.0, 0.0, 2.0]), (3, [0.0, 0.0, 5.0]), (4, [-1.0, 1.0, 0.1])])
    asked = requests(spark, [(5, [0.9, -1.0, 0.0]), (6, [0.0, 0.0, 1.0]), (7, [-1.0, -1.0, 0.0]), (8, [-1.0, 1.0, 0.0])])
    got = {r.request_id: r.entry_seq for r in sparse.nearest_sparse(asked, held, 0.8).collect()}
    assert got == {"r5": 1, "r6": 2, "r8": 4}  # of equal ones the earliest


def test_errors_are_those_of_lookup(spark):
    held = entries(spark, [(1, [1.0, 0.0])])
    for wrong, message in (([1.0], S.VECTOR_DIMENSION), ([0.0, 0.0], S.VECTOR_ZERO)):
        with pytest.raises(Exception, match=message):
            sparse.nearest_sparse(requests(spark, [(5, wrong)]), held, 0.8).collect()
    with pytest.raises(ValueError, match="above 0"):
        sparse.nearest_sparse(held, held, 0)
    assert sparse.nearest_sparse(requests(spark, []), held, 0.8).count() == 0
    assert sparse.nearest_sparse(requests(spark, [(5, [1.0, 0.0])]), entries(spark, []), 0.8).count() == 0


def test_candidates_of_the_dialogue_are_few(spark):
    folder = "/root/testdata/sf0.01"
    held = Q._chat_entries(spark, folder)
    asked = Q._chat_embed(TB.dialogue(spark, folder)).where(F.size(F.filter("vector", lambda x: x != 0)) > 0)
    left, right = sparse.scaled_rows(asked, held)
    pairs = sparse.candidates(left, right, Q.CHAT_THRESHOLD).count()
    assert 0 < pairs < 0.1 * left.count() * right.count()
    got = found_by(sparse.nearest_sparse(asked, held, Q.CHAT_THRESHOLD))
    assert got == found_by(L.nearest(asked, held, Q.CHAT_THRESHOLD, index="none")) and len(got) > 50


@pytest.mark.parametrize("group, few", [(4, 1.0), (4, 0.0), (16, 0.05)])
def test_groups_of_dimensions_and_single_pairs_give_all(spark, monkeypatch, group, few):
    monkeypatch.setattr(sparse, "GROUP", group)  # many groups, all, no or some pairs scored one by one
    monkeypatch.setattr(sparse, "FEW", few)
    held, asked = counts(5, 90, 50, 9), counts(6, 50, 50, 9) + counts(5, 20, 50, 9)
    lists = lambda rows: pa.chunked_array([pa.array(
        [[{"dim": i, "w": x / np.linalg.norm(r)} for i, x in enumerate(r) if x] for r in rows],
        pa.list_(pa.struct([("dim", pa.int32()), ("w", pa.float64())])),
    )])
    right = sparse._Lists(lists(held))
    left = sparse._Lists(lists(asked), right.dims, right.place)
    unit = lambda rows: np.array([np.array(r) / np.linalg.norm(r) for r in rows])
    cosine = unit(asked) @ unit(held).T
    for threshold in (0.2, 0.7):
        got = {(int(i), int(j)): x for found in sparse._reaching(left, right, threshold, lambda lo, hi: None) for i, j, x in zip(*found)}
        assert set(got) == set(zip(*np.nonzero(cosine >= threshold - 1e-9)))
        assert max(abs(x - cosine[at]) for at, x in got.items()) < 1e-12


def test_lists_are_shuffled_and_not_pairs(spark):
    """Rows that share all dimensions: a task hands back one row for each request, and no shuffle has a dimension as its key."""
    rng = np.random.default_rng(8)
    held, asked = ([(i, [float(x) for x in rng.integers(1, 9, 12)]) for i in range(n)] for n in (300, 200))
    left, right = sparse.scaled_rows(requests(spark, asked), entries(spark, held))
    assert sparse._compared(left, right, 0.5, False, True).count() <= 200
    found = sparse.nearest_sparse(requests(spark, asked), entries(spark, held), 0.5)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Cogroup" in text.replace("CoGroup", "Cogroup") and not re.search(r"hashpartitioning\([^)]*(dim|entry_seq)#", text)
    assert found.count() == 200
