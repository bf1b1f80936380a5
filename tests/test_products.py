"""Products in single precision choose, full ones decide: the pairs of comparing everything in double."""

import numpy as np
import pytest

from echocache.operators import blockjoin as B


def by_hand(left, right, metric, k, floor, left_seq, right_seq):
    out = set()
    near = B.exact_closeness(left, right, metric)
    for i in range(len(left)):
        allowed = [j for j in range(len(right)) if near[i, j] >= floor and (left_seq is None or right_seq[j] < left_seq[i])]
        out |= {(i, j, near[i, j]) for j in sorted(allowed, key=lambda j: (-near[i, j], j))[:k]}
    return out


def rows(rng, n, metric):
    """Near copies that single precision cannot tell apart, copies, and token counts."""
    base = rng.integers(0, 4, (n, 12)).astype(float)
    base[:, 0] += 1
    near = base[rng.integers(0, n, n)] + rng.normal(size=(n, 12)) * 1e-8 * (rng.random((n, 1)) < 0.5)
    return B.points(np.vstack([base, near]), metric)


@pytest.mark.parametrize("metric, floor", [("cosine", 0.9), ("cosine", 1.0), ("cosine", -np.inf), ("l2sq", -1.0), ("l2sq", -np.inf)])
@pytest.mark.parametrize("k", [1, 3, 1000])
@pytest.mark.parametrize("before", [False, True])
def test_best_pairs(monkeypatch, metric, floor, k, before):
    rng = np.random.default_rng(7)
    left, right = rows(rng, 60, metric), rows(np.random.default_rng(7), 60, metric)
    seqs = (rng.integers(0, 130, len(left)), np.sort(rng.choice(130, len(right), False))) if before else (None, None)
    want = by_hand(left, right, metric, k, floor, *seqs)
    score = {(i, j): x for i, j, x in want}
    for cells, dense in ((4_000_000, 0.03), (700, 1.0), (700, 0.0)):
        monkeypatch.setattr(B, "_SLICE_CELLS", cells)
        monkeypatch.setattr(B, "DENSE", dense)
        monkeypatch.setattr(B, "TILE", (512, 2_048) if cells > 700 else (7, 11))
        got = list(zip(*(x.tolist() for x in B.best_pairs(left, right, metric, k, floor, *seqs))))
        assert len(got) == len(want)
        assert {(i, j) for i, j, _ in got} == {(i, j) for i, j, _ in want}
        assert all(abs(score[i, j] - x) <= 1e-11 for i, j, x in got)


@pytest.mark.parametrize("metric, floor", [("cosine", 0.9), ("cosine", 1.0), ("l2sq", -1.0)])
@pytest.mark.parametrize("before", [False, True])
def test_some_pairs_find_one_for_each_row_that_has_one(monkeypatch, metric, floor, before):
    monkeypatch.setattr(B, "FIRST_TRIED", 8)
    rng = np.random.default_rng(9)
    left, right = rows(rng, 80, metric), rows(np.random.default_rng(9), 80, metric)[::-1]
    right = np.ascontiguousarray(right[:100])
    seqs = (rng.integers(0, 130, len(left)), np.sort(rng.choice(130, len(right), False))) if before else (None, None)
    every = by_hand(left, right, metric, len(right), floor, *seqs)
    for cells in (4_000_000, 90):
        monkeypatch.setattr(B, "_SLICE_CELLS", cells)
        at, to, near = (x.tolist() for x in B.some_pairs(left, right, metric, floor, *seqs))
        assert sorted(at) == sorted({i for i, _, _ in every}) and {*zip(at, to)} <= {(i, j) for i, j, _ in every}
        assert min(near) >= floor and len(at) < len(every)


def test_a_row_with_a_match_is_not_compared_on(monkeypatch):
    """4,000 rows that have a match among the first few: comparing all would be 32 million pairs."""
    pairs, plain = [], B.closeness

    def counted(left, right, metric):
        pairs.append(len(left) * len(right))
        return plain(left, right, metric)

    monkeypatch.setattr(B, "closeness", counted)
    rng = np.random.default_rng(1)
    left, right = (B.points(1 + 0.1 * rng.normal(size=(n, 16)), "cosine") for n in (4_000, 8_000))
    assert len(B.some_pairs(left, right, "cosine", 0.9)[0]) == 4_000 and sum(pairs) < 2_000_000
    assert B._Products(left, right, "cosine", None, None).quick[0].dtype == np.float32
    del pairs[:]
    seqs = np.arange(0, 8_000, 2), np.arange(8_000)
    B.best_pairs(left, right, "cosine", 1, 0.9, *seqs)  # later rows are not multiplied either
    assert sum(pairs) < 0.6 * 4_000 * 8_000
