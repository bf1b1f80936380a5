"""Whitening against eigenvectors of the covariance, and rows that are odd in every way."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from echocache.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"


def by_hand(vectors, scale, shift, k):
    x = np.floor(scale * np.array(vectors, float)).astype(int) + shift
    n, total = len(x), x.sum(axis=0)
    a = x - total / n
    cov = a.T @ a / n
    values, axes = (y[..., ::-1][..., :k] for y in np.linalg.eigh(cov))
    return x, total, a @ axes / np.sqrt(values), values / np.trace(cov), axes


def test_query_by_brute_force(spark):
    got = queries.op11_whitening(spark, FOLDER).toPandas()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet'").fetchall()
    x, total, w, share, _ = by_hand([v for _, v in rows], 1024, 100_000, 8)
    n, ids = len(x), [k for k, _ in rows]
    assert len(got) == 8 * n and set(got.n) == {n}
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    signs = np.sign((table * w).sum(axis=0))
    assert np.abs(table - w * signs).max() < 1e-9
    first = got[got.component == 1].set_index("vec_id").loc[ids]
    assert (first.deviation.to_numpy() == ((n * x - total) ** 2).sum(axis=1)).all()
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, share, rtol=1e-10)
    assert set(got.identity_error) == {got.identity_error[0]} and got.identity_error[0] < 1e-10
    assert abs(np.cov(table.T, bias=True) - np.eye(8)).max() < 1e-10


NAN, INF = float("nan"), float("inf")
ROWS = [
    (1, [1.0, 2.0, 0.5]), (2, [2.0, -1.0, 0.25]), (None, [0.0, 3.0, -4.0]), (2, [2.0, -1.0, 0.25]), (5, [0.5, 0.5, 0.5]),
    (6, None), (7, []), (8, [1.0, 2.0]), (9, [1.0, None, 2.0]), (10, [NAN, 1.0, 1.0]), (11, [INF, 1.0, 1.0]), (12, [1e300, 0.0, 0.0]),
]


def test_odd_rows_are_left_out_and_repeated_ones_count(spark):
    df = spark.createDataFrame(ROWS, "key long, v array<double>").withColumns({c: F.lit("x") for c in ("sums", "n", "width")})
    model = whitening.fit(df, "v", scale=64)
    got = whitening.transform(df, model, "v").collect()
    usable = ROWS[:5]
    x, total, w, _, _ = by_hand([v for _, v in usable], 64, 0, 3)
    assert model.n == 5 and list(model.sums) == total.tolist() and len(model.values) == 3
    assert [r.key for r in got] == [k for k, _ in usable] and got[0].sums == "x"
    assert [int(r.deviation) for r in got] == ((5 * x - total) ** 2).sum(axis=1).tolist()
    assert np.allclose(np.abs([r.whitened for r in got]), np.abs(w), atol=1e-9)


def test_empty_and_constant_tables(spark):
    df = spark.createDataFrame(ROWS, "key long, v array<double>")
    for none in (df.where("key > 100"), df.where("key = 6"), df.where("key = 7"), df.where("key = 10")):
        model = whitening.fit(none, "v")
        assert model is None and whitening.transform(none, model, "v").count() == 0
    same = df.where("key = 2")
    model = whitening.fit(same, "v")
    assert model.trace == 0 and [r.whitened for r in whitening.transform(same, model, "v").collect()] == [[], []]
    with pytest.raises(ValueError, match="whitened"):
        whitening.transform(df.withColumn("Whitened", F.lit(1)), model, "v")


def test_small_eigenvalues_and_dependent_entries(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 4)) * [1000.0, 1.0, 0.01, 0.0]  # the last is constant
    rows = [(i, [*map(float, r), float(r[0])]) for i, r in enumerate(base)]  # and one is repeated
    df = spark.createDataFrame(rows, "key long, v array<double>").repartition(7)
    model = whitening.fit(df, "v", scale=1 << 24)
    x, total, w, share, axes = by_hand([v for _, v in rows], 1 << 24, 0, 3)
    assert len(model.values) == 3 and np.allclose(model.explained, share, rtol=1e-4) and model.identity_error < 1e-4
    assert np.allclose(np.abs((model.components * axes.T).sum(axis=1)), 1, atol=1e-9)


def test_deviations_beyond_64_bits_are_exact(spark):
    n = 5000
    for bits in (18, 20):
        rows = [(i, [float(1 << bits) * (i % 5), -3.0]) for i in range(n)]
        df = spark.createDataFrame(rows, "key long, v array<double>")
        model = whitening.fit(df, "v", scale=1 << 29)
        xs = [[(1 << 29 + bits) * (i % 5), -3 * (1 << 29)] for i in range(n)]
        sums = [sum(x[j] for x in xs) for j in range(2)]
        want = [sum((n * x[j] - sums[j]) ** 2 for j in range(2)) for x in xs]
        got = {r.key: int(r.deviation) for r in whitening.transform(df, model, "v").collect()}
        assert list(model.sums) == sums and [got[i] for i in range(n)] == want and max(want) > 1 << 63
        assert len(model.values) == 1 and model.identity_error < 1e-9


def test_triangular_solve():
    rng = np.random.default_rng(1)
    r, q = np.triu(rng.normal(size=(6, 6))) + 3 * np.eye(6), rng.normal(size=(9, 6))
    assert np.allclose(whitening.solved(q @ r, r), q)

