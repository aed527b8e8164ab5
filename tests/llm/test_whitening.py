"""Whitening: the solver against numpy on plain, graded, clustered and broken-up matrices, and whole tables against a plain version."""

import numpy as np
import pytest

from geoledger.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def _bidiagonals():
    random = np.random.default_rng(3)
    for d in (1, 2, 3, 8, 40, 64):
        yield random.standard_normal(d), random.standard_normal(d - 1)
        yield 10.0 ** -random.uniform(0, 8, d), 10.0 ** -random.uniform(0, 8, d - 1)
        yield np.ones(d), np.full(d - 1, 1e-9)
        yield np.ones(d), np.zeros(d - 1)
        yield np.where(np.arange(d) % 3 == 1, 0.0, 1.0), np.where(np.arange(d - 1) % 5 == 2, 0.0, 0.5)
        yield np.zeros(d), np.zeros(d - 1)
        yield np.full(d, 1e-120), np.full(d - 1, 1e-121)


@pytest.mark.parametrize("case", range(42))
def test_values_and_vectors_of_bidiagonal_matrices(case):
    a, b = list(_bidiagonals())[case]
    whole = np.diag(a) + np.diag(b, 1)
    norm = np.linalg.norm(whole, 2)
    want = np.linalg.svd(whole, compute_uv=False)
    assert np.abs(np.sqrt(wh.squared_singular_values(a, b)) - want).max() <= 1e-13 * norm
    values, z = wh.singular_pairs(a, b, len(a))
    kept = np.sqrt(values) > 1e-9 * norm if norm else np.zeros(len(a), dtype=bool)
    z, s = z[:, kept], np.sqrt(values[kept])
    assert np.abs(z.T @ z - np.eye(len(s))).max(initial=0) < 1e-6
    assert np.abs(whole.T @ (whole @ z) - z * s**2).max(initial=0) <= 1e-9 * norm**2


def test_small_values_are_relatively_exact():
    a, b = 10.0 ** -np.arange(0, 24, 2.0), 10.0 ** -np.arange(1, 23, 2.0)
    got = np.sqrt(wh.squared_singular_values(a, b))
    assert abs(np.log(got).sum() - np.log(a).sum()) < 1e-12  # the determinant


def test_bidiagonalisation():
    random = np.random.default_rng(4)
    for shape in ((5, 5), (3, 7), (9, 4), (1, 1)):
        r = random.standard_normal(shape)
        a, b, v = wh.bidiagonal(r)
        assert np.abs(v.T @ v - np.eye(shape[1])).max() < 1e-13
        assert np.allclose((r @ v).T @ (r @ v), (np.diag(a) + np.diag(b, 1)).T @ (np.diag(a) + np.diag(b, 1)), atol=1e-12)


def _check(rows, vectors, components=32):
    """Rows (vec_id, component, ...) against vectors by id; ids are unique here."""
    ids = sorted(vectors)
    x = np.floor(64 * np.array([vectors[i] for i in ids], dtype=np.float64)) + 1_000_000
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    rank = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(rows) == n * rank
    got = np.zeros((n, rank))
    for r in rows:
        at = ids.index(r.vec_id)
        assert r.n == n and r.deviation == sum((n * int(v) - s) ** 2 for v, s in zip(x[at], sums))
        assert abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-9
        got[at, r.component - 1] = r.whitened
    white = got - got.mean(axis=0)
    assert np.abs(white.T @ white / n - np.eye(rank)).max() < 1e-9
    want = centred @ basis[:, :rank] / np.sqrt(values[:rank])
    gaps = np.abs(np.diff(values))[:rank] / values[0]
    for k in range(rank):
        if min([*gaps[max(k - 1, 0):k + 1], 1]) > 1e-6:
            assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-7


def test_given_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(5)
    _check(wh.whiten(df).collect(), {r.vec_id: r.embedding for r in df.collect()})


def test_odd_rows(spark):
    random = np.random.default_rng(5)
    vectors = {k: random.standard_normal(6).astype(np.float32).tolist() for k in range(40)}
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 6, 1), (103, [float("inf")] * 6, None), (104, [], 1),
           (105, [1.0, 2.0], 1), (106, [3e38] * 6, 1)]
    df = spark.createDataFrame([(k, v, 1) for k, v in vectors.items()] + odd, SCHEMA).selectExpr("*", "label AS n", "label AS k", "label AS component")
    _check(wh.whiten(df).collect(), vectors)
    assert wh.whiten(df.where("vec_id >= 100 AND vec_id < 105")).count() == 0
    assert wh.whiten(df.limit(0)).count() == 0 and wh.whiten(df.limit(0)).columns == wh.whiten(df).columns
    assert wh.whiten(df.where("vec_id = 3")).count() == 0  # one row has no variance
    copies = df.where("vec_id < 20").withColumn("vec_id", (df.vec_id + 1000).cast("long")).drop("n", "k", "component")
    _check(wh.whiten(df.where("vec_id < 20").drop("n", "k", "component").unionByName(copies)).collect(),
           {**{k: vectors[k] for k in range(20)}, **{k + 1000: vectors[k] for k in range(20)}})
    assert wh.whiten(df.where("vec_id < 20").withColumn("vec_id", df.vec_id * 0 + None)).where("vec_id IS NULL").count() == 120


def test_equal_variances_and_missing_ones(spark):
    rows = [(2 * k + s, [(1.0 - 2 * s) if j == k else 0.0 for j in range(8)] + [2.0], 0) for k in range(8) for s in (0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    _check(wh.whiten(df).collect(), {r[0]: r[1] for r in rows})


def test_deviations_beyond_a_long_are_null():
    m = wh.Moments(1 << 40, [3] * 2)
    assert m.deviations(np.array([[1 << 30, 0], [0, 0]])).to_pylist() == [None, 18]
    assert wh.Moments(3, [5, 7]).deviations(np.array([[1, 2], [4, 0]])).to_pylist() == [(3 - 5) ** 2 + (6 - 7) ** 2, (12 - 5) ** 2 + 49]


def test_many_factors_are_joined_in_groups(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(wh, "JOINED_BYTES", 3 * 64 * 64 * 8)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(11)
    _check(wh.whiten(df).collect(), {r.vec_id: r.embedding for r in df.collect()})
