"""Whitening against numpy's own eigenvectors of the covariance in extended precision."""

import math

import numpy as np
import pytest

from textloom.llm import whitening
from textloom.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>"


def expected(vectors, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], np.int64)
    n = len(x)
    far = n * x - x.sum(axis=0)
    centred = far.astype(np.longdouble) / n
    cov = (centred.T @ centred / n).astype(float)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [sum(int(c) ** 2 for c in line) for line in far]
    return n, deviation, e, v, centred.astype(float) @ v / np.sqrt(e), e / np.trace(cov)


def compare(rows, vectors, k=8):
    n, deviation, e, v, white, explained = expected([x for _, x in vectors], k)
    assert len(rows) == len(vectors) * k
    got = np.full((len(vectors), k), np.nan)
    place = {i: j for j, (i, _) in enumerate(vectors)}
    for r in rows:
        j = place[r.vec_id]
        assert r.n == n and r.deviation == deviation[j]
        assert abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[r.component - 1]
        assert r.identity_error <= 1e-9
        got[j, r.component - 1] = r.whitened
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got - signs * white).max() < 1e-6


def test_query(spark, folder):
    vectors = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(op13_whitening(spark, folder).collect(), vectors)


def test_left_out_and_repeated_rows(spark):
    draw = np.random.default_rng(2)
    good = [(k, [float(c) for c in draw.standard_normal(12) * np.arange(1, 13)]) for k in range(300)]
    nan, inf = float("nan"), float("inf")
    bad = [(1000, None), (1001, [nan] + [0.0] * 11), (1002, [inf] * 12), (1003, [None] + [1.0] * 11), (1004, []), (1005, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, SCHEMA).repartition(5)
    seen, out = whitening.whitened(df)
    kept = [(i, np.float32(v)) for i, v in good]
    compare(seen.select("vec_id", f"{out}.*").collect(), kept)


def test_clashing_columns_empty_table_and_single_vector(spark):
    schema = "white string, x long, embedding array<double>, i long, c0 string"
    rows = [("a", 1, [1.0, 2.0, 4.0], 3, "z")]
    df = spark.createDataFrame(rows, schema)
    seen, out = whitening.whitened(df)
    assert seen.columns == ["white", "x", "embedding", "i", "c0", out]
    got = seen.collect()
    assert [r[out].component for r in got] == [1, 2, 3]
    assert all(r[out].whitened is None and r[out].deviation == 0 and r[out].explained is None for r in got)
    empty, out = whitening.whitened(df.filter("false"))
    assert empty.columns == seen.columns and empty.collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    seen, out = whitening.whitened(df)
    got = {(r.vec_id, r[out].deviation) for r in seen.collect()}
    far = np.array([[1024 * 10**9, 0], [0, 1024], [0, 2048]], object)
    exact = [sum(c * c for c in line) for line in 3 * far - far.sum(axis=0)]
    assert got == {(k, x if x < 1 << 63 else None) for k, x in enumerate(exact, 1)} and (1, None) in got


@pytest.mark.parametrize("d", [1, 3, 40, 200])
def test_eigenpairs_reach_double_precision(d):
    draw = np.random.default_rng(d)
    q, _ = np.linalg.qr(draw.standard_normal((d, d)))
    values = np.r_[np.full(min(d, 3), 7.0), np.geomspace(5, 1e-5, max(0, d - 3))]
    a = (q * values) @ q.T
    e, v = whitening.eigenpairs(lambda u: a @ u, d)
    k = min(8, d)
    assert np.abs(a @ v - v * e).max() < 1e-14 * 7 and np.abs(v.T @ v - np.eye(k)).max() < 1e-14
    assert np.abs(e - values[:k]).max() < 1e-12


def test_minres_solves_columns_side_by_side():
    draw = np.random.default_rng(5)
    a = draw.standard_normal((30, 30))
    a = a + a.T
    b = draw.standard_normal((30, 4))
    b[:, 2] = 0
    x = whitening.minres(lambda t: a @ t, b, 200)
    assert np.abs(a @ x - b).max() < 1e-8 and not x[:, 2].any()
