"""Whitening against numpy's eigenvectors and exact whole-number sums."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseek.llm import symmetric, whitening
from pixelseek.llm.queries import QUERIES
from tests.llm.helpers import clash

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def whole(v, scale=256):
    return [math.floor(float(np.float32(c)) * scale) for c in v]


def brute(vectors, components=4):
    """(n, sums, eigenvalues, eigenvectors, trace) by numpy."""
    xs = sorted({tuple(whole(v)) for v in vectors})
    sums = [sum(column) for column in zip(*xs)]
    c = np.array(xs, dtype=float) - np.array([s / len(xs) for s in sums])
    cov = c.T @ c / len(xs)
    values, found = np.linalg.eigh(cov)
    return len(xs), sums, values[::-1][:components], found[:, ::-1][:, :components], np.trace(cov)


def check(spark, vectors, rows):
    listed = whitening.fit_list(rows)
    model = whitening.fit(listed)
    n, sums, values, found, trace = brute(vectors)
    assert (model.n, model.sums) == (n, sums)
    assert np.allclose(model.values, values, rtol=1e-10) and np.isclose(model.trace, trace, rtol=1e-12)
    got = {r["vec_id"]: r for r in whitening.whiten(rows, model).collect()}
    assert len(got) == len(vectors)
    for i, v in enumerate(vectors):
        x = whole(v)
        assert int(got[i]["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        want = (np.array(x) - np.array([s / n for s in sums])) @ found / np.sqrt(values)
        assert np.allclose(np.abs(got[i]["whitened"]), np.abs(want), atol=1e-8)
    assert whitening.identity_error(listed, model) < 1e-10
    return model


def test_against_numpy_with_many_copies(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.standard_normal(12) * np.linspace(2, 0.2, 12) for _ in range(300)]
    vectors += [vectors[0]] * 200
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], EMBEDDINGS).repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:  # more tasks than dimensions: some have nothing to fold
        model = check(spark, vectors, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert model.n == 300


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(4)
    vectors = [np.float32(rng.standard_normal(5) * 2.0**30).astype(float) for _ in range(40)]
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], EMBEDDINGS)
    check(spark, vectors, rows)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, -inf, 1.0], [], [1.0], [3e38, 0.0, 0.0]]
    good = [[0.5, 1.0, -1.0], [-0.5, 2.0, 0.25], [0.1, 0.2, 0.3], [-0.0, 0.0, 0.001], [0.5, 1.0, -1.0]]
    data = [(i, v, 0) for i, v in enumerate(odd + good)] + [(None, good[0], 1), (11, good[0], 1)]
    rows = clash(spark.createDataFrame(data, EMBEDDINGS).repartition(3), F).withColumn("deviation", F.lit("x"))
    listed = whitening.fit_list(rows)
    model = whitening.fit(listed)
    assert model.n == 4
    out = whitening.whiten(rows, model)
    assert out.columns == [c for c in rows.columns if c != "deviation"] + ["deviation", "whitened"]
    got = out.collect()
    # Null and non-finite vectors are gone; others of another length or size have no result.
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in got) == [(False, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 11)] + [(True, None)]
    for r in got:
        assert len(r["whitened"]) == 3 and (r["deviation"] is None) == (r["vec_id"] in (4, 5, 6)) == (r["whitened"][0] is None)
        assert r["h"] == "own"


def test_components_without_variance(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0, 2.0], 0) for i in range(4)], EMBEDDINGS)
    listed = whitening.fit_list(rows)
    model = whitening.fit(listed)
    assert model.flat.tolist() == [False, True, True] and model.explained[0] == pytest.approx(1.0)
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in whitening.whiten(rows, model).collect())
    assert whitening.identity_error(listed, model) < 1e-12
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, EMBEDDINGS)
    model = whitening.fit(whitening.fit_list(one))
    assert model.n == 1 and model.flat.all() and whitening.identity_error(whitening.fit_list(one), model) is None
    empty = one.limit(0)
    model = whitening.fit(whitening.fit_list(empty))
    assert model.n == 0 and whitening.whiten(empty, model).count() == 0
    with pytest.raises(ValueError):
        whitening.fit(whitening.fit_list(rows), max_dim=2)


def test_eigenvectors_of_clusters():
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    for values in (np.full(30, 3.0), np.r_[5.0, 5.0, 5.0, np.linspace(1, 0, 27)], np.r_[5.0, 5 - 1e-12, 5 - 1e-6, np.full(27, 0.5)]):
        matrix = (q * values) @ q.T
        matrix = (matrix + matrix.T) / 2
        for a in (matrix, np.diag(values)):
            w, v = symmetric.leading(a, 4)
            assert np.allclose(w, np.sort(values)[::-1][:4], atol=1e-13)
            assert np.abs(a @ v - v * w).max() < 1e-13 and np.abs(v.T @ v - np.eye(4)).max() < 1e-13
    diagonal, off, _ = symmetric.tridiagonal(matrix)
    at = np.array([-1.0, 0.4, 4.9, 6.0])
    assert symmetric.counts_below(diagonal, off, at).tolist() == [0, 0, 27, 30]


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    n, sums, values, _, trace = brute([r["embedding"] for r in vectors])
    got = QUERIES["op11_whitening"](spark, sf_dir).collect()
    assert len(got) == 4 * len(vectors) and {r["component"] for r in got} == {1, 2, 3, 4}
    assert {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-10
    assert {r["component"]: r["explained"] for r in got} == {i + 1: pytest.approx(e / trace) for i, e in enumerate(values)}
