"""Matrices in blocks against numpy, with last blocks that are smaller."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseek.operators import moments as mo
from pixelseek.operators.block_matrix import BLOCK, Blocked, whiten_blocks
from tests.test_quantizer import vectors


def table(spark, m, block):
    rows = [
        (i // block, j // block, m[i : i + block, j : j + block].ravel().tolist())
        for i in range(0, len(m), block)
        for j in range(0, len(m), block)
    ]
    return spark.createDataFrame(rows, BLOCK)


def dense(b, df):
    out = np.zeros((b.dim, b.dim))
    rows = df.collect()
    assert len(rows) == b.count**2
    for r in rows:
        i, j = r["bi"] * b.block, r["bj"] * b.block
        out[i : i + b.height(r["bi"]), j : j + b.height(r["bj"])] = np.reshape(r["cells"], (b.height(r["bi"]), b.height(r["bj"])))
    return out


def test_products_and_sums(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 7, 7))
    b = Blocked(7, 3)
    a, c = table(spark, x, 3), table(spark, y, 3)
    assert np.allclose(dense(b, b.multiply(a, c)), x @ y, atol=1e-12)
    assert np.allclose(dense(b, b.combined(a, -2.0, 5.0)), 5 * np.eye(7) - 2 * x)
    assert b.norm(a) == pytest.approx(np.linalg.norm(x)) and b.norm(a, -1.0) == pytest.approx(np.linalg.norm(x - np.eye(7)))


def test_scatter(spark):
    m = np.random.default_rng(1).normal(size=(60, 7))
    v = vectors(spark, m).unionByName(spark.createDataFrame([(99, [1.0]), (98, None)], "vec_id long, vec array<double>"))
    b = Blocked(7, 3)
    assert np.allclose(dense(b, b.scatter(v.repartition(5))), m.T @ m, atol=1e-10)


def test_inverse_root_of_a_badly_scaled_matrix(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    a = (q * np.array([1e4, 10, 1, 0.1, 1e-3])) @ q.T
    a = (a + a.T) / 2
    b = Blocked(5, 3)
    values, found = np.linalg.eigh(a)
    want = (found / np.sqrt(values)) @ found.T
    got = dense(b, b.inverse_root(table(spark, a, 3)))
    assert np.abs(got - want).max() < 1e-6 * np.abs(want).max()


def test_whitening_equals_the_driver_s(spark):
    """64 values in blocks of 16, to 6 digits."""
    rng = np.random.default_rng(3)
    v = vectors(spark, rng.normal(size=(300, 64)) * np.linspace(0.2, 2, 64)).withColumn("label", F.lit(1))
    want = {r["vec_id"]: r["vec"] for r in mo.whiten(v, 64).collect()}
    white = whiten_blocks(v, 64, mo.WHITEN_EPS, 16)
    assert set(white.columns) == {"vec_id", "vec", "label"}
    got = {r["vec_id"]: r["vec"] for r in white.collect()}
    assert set(got) == set(want) and max(np.abs(np.subtract(got[i], want[i])).max() for i in want) < 1e-6
