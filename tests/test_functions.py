from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseek.functions import vector as vf
from pixelseek.functions.codebooks import fetch, fetch_rows, pinned
from pixelseek.functions.hashing import hash32, hash_bucket


def one(spark, col, **arrays):
    df = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} array<double>" for k in arrays))
    return df.select(col.alias("r")).first()["r"]


def test_chi2_skips_zero_sums(spark):
    d = one(spark, vf.chi2(F.col("a"), F.col("b")), a=[0.0, 1.0, 2.0], b=[0.0, 3.0, 2.0])
    assert d == pytest.approx((4 / 4) / 2)


def test_l2_forms_agree(spark):
    a, b = [1.0, -2.0, 3.5], [0.5, 4.0, -1.0]
    want = float(((np.array(a) - b) ** 2).sum())
    assert one(spark, vf.l2sq(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)
    assert one(spark, vf.l2sq_by_norms(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_low_high_of_nothing(spark):
    assert one(spark, vf.array_low(F.col("a")), a=[]) == 0.0
    assert one(spark, vf.array_high(F.col("a")), a=[]) == 0.0


def test_minmax_without_spread_is_null(spark):
    assert spark.range(1).select(vf.minmax(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("r")).first()["r"] is None


def test_l2_normalize_leaves_small_rows(spark):
    assert one(spark, vf.l2_normalize(F.col("a"), 5.0), a=[3.0, 4.0]) == pytest.approx([3.0, 4.0])
    assert one(spark, vf.l2_normalize(F.col("a")), a=[1e-9, 0.0]) == [1e-9, 0.0]


@pytest.mark.parametrize("a", [[0.0, 0.0], [0.3, 0.4], [0.6, 0.8], [3.0, 0.1]])
def test_sift_normalize(spark, a):
    v = np.array(a)
    n = np.linalg.norm(v)
    if n >= 1:
        c = np.minimum(v / n, 0.2)
        want = c / np.linalg.norm(c)
    else:
        want = np.minimum(v, 0.2)
    assert one(spark, vf.sift_normalize(F.col("a")), a=a) == pytest.approx(want.tolist())


def test_softmax_is_stable(spark):
    assert one(spark, vf.softmax(F.col("a")), a=[1000.0, 1000.0]) == pytest.approx([0.5, 0.5])
    assert one(spark, vf.logsumexp(F.col("a")), a=[-1000.0, -1000.0]) == pytest.approx(-1000 + np.log(2))


def test_activations(spark):
    assert one(spark, vf.relu(F.col("a")), a=[-1.0, 2.0]) == [0.0, 2.0]
    assert one(spark, vf.sigmoid(F.col("a")), a=[0.0]) == [0.5]
    assert one(spark, vf.snap(F.col("a")), a=[1e-9, 1e-7]) == [0.0, 1e-7]
    assert one(spark, vf.argmax(F.col("a")), a=[1.0, 3.0, 3.0]) == 2


def test_subvectors_last_takes_rest(spark):
    assert one(spark, vf.subvector_array(F.col("a"), 2), a=[1.0, 2.0, 3.0, 4.0, 5.0]) == [[1.0, 2.0], [3.0, 4.0, 5.0]]


def test_hash_is_md5_prefix(spark):
    row = spark.range(1).select(hash32(3, F.lit("a")).alias("h"), hash_bucket(7, 3, F.lit("a")).alias("b")).first()
    want = int(hashlib.md5(b"3:a").hexdigest()[:8], 16)
    assert (row["h"], row["b"]) == (want, want % 7)


def test_fetch_stops_at_limit(spark):
    df = spark.range(3000).select(F.array(F.lit(1.0), F.lit(2.0)).alias("c"))
    assert len(fetch(df, "c")) == 3000
    assert fetch(df, "c", max_bytes=1000) is None
    assert fetch_rows(df, 2999) is None and len(fetch_rows(df, 3000)) == 3000


def test_pinned_larger_table_stays_distributed(spark):
    df = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("c"))
    assert pinned(df, "c").isLocal()
    big = pinned(df, "c", max_bytes=10)
    assert not big.isLocal() and big.count() == 100


def test_sessions_on_one_machine():
    from pixelseek.functions.codebooks import one_machine

    assert all(map(one_machine, ("local", "local[8]", "local[*]")))
    assert not any(map(one_machine, ("local-cluster[3,2,3000]", "yarn", "spark://host:7077", "k8s://https://host")))
