from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseek.operators import descriptors as ds
from pixelseek.operators import moments as mo
from pixelseek.plans.features import llc_spm_features


def descriptor_table(spark, rows):
    """rows: (image, desc, x, y, d) on 4 x 4 images."""
    full = [(i, n, float(x), float(y), 4, 4, [float(v) for v in d]) for i, n, x, y, d in rows]
    return spark.createDataFrame(
        full, "image_id bigint, desc_id int, x double, y double, width int, height int, d array<double>"
    )


def word_table(spark, matrix):
    return spark.createDataFrame([(i, [float(v) for v in w]) for i, w in enumerate(matrix)], "word_id int, wv array<double>")


def reference_code(x, book, knn, beta):
    d = ((book - x) ** 2).sum(axis=1)
    near = sorted(range(len(book)), key=lambda j: (d[j], j))[:knn]
    z = book[near] - x
    c = z @ z.T
    c = c + np.eye(knn) * beta * np.trace(c)
    w = np.linalg.solve(c, np.ones(knn))
    return dict(zip(near, w / w.sum()))


@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_codes_equal_a_direct_solve(spark, max_bytes):
    rng = np.random.default_rng(0)
    x, book = rng.normal(size=(30, 6)), rng.normal(size=(12, 6))
    desc = descriptor_table(spark, [(0, n, 1, 1, row) for n, row in enumerate(x)])
    got = {}
    for r in ds.llc_code(desc, word_table(spark, book), max_bytes=max_bytes).collect():
        got.setdefault(r.desc_id, {})[r.word_id] = r.w
    for n, row in enumerate(x):
        want = reference_code(row, book, 5, 1e-4)
        assert got[n].keys() == want.keys()
        assert [got[n][j] for j in want] == pytest.approx(list(want.values()))
        assert sum(got[n].values()) == pytest.approx(1)


def test_words_equal_to_descriptor_share(spark):
    desc = descriptor_table(spark, [(0, 0, 1, 1, [1, 1])])
    codes = ds.llc_code(desc, word_table(spark, [[1, 1], [1, 1]]), knn=2).collect()
    assert [r.w for r in codes] == [0.5, 0.5]


def code_table(spark, rows):
    """rows: (image, desc, x, y, slot, word, w)."""
    full = [(i, n, float(x), float(y), 4, 4, s, w, float(v)) for i, n, x, y, s, w, v in rows]
    return spark.createDataFrame(
        full,
        "image_id bigint, desc_id int, x double, y double, width int, height int, slot int, word_id int, w double",
    )


def test_pooling_counts_implicit_zeros(spark):
    codes = code_table(
        spark,
        [(0, 0, 0.5, 0.5, 0, 1, -0.5), (0, 0, 0.5, 0.5, 1, 2, 1.5), (0, 1, 3.5, 3.5, 0, 1, -0.2), (0, 1, 3.5, 3.5, 1, 3, 1.2)],
    )
    got = {(r.bin, r.word_id): r.v for r in ds.spm_pool(codes).collect()}
    raw = {
        (1, 1): -0.2, (1, 2): 1.5, (1, 3): 1.2,
        (2, 1): -0.5, (2, 2): 1.5, (5, 1): -0.2, (5, 3): 1.2,
        (6, 1): -0.5, (6, 2): 1.5, (21, 1): -0.2, (21, 3): 1.2,
    }
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert got == pytest.approx({k: v / norm for k, v in raw.items()})


def test_word_of_some_descriptors_is_not_negative(spark):
    codes = code_table(spark, [(0, 0, 0.5, 0.5, 0, 1, -0.5), (0, 0, 0.5, 0.5, 1, 2, 1.5), (0, 1, 0.6, 0.6, 0, 2, 1.0)])
    assert {r.word_id for r in ds.spm_pool(codes).collect()} == {2}


def test_stored_codes_find_their_positions(spark):
    rng = np.random.default_rng(3)
    desc = descriptor_table(spark, [(i, n, n % 4 + 0.5, n // 4 + 0.5, rng.normal(size=4)) for i in range(3) for n in range(16)])
    codes = ds.llc_code(desc, word_table(spark, rng.normal(size=(8, 4))), 3)
    apart = ds.place(codes.drop(*ds.POSITION), desc)
    a, b = ({(r.image_id, r.bin, r.word_id): r.v for r in ds.spm_pool(c).collect()} for c in (codes, apart))
    assert a == pytest.approx(b)


def test_features_have_unit_norm(spark):
    rng = np.random.default_rng(1)
    desc = descriptor_table(spark, [(i, n, n % 4 + 0.5, n // 4 + 0.5, rng.normal(size=4)) for i in range(5) for n in range(16)])
    features = llc_spm_features(desc, size=6, knn=3, seed=2)
    norms = features.groupBy("image_id").agg(F.sum(F.col("v") * F.col("v")).alias("n")).collect()
    assert len(norms) == 5 and all(r.n == pytest.approx(1) for r in norms)
    assert features.agg(F.max("bin")).first()[0] == 21


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        ds.learn_dictionary(descriptor_table(spark, [(0, 0, 1, 1, [1])]), "median")


def test_length_histogram_ends(spark):
    df = spark.createDataFrame([([float(n)],) for n in range(1, 12)], "d array<double>")
    got = {r.bin: r.n for r in ds.length_histogram(df, 5).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}
    same = spark.createDataFrame([([1.0],), ([1.0],)], "d array<double>")
    assert {r.bin: r.n for r in ds.length_histogram(same, 5).collect()} == {1: 2}


def slow_descriptor(image, x0, y0, patch, sigma):
    """One descriptor by loops over pixels, cells and angles."""
    fx, fy = ds.gradient_filters(sigma)
    half = len(fx) // 2
    out = np.zeros((4, 4, 8))
    for dy in range(patch):
        for dx in range(patch):
            gx = gy = 0.0
            for u in range(-half, half + 1):
                for v in range(-half, half + 1):
                    yy, xx = y0 + dy + u, x0 + dx + v
                    if 0 <= yy < image.shape[0] and 0 <= xx < image.shape[1]:
                        gx += fx[u + half, v + half] * image[yy, xx]
                        gy += fy[u + half, v + half] * image[yy, xx]
            size, theta = math.hypot(gx, gy), math.atan2(gy, gx)
            for cx in range(4):
                for cy in range(4):
                    step = patch / 4
                    wx = max(0, 1 - abs(dx - ((cx + 0.5) * step - 0.5)) / step)
                    wy = max(0, 1 - abs(dy - ((cy + 0.5) * step - 0.5)) / step)
                    for a in range(8):
                        out[cx, cy, a] += max(math.cos(theta - a * math.pi / 4) ** 9, 0) * size * wx * wy
    return out.ravel()


def test_dense_descriptors_equal_loops(spark):
    rng = np.random.default_rng(8)
    image = rng.random((19, 23))
    df = spark.createDataFrame(
        [("p", 23, 19, image.ravel().tolist()), ("tiny", 3, 3, [0.0] * 9)],
        "image_id string, width int, height int, px array<double>",
    )
    rows = ds.dense_descriptors(df, step=6, patch=8).orderBy("desc_id").collect()
    assert [(r.x, r.y) for r in rows] == [(4.5 + x, 4.5 + y) for x in (1, 7, 13) for y in (2, 8)]
    for r in rows:
        raw = slow_descriptor(image, int(r.x - 4.5), int(r.y - 4.5), 8, 0.8)
        assert r.length == pytest.approx(np.linalg.norm(raw))
        scaled = raw / r.length if r.length >= 1 else raw
        capped = np.minimum(scaled, 0.2)
        want = capped / np.linalg.norm(capped) if r.length >= 1 else capped
        assert r.d == pytest.approx(want.tolist())


def test_flat_image_has_zero_descriptors_inside(spark):
    df = spark.createDataFrame([(0, 40, 40, [0.5] * 1600)], "image_id int, width int, height int, px array<double>")
    rows = {(r.x, r.y): r for r in ds.dense_descriptors(df).collect()}
    assert len(rows) == 25 and rows[20.5, 20.5].length == pytest.approx(0, abs=1e-9)


def test_whitening(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "vec_id int, vec array<double>")
    y = np.array([r.vec for r in mo.whiten(df, 5).orderBy("vec_id").collect()])
    assert y.T @ y == pytest.approx(np.eye(5) * 299, abs=0.1)
    values, vectors = np.linalg.eigh(m.T @ m + 1e-4 * np.eye(5))
    w = np.sqrt(300 + 1e-4 - 1) * vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T
    assert y == pytest.approx(m @ w, abs=1e-8)


def test_standardizer_floor(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([1.0, 4.0],)], "vec array<double>")
    got = {r.i: (r.shift, r["scale"]) for r in mo.fit_standardizer(df, mean=0.5, maxdev=0.5).collect()}
    assert got == {1: (-0.5, 1.0), 2: (-1.5, 0.25)}


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,)], "label int")
    assert {r.label: r.weight for r in mo.class_weights(df).collect()} == pytest.approx({1: 2 / 3, 2: 2.0})


def test_gramian_by_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 7))
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [([1.0],), (None,)], "vec array<double>").repartition(3)
    for block in (2, 3, 7, 100):
        got = {(r.i, r.j): r.x for r in mo.gramian(df, 7, block=block).collect()}
        want = {(i + 1, j + 1): v for (i, j), v in np.ndenumerate(x.T @ x)}
        assert got == pytest.approx(want)
