from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseek.operators import moments as mo
from pixelseek.operators import network as nw
from pixelseek.operators import training as tr
from tests.test_pixels import correlate, pooled, warp


def vectors(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "vec_id bigint, vec array<double>")


def collected(df):
    return np.array([r.vec for r in df.orderBy("vec_id").collect()])


def arrays(weights, layer, part, shape, shift=(1, 1, 0, 0)):
    out = np.zeros(shape)
    for r in weights.where((F.col("layer") == layer) & (F.col("part") == part)).collect():
        out[tuple(v - s for v, s in zip((r.out, r.inp, r.dy, r.dx), shift))] = r.w
    return out


def test_initial_weights_range(spark):
    layers = [
        {"type": "i", "mapsize": (6, 6), "outputmaps": 2},
        {"type": "c", "outputmaps": 4, "kernelsize": (3, 2)},
        {"type": "f", "length": 5},
    ]
    w = nw.init_weights(spark, layers, 1)
    parts = {(r.layer, r.part): r for r in w.groupBy("layer", "part").agg(F.count("*").alias("n"), F.max(F.abs("w")).alias("m")).collect()}
    assert parts[1, "k"].n == 4 * 2 * 6 and parts[2, "w"].n == 5 * 4 * 4 * 5
    for key, fans in (((1, "k"), (2 * 6 + 4 * 6)), ((2, "w"), (80 + 5))):
        assert 0.8 * math.sqrt(6 / fans) < parts[key].m <= math.sqrt(6 / fans)
    assert parts[1, "b"].m == 0 and parts[2, "b"].n == 5
    assert w.exceptAll(nw.init_weights(spark, layers, 1)).count() == 0


@pytest.mark.parametrize("bad", [[{"type": "c"}], [{"type": "i", "mapsize": (2, 2)}, {"type": "x"}]])
def test_bad_layers(bad):
    with pytest.raises(ValueError):
        nw.shapes(bad)


@pytest.mark.parametrize("function", ["soft", "sigm", "relu", "linear", "SVM"])
@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_dense(spark, function, max_bytes):
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(6, 4)), rng.normal(size=(3, 4)), rng.normal(size=3)
    wt = spark.createDataFrame([(o + 1, i + 1, float(v)) for (o, i), v in np.ndenumerate(w)], "out int, inp int, w double")
    bt = spark.createDataFrame([(o + 1, float(v)) for o, v in enumerate(b)], "out int, w double")
    a = (x @ w.T + b) * 0.8
    want = {
        "soft": np.exp(a) / np.exp(a).sum(axis=1, keepdims=True),
        "sigm": 1 / (1 + np.exp(-a)),
        "relu": np.maximum(a, 0),
    }.get(function, a)
    assert collected(nw.dense(vectors(spark, x), wt, bt, function, 0.2, max_bytes)) == pytest.approx(want)


def test_network_equals_numpy(spark):
    layers = [
        {"type": "i", "mapsize": (8, 7), "norm": 3.0},
        {"type": "c", "outputmaps": 3, "kernelsize": (3, 2), "padding": (1, 0), "function": "sigm"},
        {"type": "s", "scale": (2, 2), "function": "max"},
        {"type": "c", "outputmaps": 2, "kernelsize": (2, 2), "function": "relu"},
        {"type": "s", "scale": (2, 2), "stride": (1, 1)},
        {"type": "t", "mapsize": (2, 2)},
        {"type": "f", "length": 4, "function": "relu"},
        {"type": "f", "length": 3, "function": "soft", "dropout": 0.5},
    ]
    weights = nw.init_weights(spark, layers, 4)
    x = np.random.default_rng(2).normal(size=(4, 56))
    got, hidden = (collected(nw.score(vectors(spark, x), layers, weights, h)) for h in (False, True))
    k1 = arrays(weights, 1, "k", (3, 1, 3, 2))
    k3 = arrays(weights, 3, "k", (2, 3, 2, 2))
    w6 = arrays(weights, 6, "w", (4, 8, 1, 1))[:, :, 0, 0]
    w7 = arrays(weights, 7, "w", (3, 4, 1, 1))[:, :, 0, 0]
    for n, row in enumerate(x):
        a = (row * 3 / np.linalg.norm(row)).reshape(1, 8, 7)
        a = 1 / (1 + np.exp(-correlate(a, k1, (1, 0))))
        a = np.array([pooled(m, (2, 2), (2, 2), np.max) for m in a])
        a = np.maximum(correlate(a, k3, (0, 0)), 0)
        a = np.array([pooled(m, (2, 2), (1, 1), np.mean) for m in a])
        cut = []
        for m in a:
            y, z = np.unravel_index(m[: m.shape[0] - 1, : m.shape[1] - 1].argmax(), (m.shape[0] - 1, m.shape[1] - 1))
            cut.append(m[y : y + 2, z : z + 2])
        f = np.maximum(w6 @ np.array(cut).ravel(), 0)
        assert hidden[n] == pytest.approx(f)
        e = np.exp(0.5 * (w7 @ f))
        assert got[n] == pytest.approx(e / e.sum())


def test_standardizing_layers(spark):
    layers = [{"type": "i", "mapsize": (1, 3), "mean": 0, "maxdev": 1}, {"type": "n"}]
    rows = [(n, part, o, 0, 0, 0, v) for n in (0, 1) for part, vals in (("shift", (1.0, 0.0, -1.0)), ("scale", (2.0, 1.0, 3.0))) for o, v in enumerate(vals, 1)]
    weights = spark.createDataFrame(rows, "layer int, part string, out int, inp int, dy int, dx int, w double")
    got = collected(nw.score(vectors(spark, [[1, 2, 3]]), layers, weights))
    assert got.tolist() == [[10.0, 2.0, 15.0]]


def test_fitted_standardizer_feeds_the_input_layer(spark):
    x = np.random.default_rng(6).normal(size=(50, 4)) * [1, 2, 3, 0.1] + 5
    df = vectors(spark, x)
    weights = nw.standardizer_weights(mo.fit_standardizer(df, mean=0, maxdev=0.5))
    got = collected(nw.score(df, [{"type": "i", "mapsize": (2, 2), "mean": 0, "maxdev": 0.5}], weights))
    assert got == pytest.approx((x - x.mean(axis=0)) * 0.5 / np.maximum(x.std(axis=0), 0.5))


def test_jitter_and_soft_maps(spark):
    layers = [
        {"type": "i", "mapsize": (5, 5)},
        {"type": "j", "mapsize": (3, 3), "default": 1.0},
        {"type": "c", "outputmaps": 1, "kernelsize": (1, 1), "function": "soft"},
    ]
    weights = spark.createDataFrame(
        [(2, "k", 1, 1, 0, 0, 0.5), (2, "b", 1, 0, 0, 0, 0.0)],
        "layer int, part string, out int, inp int, dy int, dx int, w double",
    )
    x = np.arange(25.0)
    got = collected(nw.score(vectors(spark, [x]), layers, weights))[0]
    a = 0.5 * warp(x.reshape(5, 5), (3, 3), (0, 0), (1, 1), (False, False), 0, 1).ravel()
    e = np.exp(a - a.max())
    assert got == pytest.approx(e / e.sum())


def test_minibatch_sizes(spark):
    got = {r.batch: r["count"] for r in tr.minibatches(spark.range(103).withColumnRenamed("id", "vec_id"), 10, 3).groupBy("batch").count().collect()}
    assert got == {**{b: 10 for b in range(10)}, 10: 3}


def case(spark, seed=0, n=40, d=3, classes=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, size=n)
    x = rng.normal(size=(n, d)) + np.eye(classes, d)[y] * 2
    df = spark.createDataFrame(
        [(i, row.tolist(), int(c)) for i, (row, c) in enumerate(zip(x, y))], "vec_id bigint, vec array<double>, label int"
    )
    w = rng.normal(size=(classes, d)) * 0.1
    cells = [(o + 1, i + 1, float(v)) for (o, i), v in np.ndenumerate(w)] + [(o + 1, 0, 0.0) for o in range(classes)]
    return df, x, y, w, spark.createDataFrame(cells, "out int, inp int, w double")


def grads(x, y, w, b, function, coef, c):
    a = x @ w.T + b
    t = np.eye(len(w))[y]
    if function == "SVM":
        s = 2 * t - 1
        d = -2 * s * np.maximum(1 - a * s, 0) * coef
    else:
        if function == "soft":
            a = np.exp(a) / np.exp(a).sum(axis=1, keepdims=True)
        elif function == "sigm":
            a = 1 / (1 + np.exp(-a))
        elif function == "relu":
            a = np.maximum(a, 0)
        d = (a - t) * coef
        if function == "soft":
            d = a * (d - (a * d).sum(axis=1, keepdims=True))
        elif function == "sigm":
            d = d * a * (1 - a)
        elif function == "relu":
            d = d * (a > 0)
    gw = d.T @ x / len(x) + (w / c if function == "SVM" else 0)
    return gw, d.mean(axis=0)


@pytest.mark.parametrize("function", ["soft", "sigm", "linear", "relu", "SVM"])
def test_training_follows_the_update_rule(spark, function):
    df, x, y, w, cells = case(spark)
    p = tr.HeadParams(
        function=function, batch_size=None, epochs=4, alpha=0.2, momentum=0.4, adjust_rate=0.1, max_coef=1.15, balance=True, svm_c=10
    )
    head = tr.fit_head(df, cells, p)
    coef = 1 / (np.bincount(y) / len(y) * 3)
    b = np.zeros(3)
    state = [[np.zeros_like(w), np.ones_like(w)], [np.zeros(3), np.ones(3)]]
    for _ in range(4):
        w, b = w - 0.4 * state[0][0], b - 0.4 * state[1][0]
        values = [w, b]
        for n, g in enumerate(grads(x, y, w, b, function, coef, 10)):
            step = 0.2 * g
            agree = step * state[n][0] > 0
            state[n][1] = np.clip(np.where(agree, state[n][1] + 0.1, state[n][1] * 0.9), 1 / 1.15, 1.15)
            state[n][0] = step * state[n][1]
            values[n] = values[n] - 0.6 * state[n][0]
        w, b = values
    assert head.w == pytest.approx(w, abs=1e-7) and head.b == pytest.approx(b, abs=1e-7)
    assert len(head.losses) == 4 and head.losses[-1] < head.losses[0]


def test_minibatch_training(spark, checkpoint_dir):
    df, x, y, w, cells = case(spark, n=60)
    p = tr.HeadParams(batch_size=25, epochs=2, alpha=0.5, seed=3)
    head = tr.fit_head(df, cells, p)
    assert len(head.losses) == 6
    b = np.zeros(3)
    for epoch in range(2):
        at = {r.vec_id: r.batch for r in tr.minibatches(df, 25, 3 + epoch).collect()}
        for n in range(3):
            rows = [i for i in range(60) if at[i] == n]
            gw, gb = grads(x[rows], y[rows], w, b, "soft", 1.0, 1)
            w, b = w - 0.5 * gw, b - 0.5 * gb
    assert head.w == pytest.approx(w, abs=1e-7) and head.b == pytest.approx(b, abs=1e-7)
