from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseek.operators import pixels as px


def pixel_table(spark, *images):
    rows = []
    for n, image in enumerate(images):
        maps = np.asarray(image)
        maps = maps[None] if maps.ndim == 2 else maps
        for ch, m in enumerate(maps, start=1):
            for (y, x), v in np.ndenumerate(m):
                rows.append((n, m.shape[1], m.shape[0], ch, x + 1, y + 1, float(v)))
    return spark.createDataFrame(
        rows, "image_id int, width int, height int, ch int, x int, y int, v double"
    )


def as_array(df, image=0, ch=1):
    rows = df.where((F.col("image_id") == image) & (F.col("ch") == ch)).collect()
    out = np.full((rows[0].height, rows[0].width), np.nan)
    for r in rows:
        out[r.y - 1, r.x - 1] = r.v
    return out


def nested_rings(h, w, rings):
    """Ring column of every pixel by shrinking rectangles step by step."""
    out = np.zeros((h, w), dtype=int)
    x0, x1, y0, y1 = 0, w, 0, h
    sx, sy = (w - 1) // (2 * rings), (h - 1) // (2 * rings)
    for ring in range(rings):
        out[y0:y1, x0:x1] = rings - ring
        x0, x1, y0, y1 = x0 + sx, x1 - sx, y0 + sy, y1 - sy
    return out


@pytest.mark.parametrize("h,w,rings", [(4, 4, 2), (1, 5, 2), (8, 8, 3), (9, 14, 2), (5, 5, 4), (13, 7, 3)])
def test_rings_equal_nested_rectangles(spark, h, w, rings):
    df = pixel_table(spark, np.zeros((h, w)))
    got = as_array(df.withColumn("v", px.ring_column(rings)))
    assert (got == nested_rings(h, w, rings)).all()


def test_48_bins_lose_the_top_levels(spark):
    df = pixel_table(spark, [[0, 4, 5, 239, 240, 255]])
    got = {r.bin: r.n for r in px.annular_histogram(df, 48, 1).collect()}
    assert got == {1: 2, 2: 1, 48: 1}


def test_histogram_edges(spark):
    df = pixel_table(spark, [[-1, 0, 9, 10, 19, 20]])
    got = {r.bin: r.n for r in px.annular_histogram(df, [0, 10, 20], 1).collect()}
    assert got == {1: 2, 2: 2}


def test_shares_add_up_per_ring(spark):
    rng = np.random.default_rng(0)
    df = pixel_table(spark, *[rng.integers(0, 256, size=(3, 9, 11)) for _ in range(3)])
    sums = px.annular_histogram(df, 16, 2).groupBy("image_id", "col").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 6 and all(r.s == pytest.approx(1) for r in sums)


@pytest.mark.parametrize("h,w", [(4, 4), (5, 5), (8, 8), (7, 12)])
def test_sectors_cover_every_pixel_once(spark, h, w):
    got = as_array(pixel_table(spark, np.zeros((h, w))).withColumn("v", px.sector_number()))
    assert set(np.unique(got)) <= set(range(1, 9)) and len(np.unique(got)) == 8
    cy, cx = int(np.floor((h + 1) / 2 + 0.5)), int(np.floor((w + 1) / 2 + 0.5))
    assert got[cy - 1, w - 1] == 1 and got[0, w - 1] == 2 and got[0, cx - 1] == 3
    assert got[0, 0] == 4 and got[cy - 1, 0] == 5 and got[h - 1, cx - 1] == 7


def test_only_eight_sectors(spark):
    with pytest.raises(ValueError):
        px.segment_annular_histogram(pixel_table(spark, [[0]]), 16, 1, 6)


def test_sizes_are_found(spark):
    df = pixel_table(spark, np.zeros((2, 3))).drop("width", "height")
    assert px.with_sizes(df).select("width", "height").distinct().first() == (3, 2)


def kernel_table(spark, k):
    rows = [(o + 1, i + 1, dy, dx, float(v)) for (o, i, dy, dx), v in np.ndenumerate(k)]
    return spark.createDataFrame(rows, "out int, inp int, dy int, dx int, w double")


def correlate(maps, k, pad):
    m = np.pad(maps, ((0, 0), (pad[0], pad[0]), (pad[1], pad[1])))
    h, w = m.shape[1] - k.shape[2] + 1, m.shape[2] - k.shape[3] + 1
    out = np.zeros((k.shape[0], h, w))
    for y in range(h):
        for x in range(w):
            out[:, y, x] = (k * m[None, :, y : y + k.shape[2], x : x + k.shape[3]]).sum(axis=(1, 2, 3))
    return out


@pytest.mark.parametrize("pad", [(0, 0), (1, 2)])
def test_convolution(spark, pad):
    rng = np.random.default_rng(1)
    maps, k = rng.normal(size=(2, 5, 6)), rng.normal(size=(40, 2, 2, 3))
    bias = spark.createDataFrame([(n + 1, n / 4) for n in range(40)], "out int, b double")
    out = px.convolve(pixel_table(spark, maps), kernel_table(spark, k), (2, 3), bias, pad)
    want = correlate(maps, k, pad) + np.arange(40)[:, None, None] / 4
    for ch in (0, 31, 32, 39):
        assert as_array(out, ch=ch + 1) == pytest.approx(want[ch])


def pooled(m, scale, stride, fn):
    h, w = -(-m.shape[0] // stride[0]), -(-m.shape[1] // stride[1])
    return np.array(
        [[fn(m[y * stride[0] :, x * stride[1] :][: scale[0], : scale[1]]) for x in range(w)] for y in range(h)]
    )


@pytest.mark.parametrize("scale,stride", [((2, 2), None), ((2, 2), (1, 1)), ((3, 2), (2, 3)), ((1, 1), (2, 2))])
@pytest.mark.parametrize("how", ["max", "mean"])
def test_pooling_cuts_at_the_border(spark, scale, stride, how):
    m = np.random.default_rng(2).normal(size=(5, 5))
    out = as_array(px.pool(pixel_table(spark, m), scale, stride, how))
    assert out == pytest.approx(pooled(m, scale, stride or scale, np.max if how == "max" else np.mean))


def test_trim_reaches_the_last_centre(spark):
    m = np.zeros((5, 5))
    m[3, 3] = 9
    assert as_array(px.max_trim(pixel_table(spark, m), (3, 3))).tolist() == m[2:5, 2:5].tolist()
    assert as_array(px.max_trim(pixel_table(spark, np.ones((4, 4))), (2, 3))).shape == (2, 3)


def warp(m, size, shift, scale, mirror, angle, default):
    out = np.full(size, float(default))
    c, s = np.cos(angle), np.sin(angle)
    for i in range(size[0]):
        for j in range(size[1]):
            u, v = (i - size[0] / 2 + 0.5) * scale[0], (j - size[1] / 2 + 0.5) * scale[1]
            y = u * c - v * s + m.shape[0] / 2 - 0.5 + shift[0]
            x = u * s + v * c + m.shape[1] / 2 - 0.5 + shift[1]
            y, x = (m.shape[0] - 1 - y if mirror[0] else y), (m.shape[1] - 1 - x if mirror[1] else x)
            a, b = int(np.floor(y)), int(np.floor(x))
            if 0 <= a and a + 1 < m.shape[0] and 0 <= b and b + 1 < m.shape[1]:
                top = m[a, b] * (b + 1 - x) + m[a, b + 1] * (x - b)
                low = m[a + 1, b] * (b + 1 - x) + m[a + 1, b + 1] * (x - b)
                out[i, j] = top * (a + 1 - y) + low * (y - a)
    return out


@pytest.mark.parametrize(
    "args",
    [
        ((0, 0), (1, 1), (False, False), 0.0),
        ((0.3, -0.7), (1, 1), (True, False), 0.0),
        ((0, 0), (1.3, 0.8), (False, True), 0.12),
    ],
)
def test_fixed_transform(spark, args):
    m = np.random.default_rng(3).normal(size=(7, 6))
    shift, scale, mirror, angle = args
    out = px.augment(pixel_table(spark, m), (5, 4), shift, scale, mirror, angle, default=-3, fixed=True)
    assert as_array(out) == pytest.approx(warp(m, (5, 4), shift, scale, mirror, np.pi * angle, -3))


def test_random_transform_repeats_and_differs(spark):
    df = pixel_table(spark, *[np.arange(36).reshape(6, 6)] * 2)
    draw = lambda seed: px.augment(df, (4, 4), shift=(0.9, 0.9), seed=seed)
    a, b, c = draw(1), draw(1), draw(2)
    assert np.allclose(as_array(a), as_array(b))
    assert not np.allclose(as_array(a), as_array(c)) and not np.allclose(as_array(a), as_array(a, 1))


def test_pixels_and_vectors_are_inverse(spark):
    m = np.arange(24).reshape(2, 3, 4)
    back = px.to_vectors(pixel_table(spark, m)).first()
    assert back.vec == list(map(float, range(24)))
    again = px.to_vectors(px.to_pixels(px.to_vectors(pixel_table(spark, m)), 4, 3)).first()
    assert again.vec == back.vec


def test_maps_come_together_once(spark):
    """Trimming and resampling: one scan, one shuffle by image and map, no join on pixels."""
    from pixelseek import views

    pixels = views.pixels(spark, "/root/testdata/sf0.001")
    for out in (px.max_trim(pixels, (5, 4)), px.augment(pixels, (6, 6), shift=(1, 2), angle=0.1, seed=3)):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan") == 1 and "Join " not in text and text.count("Exchange hashpartitioning") == 1


def test_missing_pixels_count_nothing(spark):
    """Of a 3 x 3 map two pixels are missing and one has no value: neighbours at hand are summed, none gives no pixel."""
    have = {(1, 1): 1.0, (2, 1): 2.0, (3, 2): 4.0, (1, 3): 8.0, (2, 3): None, (3, 3): 16.0, (1, 2): 32.0}
    rows = [(1, 3, 3, 1, x, y, v) for (x, y), v in have.items()]
    pixels = spark.createDataFrame(rows, "image_id int, width int, height int, ch int, x int, y int, v double")
    got = px.augment(pixels, (2, 2), scale=(1, 1), fixed=True)
    # Output pixels lie in the middle of four neighbours each.
    at = lambda x, y: sum((have.get((x + i, y + j)) or 0) / 4 for i in (0, 1) for j in (0, 1))
    assert {(r.x, r.y): r.v for r in got.collect()} == {(x, y): at(x, y) for x in (1, 2) for y in (1, 2)}
    alone = pixels.where("x = 1 AND y = 1")
    assert [(r.x, r.y, r.v) for r in px.augment(alone, (2, 2), fixed=True).collect()] == [(1, 1, 0.25)]
