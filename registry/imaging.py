"""Descriptors, pyramid features, annular histograms, map layers, scoring and head training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import registry.base  # noqa: F401
import registry.functions  # noqa: F401
from pixelseek import views
from pixelseek.operators import descriptors as ds
from pixelseek.operators import network as nw
from pixelseek.operators import pixels as px
from pixelseek.operators import ranking as rk
from pixelseek.operators import training as tr
from pixelseek.plans import features as jobs
from registry import cells, fragment, r6, register

# Descriptors and pyramid.

fragment(
    "signs",
    "SELECT image_id, desc_id, sum(CASE WHEN x >= 0 THEN 1 << (4 - i) ELSE 0 END)::INTEGER AS word_id"
    " FROM descriptors GROUP BY image_id, desc_id",
    "descriptors",
)
fragment(
    "desc_words",
    "SELECT s.word_id, d.i, avg(d.x) AS x FROM descriptors d JOIN signs s"
    " ON s.image_id = d.image_id AND s.desc_id = d.desc_id GROUP BY 1, 2",
    "signs",
)
fragment(
    "places",
    "SELECT image_id, desc_id, unnest([1, 1 + (row - 1) // 2 * 2 + (col - 1) // 2 + 1, 5 + (row - 1) * 4 + col]) AS bin"
    " FROM (SELECT DISTINCT image_id, desc_id, desc_id // 4 + 1 AS row, desc_id % 4 + 1 AS col FROM descriptors)",
    "descriptors",
)


def _coded(prefix: str, words: str) -> None:
    """Fragments of the two-word codes and the pooled features for a fragment of words."""
    fragment(
        f"{prefix}near_words",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, desc_id ORDER BY dist, word_id) AS rk FROM"
        " (SELECT d.image_id, d.desc_id, w.word_id, sum((w.x - d.x) * (w.x - d.x)) AS dist FROM descriptors d"
        f" JOIN {words} w ON w.i = d.i GROUP BY 1, 2, 3)) WHERE rk <= 2",
        words,
    )
    fragment(
        f"{prefix}two_words",
        "SELECT n.image_id, n.desc_id, n.word_id AS w1, m.word_id AS w2,"
        " sum((a.x - d.x) * (a.x - d.x)) AS c11, sum((b.x - d.x) * (b.x - d.x)) AS c22,"
        f" sum((a.x - d.x) * (b.x - d.x)) AS c12 FROM {prefix}near_words n"
        f" JOIN {prefix}near_words m ON m.image_id = n.image_id AND m.desc_id = n.desc_id AND m.rk = 2"
        " JOIN descriptors d ON d.image_id = n.image_id AND d.desc_id = n.desc_id"
        f" JOIN {words} a ON a.word_id = n.word_id AND a.i = d.i"
        f" JOIN {words} b ON b.word_id = m.word_id AND b.i = d.i WHERE n.rk = 1 GROUP BY 1, 2, 3, 4",
        f"{prefix}near_words",
    )
    fragment(
        f"{prefix}llc",
        "SELECT image_id, desc_id, unnest([w1, w2]) AS word_id, unnest([s, 1 - s]) AS w FROM (SELECT *,"
        f" (c22 + 1e-4 * (c11 + c22) - c12) / (c11 + c22 + 2e-4 * (c11 + c22) - 2 * c12) AS s FROM {prefix}two_words)",
        f"{prefix}two_words",
    )
    fragment(
        f"{prefix}pooled",
        "SELECT u.image_id, u.bin, u.word_id, CASE WHEN u.users = m.members THEN u.top ELSE greatest(u.top, 0) END AS v"
        f" FROM (SELECT p.image_id, p.bin, l.word_id, max(l.w) AS top, count(*) AS users FROM {prefix}llc l JOIN places p"
        " ON p.image_id = l.image_id AND p.desc_id = l.desc_id GROUP BY 1, 2, 3) u"
        " JOIN (SELECT image_id, bin, count(*) AS members FROM places GROUP BY 1, 2) m"
        " ON m.image_id = u.image_id AND m.bin = u.bin",
        f"{prefix}llc",
        "places",
    )


_coded("", "desc_words")

# A dictionary by Lloyd's iterations from a seeded first assignment: passes of assignment and means.
WORDS, LLOYD_SEED, LLOYD_PASSES = 16, 1, 4
fragment(
    "lloyd_a0",
    f"SELECT image_id, desc_id, (('0x' || left(md5('{LLOYD_SEED}:0:' || image_id || ':' || desc_id), 8))::BIGINT % {WORDS})"
    "::INTEGER AS word_id FROM (SELECT DISTINCT image_id, desc_id FROM descriptors)",
    "descriptors",
)
for n in range(LLOYD_PASSES):
    fragment(
        f"lloyd_c{n}",
        f"SELECT a.word_id, d.i, avg(d.x) AS x FROM descriptors d JOIN lloyd_a{n} a"
        " ON a.image_id = d.image_id AND a.desc_id = d.desc_id GROUP BY 1, 2",
        f"lloyd_a{n}",
    )
    fragment(
        f"lloyd_a{n + 1}",
        "SELECT image_id, desc_id, arg_min(word_id, struct_pack(d := dist, c := word_id)) AS word_id FROM"
        " (SELECT d.image_id, d.desc_id, c.word_id, sum((d.x - c.x) * (d.x - c.x)) AS dist FROM descriptors d"
        f" JOIN lloyd_c{n} c ON c.i = d.i GROUP BY 1, 2, 3) GROUP BY 1, 2",
        f"lloyd_c{n}",
    )
LLOYD = f"lloyd_c{LLOYD_PASSES - 1}"
_coded("lloyd_", LLOYD)


def _codes(spark: SparkSession, sf: str, knn: int) -> DataFrame:
    return ds.llc_code(views.descriptors(spark, sf), views.descriptor_words(spark, sf), knn)


@register("d2_llc_knn2", "SELECT image_id, desc_id, word_id, round(w, 6) + 0.0 AS w FROM llc", "llc")
def d2(spark, sf):
    return _codes(spark, sf, 2).select("image_id", "desc_id", "word_id", r6("w").alias("w"))


@register(
    "d2_llc_large_dictionary",
    "SELECT image_id, desc_id, word_id, round(w, 6) + 0.0 AS w FROM llc",
    "llc",
)
def d2_large(spark, sf):
    codes = ds.llc_code(views.descriptors(spark, sf), views.descriptor_words(spark, sf), 2, max_bytes=0)
    return codes.select("image_id", "desc_id", "word_id", r6("w").alias("w"))


@register(
    "d2_llc_weight_sums",
    "SELECT DISTINCT image_id, desc_id, 5 AS words, 1.0::DOUBLE AS total FROM descriptors",
    "descriptors",
)
def d2_sums(spark, sf):
    """Five weights per descriptor add up to one."""
    sums = _codes(spark, sf, 5).groupBy("image_id", "desc_id").agg(
        F.count(F.lit(1)).cast("int").alias("words"), r6(F.sum("w")).alias("total")
    )
    return sums


@register("d2_llc_knn5")
def d2_five(spark, sf):
    return _codes(spark, sf, 5).select("image_id", "desc_id", "word_id", r6("w").alias("w"))


@register(
    "d3_spm_pool",
    """SELECT image_id, bin, word_id, round(v / sqrt(sum(v * v) OVER (PARTITION BY image_id)), 6) AS v
       FROM pooled WHERE v <> 0""",
    "pooled",
)
def d3(spark, sf):
    pooled = ds.spm_pool(_codes(spark, sf, 2))
    return pooled.select("image_id", "bin", "word_id", r6("v").alias("v"))


def _lloyd_words(spark: SparkSession, sf: str) -> DataFrame:
    return ds.learn_dictionary(views.descriptors(spark, sf), "lloyd", WORDS, LLOYD_SEED, LLOYD_PASSES, tol=None)


@register("d1_dictionary", f"SELECT word_id, i, round(x, 6) + 0.0 AS x FROM {LLOYD}", LLOYD)
def d1(spark, sf):
    rows = cells(_lloyd_words(spark, sf), "word_id", array="wv")
    return rows.withColumn("x", F.col("x") + 0.0)


@register("d1_kmeans_dictionary")
def d1_kmeans(spark, sf):
    return cells(ds.learn_dictionary(views.descriptors(spark, sf), "kmeans", 16, seed=1), "word_id", array="wv")


@register(
    "d1_all_samples",
    "SELECT image_id, count(DISTINCT desc_id) AS words, round(sum(x), 6) + 0.0 AS total FROM descriptors GROUP BY image_id",
    "descriptors",
)
def d1_none(spark, sf):
    """Method "none": every descriptor is a word. The words of an image are counted and added up."""
    desc = views.descriptors(spark, sf)
    total = F.aggregate("wv", F.lit(0.0), lambda s, x: s + x)
    words = ds.learn_dictionary(desc, "none").withColumn("total", total)
    owner = desc.select("image_id", F.monotonically_increasing_id().alias("word_id"))
    return words.join(owner, "word_id").groupBy("image_id").agg(
        F.count_distinct("word_id").alias("words"), r6(F.sum("total")).alias("total")
    )


@register(
    "d4_llc_spm_features",
    """SELECT image_id, bin, word_id, round(v / sqrt(sum(v * v) OVER (PARTITION BY image_id)), 6) AS v
       FROM lloyd_pooled WHERE v <> 0""",
    "lloyd_pooled",
)
def d4(spark, sf):
    """Lloyd's dictionary, codes of two words, pooled."""
    out = jobs.llc_spm_features(views.descriptors(spark, sf), _lloyd_words(spark, sf), knn=2)
    return out.select("image_id", "bin", "word_id", r6("v").alias("v"))


@register("d4_kmeans_features")
def d4_kmeans(spark, sf):
    """Dictionary and codes by the defaults: k-means, five words."""
    out = jobs.llc_spm_features(views.descriptors(spark, sf), size=16, seed=1)
    return out.select("image_id", "bin", "word_id", r6("v").alias("v"))


def _grey_images(spark: SparkSession, sf: str) -> DataFrame:
    grey = F.transform("vec", lambda e: F.least(F.greatest(e + 0.5, F.lit(0.0)), F.lit(1.0)))
    return views.vectors(spark, sf).select(
        F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), grey.alias("px")
    )


# Gaussian derivative of width 0.8 on 5 x 5 cells, correlated with the zero-padded image; cosines to the
# ninth power for eight angles; bilinear shares of 4 x 4 cells over patches of 6 pixels with corners 0 and 2.
fragment(
    "gauss",
    "SELECT u, v, exp(-(u * u + v * v) / 1.28::DOUBLE) / sum(exp(-(u * u + v * v) / 1.28::DOUBLE)) OVER () AS g"
    " FROM range(-2, 3) a(u), range(-2, 3) b(v)",
)
fragment(
    "slopes",
    "SELECT u, v, gx * 2 / sum(abs(gx)) OVER () AS gx, gy * 2 / sum(abs(gy)) OVER () AS gy FROM (SELECT u, v,"
    " (coalesce(lead(g) OVER w, g) - coalesce(lag(g) OVER w, g)) / CASE WHEN abs(v) = 2 THEN 1 ELSE 2 END AS gx,"
    " (coalesce(lead(g) OVER z, g) - coalesce(lag(g) OVER z, g)) / CASE WHEN abs(u) = 2 THEN 1 ELSE 2 END AS gy"
    " FROM gauss WINDOW w AS (PARTITION BY u ORDER BY v), z AS (PARTITION BY v ORDER BY u))",
    "gauss",
)
fragment(
    "edges",
    "SELECT p.image_id, p.x, p.y, coalesce(sum(q.g * s.gx), 0) AS ix, coalesce(sum(q.g * s.gy), 0) AS iy FROM"
    " (SELECT vec_id AS image_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y FROM v) p CROSS JOIN slopes s LEFT JOIN"
    " (SELECT vec_id AS image_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, least(greatest(x + 0.5, 0), 1) AS g FROM v) q"
    " ON q.image_id = p.image_id AND q.x = p.x + s.v AND q.y = p.y + s.u GROUP BY 1, 2, 3",
    "slopes",
    "v",
)
fragment(
    "shares",
    "SELECT t, c, greatest(0, 1 - abs(t - ((c + 0.5::DOUBLE) * 1.5 - 0.5)) / 1.5) AS share FROM range(0, 6) a(t), range(0, 4) b(c)",
)
fragment(
    "raw_desc",
    "SELECT e.image_id, (px.p // 2 * 2 + py.p // 2)::INTEGER AS desc_id, (32 * sx.c + 8 * sy.c + a + 1)::INTEGER AS i,"
    " sum(sx.share * sy.share * sqrt(e.ix * e.ix + e.iy * e.iy)"
    " * greatest(pow(cos(atan2(e.iy, e.ix) - a * pi() / 4), 9), 0)) AS x FROM edges e, range(0, 3, 2) px(p),"
    " range(0, 3, 2) py(p), range(0, 8) t(a), shares sx, shares sy WHERE sx.t = e.x - px.p AND sy.t = e.y - py.p"
    " GROUP BY 1, 2, 3",
    "edges",
    "shares",
)


@register(
    "h3_dense_descriptors",
    """SELECT image_id, desc_id, i, round(CASE WHEN len >= 1 THEN least(x / len, 0.2)
       / sqrt(sum(least(x / len, 0.2) * least(x / len, 0.2)) OVER p) ELSE least(x, 0.2) END, 6) + 0.0 AS x
       FROM (SELECT *, sqrt(sum(x * x) OVER p) AS len FROM raw_desc WINDOW p AS (PARTITION BY image_id, desc_id))
       WINDOW p AS (PARTITION BY image_id, desc_id)""",
    "raw_desc",
)
def h3(spark, sf):
    """Patches of 6 pixels every 2 on the 8 x 8 images."""
    return cells(ds.dense_descriptors(_grey_images(spark, sf), step=2, patch=6), "image_id", "desc_id", array="d")


# Histograms on pixels.

fragment(
    "px",
    "SELECT vec_id AS image_id, 1 AS ch, ((i - 1) % 8 + 1)::INTEGER AS x, ((i - 1) // 8 + 1)::INTEGER AS y,"
    " floor(least(greatest(x * 256 + 128, 0), 255))::INTEGER AS v FROM v",
    "v",
)
_RING = "(3 - least(least(least(x - 1, 8 - x), least(y - 1, 8 - y)) + 1, 3) + 1)"
_SECTOR = """(CASE WHEN x = 5 AND y = 5 THEN 0 ELSE (floor(atan2((5 - y) / CASE WHEN y < 5 THEN 4.0::DOUBLE ELSE 3 END,
             (x - 5) / CASE WHEN x > 5 THEN 3.0::DOUBLE ELSE 4 END) / (pi() / 4))::INTEGER + 8) % 8 END)"""


def _hist_sql(column: str) -> str:
    return f"""SELECT image_id, col, ch, bin, n, round(n / sum(n) OVER (PARTITION BY image_id, col), 6) AS share FROM
               (SELECT image_id, {column}::INTEGER AS col, ch, (v // 16 + 1)::INTEGER AS bin, count(*) AS n
               FROM px GROUP BY 1, 2, 3, 4)"""


@register("h1_annular", _hist_sql(_RING), "px")
def h1(spark, sf):
    return px.annular_histogram(views.pixels(spark, sf), 16, 3).withColumn("share", r6("share"))


@register(
    "h1_annular_lost_levels",
    """SELECT image_id, col, bin, n FROM (SELECT image_id, (2 - least(least(least(x - 1, 8 - x), least(y - 1, 8 - y)) // 1
       + 1, 2) + 1)::INTEGER AS col, (v // 5 + 1)::INTEGER AS bin, count(*) AS n FROM px WHERE v < 240 GROUP BY 1, 2, 3)""",
    "px",
)
def h1_lost(spark, sf):
    """48 bins of 5 levels leave out the levels from 240 on."""
    return px.annular_histogram(views.pixels(spark, sf), 48, 2).select("image_id", "col", "bin", "n")


@register("h2_segment_annular", _hist_sql(f"{_SECTOR} * 3 + {_RING}"), "px")
def h2(spark, sf):
    return px.segment_annular_histogram(views.pixels(spark, sf), 16, 3).withColumn("share", r6("share"))


# Map layers.

SEED = 7
NET = [
    {"type": "i", "mapsize": (8, 8)},
    {"type": "c", "outputmaps": 2, "kernelsize": (3, 3), "function": "relu"},
    {"type": "s", "scale": (2, 2), "function": "max"},
    {"type": "f", "length": 10, "function": "soft"},
]
FLAT = [{"type": "i", "mapsize": (8, 8), "norm": 2.0}, {"type": "f", "length": 10, "function": "soft"}]
HASH = "(('0x' || left(md5({key}), 8))::BIGINT / 4294967296::DOUBLE)"

fragment(
    "taps",
    "SELECT o::INTEGER AS out, dy::INTEGER AS dy, dx::INTEGER AS dx, ("
    + HASH.format(key="'7:1:' || o || ':1:' || dy || ':' || dx")
    + " - 0.5) * 2 * sqrt(6.0::DOUBLE / 27) AS w FROM range(1, 3) a(o), range(0, 3) b(dy), range(0, 3) c(dx)",
)
fragment(
    "conv",
    "SELECT p.image_id, t.out AS ch, (p.x - t.dx)::INTEGER AS x, (p.y - t.dy)::INTEGER AS y, sum(p.v * t.w) AS v"
    " FROM px p, taps t WHERE p.x - t.dx BETWEEN 1 AND 6 AND p.y - t.dy BETWEEN 1 AND 6 GROUP BY 1, 2, 3, 4",
    "px",
    "taps",
)
fragment(
    "head_w",
    "SELECT o::INTEGER AS out, i::INTEGER AS i, ("
    + HASH.format(key="'7:1:' || o || ':' || i || ':0:0'")
    + " - 0.5) * 2 * sqrt(6.0::DOUBLE / 74) AS w FROM range(1, 11) a(o), range(1, 65) b(i)",
)
fragment(
    "head_in",
    "SELECT vec_id, label, i, x * (2 / sqrt(sum(x * x) OVER (PARTITION BY vec_id))) AS x FROM v",
    "v",
)
fragment(
    "head_out",
    "SELECT vec_id, label, out, exp(a) / sum(exp(a)) OVER (PARTITION BY vec_id) AS a FROM"
    " (SELECT h.vec_id, h.label, w.out, sum(h.x * w.w) AS a FROM head_in h JOIN head_w w ON w.i = h.i GROUP BY 1, 2, 3)",
    "head_in",
    "head_w",
)


def _taps(spark: SparkSession) -> DataFrame:
    return nw.init_weights(spark, NET, SEED).where("layer = 1 AND part = 'k'")


@register(
    "c1_convolve",
    "SELECT image_id, ch, x, y, round(v + ch / 2.0::DOUBLE, 6) + 0.0 AS v FROM conv",
    "conv",
)
def c1(spark, sf):
    bias = _taps(spark).select("out", (F.col("out") / 2).alias("b")).distinct()
    out = px.convolve(views.pixels(spark, sf), _taps(spark), (3, 3), bias)
    return out.select("image_id", "ch", "x", "y", r6("v").alias("v"))


@register(
    "c1_convolve_padded",
    """SELECT p.image_id, t.out AS ch, (p.x - t.dx + 1)::INTEGER AS x, (p.y - t.dy + 1)::INTEGER AS y,
       round(sum(p.v * t.w), 6) + 0.0 AS v FROM px p, taps t
       WHERE p.x - t.dx + 1 BETWEEN 1 AND 8 AND p.y - t.dy + 1 BETWEEN 1 AND 8 GROUP BY 1, 2, 3, 4""",
    "px",
    "taps",
)
def c1_padded(spark, sf):
    out = px.convolve(views.pixels(spark, sf), _taps(spark), (3, 3), padding=(1, 1))
    return out.select("image_id", "ch", "x", "y", r6("v").alias("v"))


def _pool_sql(fn: str) -> str:
    return f"""SELECT p.image_id, p.ch, a.k::INTEGER AS x, b.k::INTEGER AS y, {fn} AS v FROM px p, range(1, 5) a(k),
               range(1, 9) b(k) WHERE p.x BETWEEN 2 * a.k - 1 AND 2 * a.k + 1 AND p.y BETWEEN b.k AND b.k + 1
               GROUP BY 1, 2, 3, 4"""


@register("c2_maxpool", _pool_sql("max(p.v)"), "px")
def c2(spark, sf):
    """Windows of 2 rows and 3 columns, every row and every second column."""
    return px.pool(views.pixels(spark, sf), (2, 3), (1, 2), "max").select("image_id", "ch", "x", "y", "v")


@register("c3_meanpool", _pool_sql("round(avg(p.v), 6)"), "px")
def c3(spark, sf):
    out = px.pool(views.pixels(spark, sf), (2, 3), (1, 2), "mean")
    return out.select("image_id", "ch", "x", "y", r6("v").alias("v"))


@register(
    "c4_trim",
    """SELECT p.image_id, p.ch, (p.x - c.x + 2)::INTEGER AS x, (p.y - c.y + 3)::INTEGER AS y, p.v FROM px p JOIN
       (SELECT image_id, ch, x, y, row_number() OVER (PARTITION BY image_id, ch ORDER BY v DESC, y, x) AS rk FROM px
       WHERE y BETWEEN 3 AND 6 AND x BETWEEN 2 AND 6) c ON c.image_id = p.image_id AND c.ch = p.ch AND c.rk = 1
       WHERE p.x - c.x BETWEEN -1 AND 2 AND p.y - c.y BETWEEN -2 AND 2""",
    "px",
)
def c4(spark, sf):
    """5 rows and 4 columns around the brightest pixel."""
    return px.max_trim(views.pixels(spark, sf), (5, 4)).select("image_id", "ch", "x", "y", "v")


def _warp_sql(maps: str, h: int, w: int, default: float) -> str:
    return f"""SELECT g.image_id, g.ch, g.ox::INTEGER AS x, g.oy::INTEGER AS y, round(CASE WHEN NOT inside THEN {default}
      ELSE sum(p.v * (CASE WHEN p.y = fy + 1 THEN fy + 1 - py ELSE py - fy END)
                   * (CASE WHEN p.x = fx + 1 THEN fx + 1 - px ELSE px - fx END)) END, 6) + 0.0 AS v FROM
      (SELECT *, fy >= 0 AND fy + 1 <= 7 AND fx >= 0 AND fx + 1 <= 7 AS inside FROM
      (SELECT *, floor(py) AS fy, floor(px) AS fx FROM
      (SELECT image_id, ch, ox, oy, CASE WHEN my THEN 7 - ry ELSE ry END AS py, CASE WHEN mx THEN 7 - rx ELSE rx END AS px
      FROM (SELECT *, ty * cos(a) - tx * sin(a) + 3.5 + sy AS ry, ty * sin(a) + tx * cos(a) + 3.5 + sx AS rx FROM
      (SELECT m.*, ox, oy, (oy - 1 - ({h} / 2.0::DOUBLE - 0.5)) * zy AS ty, (ox - 1 - ({w} / 2.0::DOUBLE - 0.5)) * zx AS tx
      FROM ({maps}) m, range(1, {h + 1}) b(oy), range(1, {w + 1}) c(ox)))))) g
      LEFT JOIN px p ON p.image_id = g.image_id AND p.ch = g.ch AND p.x - 1 BETWEEN fx AND fx + 1
      AND p.y - 1 BETWEEN fy AND fy + 1 GROUP BY g.image_id, g.ch, g.ox, g.oy, g.inside"""


@register(
    "c5_augment_fixed",
    _warp_sql(
        "SELECT DISTINCT image_id, ch, 0.5::DOUBLE AS sy, -0.25::DOUBLE AS sx, 1.1::DOUBLE AS zy, 0.9::DOUBLE AS zx,"
        " false AS my, true AS mx, pi() * 0.05 AS a FROM px",
        6,
        7,
        9.0,
    ),
    "px",
)
def c5(spark, sf):
    out = px.augment(
        views.pixels(spark, sf),
        (6, 7),
        shift=(0.5, -0.25),
        scale=(1.1, 0.9),
        mirror=(False, True),
        angle=0.05,
        default=9.0,
        fixed=True,
    )
    return out.select("image_id", "ch", "x", "y", r6("v").alias("v"))


def _draw(name: str) -> str:
    return "(" + HASH.format(key=f"'3:' || image_id || ':' || ch || ':{name}'") + " * 2 - 1)"


@register(
    "c5_augment_random",
    _warp_sql(
        f"""SELECT image_id, ch, {_draw('shift_y')} AS sy, {_draw('shift_x')} * 2 AS sx,
            pow(1.2::DOUBLE, {_draw('scale_y')}) AS zy, 1.0::DOUBLE AS zx, false AS my, {_draw('mirror_x')} > 0 AS mx,
            {_draw('angle')} * (pi() * 0.1) AS a FROM (SELECT DISTINCT image_id, ch FROM px)""",
        6,
        6,
        0.0,
    ),
    "px",
)
def c5_random(spark, sf):
    out = px.augment(
        views.pixels(spark, sf), (6, 6), shift=(1, 2), scale=(1.2, 1), mirror=(False, True), angle=0.1, seed=3
    )
    return out.select("image_id", "ch", "x", "y", r6("v").alias("v"))


# Scoring and training.


def _head(spark: SparkSession) -> DataFrame:
    return nw.init_weights(spark, FLAT, SEED)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return nw.score(views.vectors(spark, sf), FLAT, _head(spark))


@register(
    "c8_init_weights",
    """SELECT out, inp, round((('0x' || left(md5('5:1:' || out || ':' || inp || ':0:0'), 8))::BIGINT
       / 4294967296::DOUBLE - 0.5) * 2 * sqrt(6.0::DOUBLE / (classes + dim)), 6) + 0.0 AS w FROM
       (SELECT unnest(range(1, classes + 1))::INTEGER AS out, * FROM (SELECT count(DISTINCT label) AS classes,
       max(len(embedding)) AS dim FROM embeddings)), LATERAL (SELECT unnest(range(1, dim + 1))::INTEGER AS inp)""",
)
def c8(spark, sf):
    """Weights of a classifier for the table: as many inputs as values, as many outputs as classes."""
    size = views.embeddings(spark, sf).agg(
        F.count_distinct("label").alias("classes"), F.max(F.size("embedding")).alias("dim")
    ).first()
    layers = [{"type": "i", "mapsize": (1, size["dim"])}, {"type": "f", "length": size["classes"]}]
    return nw.init_weights(spark, layers, 5).where("part = 'w'").select("out", "inp", r6("w").alias("w"))


@register(
    "c6_dense",
    """SELECT h.vec_id, w.out AS i, round(greatest(sum(h.x * w.w) * 0.75, 0), 6) + 0.0 AS x
       FROM v h JOIN head_w w ON w.i = h.i GROUP BY 1, 2""",
    "v",
    "head_w",
)
def c6(spark, sf):
    """One layer with dropout 0.25 at scoring time."""
    w = _head(spark)
    out = nw.dense(views.vectors(spark, sf), w.where("part = 'w'"), w.where("part = 'b'"), "relu", 0.25)
    return cells(out, "vec_id", array="vec")


@register(
    "c6_dense_large_weights",
    """SELECT h.vec_id, w.out AS i, round(greatest(sum(h.x * w.w), 0), 6) + 0.0 AS x
       FROM v h JOIN head_w w ON w.i = h.i GROUP BY 1, 2""",
    "v",
    "head_w",
)
def c6_large(spark, sf):
    w = _head(spark)
    out = nw.dense(views.vectors(spark, sf), w.where("part = 'w'"), w.where("part = 'b'"), "relu", max_bytes=0)
    return cells(out, "vec_id", array="vec")


@register("c7_score_dense", "SELECT vec_id, out AS i, round(a, 6) AS x FROM head_out", "head_out")
def c7_dense(spark, sf):
    return cells(_scores(spark, sf), "vec_id", array="vec")


fragment(
    "grid_v",
    "SELECT image_id, ch, (x + 1) // 2 AS x, (y + 1) // 2 AS y, max(greatest(v, 0)) AS v FROM conv GROUP BY 1, 2, 3, 4",
    "conv",
)


@register(
    "c7_score_network",
    f"""SELECT vec_id, out::INTEGER AS i, round(exp(a - m) / sum(exp(a - m)) OVER (PARTITION BY vec_id), 6) AS x FROM
        (SELECT *, max(a) OVER (PARTITION BY vec_id) AS m FROM (SELECT g.image_id AS vec_id, o AS out, sum(g.v *
        ({HASH.format(key="'7:3:' || o || ':' || ((g.ch - 1) * 9 + (g.y - 1) * 3 + g.x) || ':0:0'")} - 0.5)
        * 2 * sqrt(6.0::DOUBLE / 28)) AS a FROM grid_v g, range(1, 11) t(o) GROUP BY 1, 2))""",
    "grid_v",
)
def c7(spark, sf):
    """Convolution, max pooling and a soft classifier over the 8 x 8 pictures."""
    images = px.to_vectors(views.pixels(spark, sf))
    return cells(nw.score(images, NET, nw.init_weights(spark, NET, SEED)), "vec_id", array="vec")


@register(
    "c7_signature",
    """SELECT image_id AS vec_id, ((ch - 1) * 9 + (y - 1) * 3 + x)::INTEGER AS i, round(v, 6) + 0.0 AS x FROM grid_v""",
    "grid_v",
)
def c7_signature(spark, sf):
    """Activations before the classifier, as image signature."""
    images = px.to_vectors(views.pixels(spark, sf))
    out = nw.score(images, NET, nw.init_weights(spark, NET, SEED), last_hidden=True)
    return cells(out, "vec_id", array="vec")


_PRED = "SELECT vec_id, label, arg_min(out, struct_pack(a := -a, o := out)) - 1 AS pred FROM head_out GROUP BY 1, 2"


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    from pixelseek.functions.vector import argmax

    pred = _scores(spark, sf).select("vec_id", (argmax(F.col("vec")) - 1).alias("pred"))
    return pred.join(views.classes(spark, sf), "vec_id")


@register(
    "g11_error",
    f"""SELECT count(*) AS n, sum(CASE WHEN pred <> label THEN 1 ELSE 0 END)::BIGINT AS wrong,
        round(avg(CASE WHEN pred <> label THEN 1 ELSE 0 END), 6) AS error FROM ({_PRED})""",
    "head_out",
)
def g11(spark, sf):
    return rk.classification_error(_predicted(spark, sf)).select("n", "wrong", r6("error").alias("error"))


@register("g11_misclassified", f"SELECT vec_id, label, pred FROM ({_PRED}) WHERE pred <> label", "head_out")
def g11_rows(spark, sf):
    return rk.misclassified(_predicted(spark, sf)).select("vec_id", "label", "pred")


@register(
    "w3_minibatches",
    """SELECT vec_id, ((row_number() OVER (ORDER BY ('0x' || left(md5('11:' || vec_id), 8))::BIGINT, vec_id) - 1)
       // 50)::INTEGER AS batch FROM embeddings""",
)
def w3(spark, sf):
    return tr.minibatches(views.classes(spark, sf), 50, seed=11).select("vec_id", "batch")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return views.embeddings(spark, sf).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def _start(spark: SparkSession) -> DataFrame:
    return _head(spark).where("layer = 1").select("out", "inp", "w")


@register(
    "c9_head_step",
    """SELECT g.out, g.i AS inp, round(w.w - 0.5 * g.g, 6) + 0.0 AS w FROM
       (SELECT d.out, x.i, sum(d.d * x.x) / (SELECT count(*) FROM embeddings) AS g FROM
       (SELECT vec_id, out, a * (e - sum(a * e) OVER (PARTITION BY vec_id)) AS d FROM
       (SELECT s.vec_id, s.out, s.a, (s.a - CASE WHEN s.label + 1 = s.out THEN 1 ELSE 0 END) * c.weight AS e FROM
       (SELECT vec_id, label, out, exp(a) / sum(exp(a)) OVER (PARTITION BY vec_id) AS a FROM
       (SELECT h.vec_id, h.label, w.out, sum(h.x * w.w) AS a FROM v h JOIN head_w w ON w.i = h.i GROUP BY 1, 2, 3)) s
       JOIN (SELECT label, 1 / (count(*) / sum(count(*)) OVER () * count(*) OVER ()) AS weight FROM embeddings
       GROUP BY label) c ON c.label + 1 = s.out)) d JOIN (SELECT vec_id, i, x FROM v UNION ALL
       SELECT vec_id, 0, 1 FROM embeddings) x ON x.vec_id = d.vec_id GROUP BY 1, 2) g
       JOIN (SELECT out, i, w FROM head_w UNION ALL SELECT DISTINCT out, 0, 0.0::DOUBLE FROM head_w) w
       ON w.out = g.out AND w.i = g.i""",
    "v",
    "head_w",
)
def c9(spark, sf):
    """One gradient step of a soft classifier over the whole table, with class weights."""
    params = tr.HeadParams(function="soft", batch_size=None, alpha=0.5, balance=True)
    head = tr.fit_head(_labelled(spark, sf), _start(spark), params)
    return head.rows(spark).select("out", "inp", r6("w").alias("w"))


@register("c9_fit_head")
def c9_fit(spark, sf):
    """Five full passes with momentum and adaptive gains."""
    params = tr.HeadParams(
        function="SVM", batch_size=None, epochs=5, alpha=0.5, momentum=0.5, adjust_rate=0.05, max_coef=10, svm_c=100
    )
    head = tr.fit_head(_labelled(spark, sf), _start(spark), params)
    return head.rows(spark).select("out", "inp", r6("w").alias("w"))
