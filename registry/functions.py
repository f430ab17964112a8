"""Vector functions, filters and coordinate statistics over the whole ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import registry.base  # noqa: F401
import registry.quantized  # noqa: F401
from pixelseek import views
from pixelseek.functions import vector as vf
from pixelseek.operators import block_matrix as bm
from pixelseek.operators import descriptors as ds
from pixelseek.operators import moments as mo
from pixelseek.operators import ranking as rk
from pixelseek.operators import relational as rel
from pixelseek.operators import words as wd
from pixelseek.operators.quantizer import encode
from pixelseek.plans.quantized import fit_pq
from pixelseek.plans.retrieval import build_index
from pixelseek.sources import text as tx
from registry import cells, fragment, r6, register

DIM = 64

fragment(
    "pairs",
    "SELECT h.vec_id, h.i, h.x AS a, w.x AS b FROM h JOIN words w ON w.word_id = h.label AND w.i = h.i",
    "h",
    "words",
)
fragment(
    "descriptors",
    "SELECT vec_id AS image_id, ((i - 1) // 4)::INTEGER AS desc_id, ((i - 1) % 4 + 1)::INTEGER AS i, x FROM v",
    "v",
)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each histogram beside the mean of its own class: (vec_id, a, b)."""
    rows = views.histograms(spark, sf).join(views.classes(spark, sf), "vec_id")
    means = views.prototypes(spark, sf).withColumnRenamed("vec", "b")
    return rel.join_side(rows, means, "label", array_col="b").select("vec_id", F.col("vec").alias("a"), "b")


def _per_pair(fn, name: str):
    def query(spark, sf):
        return _pairs(spark, sf).select("vec_id", r6(fn(F.col("a"), F.col("b"))).alias(name))

    return query


def _pair_sql(term: str, name: str) -> str:
    return f"SELECT vec_id, round({term}, 6) + 0.0 AS {name} FROM pairs GROUP BY vec_id"


register(
    "v1_chi2",
    _pair_sql("sum(CASE WHEN a + b <> 0 THEN (a - b) * (a - b) / (a + b) ELSE 0 END) / 2", "dist"),
    "pairs",
)(_per_pair(vf.chi2, "dist"))
register("v2_l2sq", _pair_sql("sum((a - b) * (a - b))", "dist"), "pairs")(_per_pair(vf.l2sq, "dist"))
register("v3_dot", _pair_sql("sum(a * b)", "dot"), "pairs")(_per_pair(vf.dot, "dot"))
register("v3_l2sq_by_norms", _pair_sql("sum(a * a) - 2 * sum(a * b) + sum(b * b)", "dist"), "pairs")(
    _per_pair(vf.l2sq_by_norms, "dist")
)
register("v3_sqnorm", "SELECT vec_id, round(sum(x * x), 6) AS n FROM h GROUP BY vec_id", "h")(
    lambda spark, sf: views.histograms(spark, sf).select("vec_id", r6(vf.sqnorm(F.col("vec"))).alias("n"))
)


@register(
    "v4_low_high",
    """SELECT vec_id, round(coalesce(min(x) FILTER (x > 0.3), 0), 6) AS low,
       round(coalesce(max(x) FILTER (x > 0.3), 0), 6) AS high FROM v GROUP BY vec_id""",
    "v",
)
def v4(spark, sf):
    """Least and greatest of the entries above 0.3; zero where there are none."""
    some = F.filter("vec", lambda x: x > 0.3)
    return views.vectors(spark, sf).select(
        "vec_id", r6(vf.array_low(some)).alias("low"), r6(vf.array_high(some)).alias("high")
    )


@register(
    "v5_minmax",
    """SELECT vec_id, i, round((x - min(x) OVER p) / nullif(max(x) OVER p - min(x) OVER p, 0), 6) AS x
       FROM v WINDOW p AS (PARTITION BY vec_id)""",
    "v",
)
def v5(spark, sf):
    vec = F.col("vec")
    scaled = vf.let(
        F.struct(vf.array_low(vec).alias("lo"), vf.array_high(vec).alias("hi")),
        lambda e: F.transform(vec, lambda x: vf.minmax(x, e["lo"], e["hi"])),
    )
    return cells(views.vectors(spark, sf).select("vec_id", scaled.alias("out")), "vec_id")


@register(
    "v6_l2_normalize",
    "SELECT vec_id, i, round(x * (2 / sqrt(sum(x * x) OVER (PARTITION BY vec_id))), 6) + 0.0 AS x FROM h",
    "h",
)
def v6(spark, sf):
    return cells(views.histograms(spark, sf).select("vec_id", vf.l2_normalize(F.col("vec"), 2.0).alias("out")), "vec_id")


@register(
    "v7_sift_normalize",
    """SELECT image_id, desc_id, i, round(CASE WHEN len >= 0.5
       THEN least(x / len, 0.2) / sqrt(sum(least(x / len, 0.2) * least(x / len, 0.2)) OVER p)
       ELSE least(x / 0.5, 0.2) END, 6) + 0.0 AS x
       FROM (SELECT *, sqrt(sum(x * x) OVER p) AS len FROM descriptors WINDOW p AS (PARTITION BY image_id, desc_id))
       WINDOW p AS (PARTITION BY image_id, desc_id)""",
    "descriptors",
)
def v7(spark, sf):
    rows = views.descriptors(spark, sf).select(
        "image_id", "desc_id", vf.sift_normalize(F.col("d"), 0.5).alias("out")
    )
    return cells(rows, "image_id", "desc_id")


@register(
    "v8_logsumexp",
    "SELECT vec_id, round(ln(sum(exp(x))), 6) AS z FROM v GROUP BY vec_id",
    "v",
)
def v8z(spark, sf):
    return views.vectors(spark, sf).select("vec_id", r6(vf.logsumexp(F.col("vec"))).alias("z"))


def _per_cell(fn):
    def query(spark, sf):
        return cells(views.vectors(spark, sf).select("vec_id", fn(F.col("vec")).alias("out")), "vec_id")

    return query


register(
    "v8_softmax",
    "SELECT vec_id, i, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS x FROM v",
    "v",
)(_per_cell(vf.softmax))
register("v9_sigmoid", "SELECT vec_id, i, round(1 / (1 + exp(-x)), 6) AS x FROM v", "v")(_per_cell(vf.sigmoid))
register("v10_relu", "SELECT vec_id, i, round(greatest(x, 0), 6) AS x FROM v", "v")(_per_cell(vf.relu))
register(
    "v11_snap", "SELECT vec_id, i, round(CASE WHEN abs(x) < 0.05 THEN 0 ELSE x END, 6) + 0.0 AS x FROM v", "v"
)(_per_cell(lambda a: vf.snap(a, 0.05)))


@register(
    "v12_argmax",
    """SELECT vec_id, arg_min(i, struct_pack(x := -x, i := i)) AS at FROM v GROUP BY vec_id""",
    "v",
)
def v12(spark, sf):
    return views.vectors(spark, sf).select("vec_id", vf.argmax(F.col("vec")).alias("at"))


_FIT = """SELECT i, 0.5 - avg(x) AS shift, 0.1 / greatest(stddev_pop(x), 0.1) AS scale FROM v GROUP BY i"""


@register("g12_standardizer", f"SELECT i, round(shift, 6) AS shift, round(scale, 6) AS scale FROM ({_FIT})", "v")
def g12(spark, sf):
    fitted = mo.fit_standardizer(views.vectors(spark, sf), mean=0.5, maxdev=0.1)
    return fitted.select("i", r6("shift").alias("shift"), r6("scale").alias("scale"))


@register(
    "v13_affine",
    f"SELECT vec_id, v.i, round((x + f.shift) * f.scale, 6) + 0.0 AS x FROM v JOIN ({_FIT}) f ON f.i = v.i",
    "v",
)
def v13(spark, sf):
    """Every vector standardized; the 64 parameters are one array row."""
    vec = views.vectors(spark, sf)
    fitted = mo.fit_standardizer(vec, mean=0.5, maxdev=0.1)
    packed = fitted.agg(F.array_sort(F.collect_list(F.struct("i", "shift", "scale"))).alias("f"))
    rows = vec.withColumn("f", packed.scalar())
    out = vf.affine(
        F.col("vec"), F.transform("f", lambda c: c["shift"]), F.transform("f", lambda c: c["scale"])
    )
    return cells(rows.select("vec_id", out.alias("out")), "vec_id")


@register(
    "p1_with_dim",
    "SELECT vec_id, round(sum(x), 6) AS total FROM v WHERE x > 0 GROUP BY vec_id HAVING count(*) = 32",
    "v",
)
def p1(spark, sf):
    """Lists of positive entries, kept where there are exactly 32."""
    some = views.vectors(spark, sf).select("vec_id", F.filter("vec", lambda x: x > 0).alias("vec"))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return rel.with_dim(some, 32).select("vec_id", r6(total).alias("total"))


@register("s1_parse_vectors", "SELECT vec_id, i, round(x, 6) + 0.0 AS x FROM v", "v")
def s1(spark, sf):
    """The table written as text lines and parsed back."""
    lines = tx.vector_lines(views.vectors(spark, sf))
    parsed = tx.parse_vectors(lines, DIM).select(F.col("vec_id").cast("bigint").alias("vec_id"), "vec")
    return cells(parsed, "vec_id", array="vec")


@register("s3_parse_labels", "SELECT vec_id, label FROM labels2", "labels2")
def s3(spark, sf):
    lines = views.labels(spark, sf).select(F.concat_ws(" ", "vec_id", "label").alias("value"))
    return tx.parse_labels(lines).select(F.col("vec_id").cast("bigint").alias("vec_id"), "label")


@register("s2_parse_words", "SELECT word_id, i, round(x, 6) AS x FROM words", "words")
def s2(spark, sf):
    """A file of empty words, then the dictionary: the later words stand."""
    words = views.words(spark, sf)
    empty = words.select(F.col("word_id").cast("string").alias("value"))
    lines = tx.numbered(empty).unionByName(tx.numbered(tx.word_lines(words), 1))
    return cells(tx.parse_words(lines), "word_id", array="wv")


@register("s4_parse_index", "SELECT word_id, vec_id FROM postings", "postings")
def s4(spark, sf):
    """The index as text lines, lists cut at 100 images, read back."""
    index = build_index(views.histograms(spark, sf), views.words(spark, sf), unique_ids=True)
    back = tx.parse_index(tx.index_lines(index, 100))
    return back.select("word_id", F.col("vec_id").cast("bigint").alias("vec_id"))


@register(
    "s5_parse_centers",
    """SELECT a.gid, a.cid, a.j AS i, round(coalesce(b.c, a.c), 6) + 0.0 AS x FROM c0 a
       LEFT JOIN c2 b ON b.gid = a.gid AND b.cid = a.cid AND b.j = a.j""",
    "c0",
    "c2",
)
def s5(spark, sf):
    """Centres of the first and of the third iteration in two files: the later ones stand."""
    v = views.vectors(spark, sf)
    first, last = (fit_pq(v, 8, 16, n, tol=None) for n in (1, 3))
    lines = tx.numbered(tx.center_lines(first)).unionByName(tx.numbered(tx.center_lines(last), 1))
    return cells(tx.parse_centers(lines), "gid", "cid", array="c")


@register("s6_parse_codes", "SELECT vec_id, gid + 1 AS i, cid AS c FROM a3", "a3")
def s6(spark, sf):
    v = views.vectors(spark, sf)
    lines = tx.code_lines(encode(v, fit_pq(v, 8, 16, 3, tol=None)))
    rows = tx.parse_codes(lines).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.posexplode("code").alias("p", "c"))
    return rows.select("vec_id", (F.col("p") + 1).cast("int").alias("i"), "c")


@register(
    "s11_index_lines",
    """SELECT p.word_id || chr(9) || string_agg(p.vec_id::VARCHAR, ' ' ORDER BY p.vec_id) AS value
       FROM postings p JOIN (SELECT word_id, ceil(count(*) / 100.0)::INTEGER AS blocks FROM postings
       GROUP BY word_id) b ON b.word_id = p.word_id
       GROUP BY p.word_id, ('0x' || left(md5(p.vec_id::VARCHAR), 8))::BIGINT % b.blocks""",
    "postings",
)
def s11(spark, sf):
    index = build_index(views.histograms(spark, sf), views.words(spark, sf), unique_ids=True)
    return tx.index_lines(index, 100)


@register(
    "g13_class_weights",
    "SELECT label, round(1 / (count(*) / sum(count(*)) OVER () * count(*) OVER ()), 6) AS weight"
    " FROM embeddings GROUP BY label",
)
def g13(spark, sf):
    return mo.class_weights(views.classes(spark, sf)).select("label", r6("weight").alias("weight"))


@register(
    "g14_gramian",
    "SELECT a.i, b.i AS j, round(sum(a.x * b.x), 6) + 0.0 AS x FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY 1, 2",
    "v",
)
def g14(spark, sf):
    return mo.gramian(views.vectors(spark, sf), DIM).select("i", "j", r6("x").alias("x"))


@register(
    "g15_length_histogram",
    """SELECT least(floor((len - lo) / (hi - lo) * 100) + 1, 100)::INTEGER AS bin, count(*) AS n FROM
       (SELECT len, min(len) OVER () AS lo, max(len) OVER () AS hi FROM
       (SELECT sqrt(sum(x * x)) AS len FROM descriptors GROUP BY image_id, desc_id)) GROUP BY 1""",
    "descriptors",
)
def g15(spark, sf):
    return ds.length_histogram(views.descriptors(spark, sf))


@register("g16_class_sizes", "SELECT label, count(*) AS n FROM embeddings GROUP BY ROLLUP (label)")
def g16(spark, sf):
    return rk.class_sizes(views.classes(spark, sf), "label")


_KNN = """SELECT vec_id, rank::INTEGER AS rank, word_id, round(dist, 6) AS dist FROM
          (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, word_id) AS rank FROM
          (SELECT h.vec_id, w.word_id, sum((h.x - w.x) * (h.x - w.x)) AS dist FROM h JOIN words w ON w.i = h.i
          GROUP BY 1, 2)) WHERE rank <= 3"""


@register("x8_knn_words", _KNN, "h", "words")
def x8(spark, sf):
    near = wd.knn(views.histograms(spark, sf), views.words(spark, sf), 3)
    return near.select("vec_id", "rank", "word_id", r6("dist").alias("dist"))


@register("t2_knn_large_dictionary", _KNN, "h", "words")
def t2(spark, sf):
    """The same through the join that serves dictionaries too large to ship."""
    near = wd.knn(views.histograms(spark, sf), views.words(spark, sf), 3, max_bytes=0)
    return near.select("vec_id", "rank", "word_id", r6("dist").alias("dist"))


@register(
    "d5_whiten_scatter",
    """SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN n - 1 ELSE 0 END::DOUBLE AS x FROM
       (SELECT DISTINCT i FROM v) a, (SELECT DISTINCT i FROM v) b, (SELECT count(*) AS n FROM embeddings)""",
    "v",
)
def d5_scatter(spark, sf):
    """Whitened vectors have the scatter matrix (n - 1) I."""
    white = mo.whiten(views.vectors(spark, sf), DIM)
    return mo.gramian(white, DIM).select("i", "j", F.round("x", 1).alias("x"))


@register(
    "d5_whiten_blocks",
    """SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN n - 1 ELSE 0 END::DOUBLE AS x FROM
       (SELECT DISTINCT i FROM v) a, (SELECT DISTINCT i FROM v) b, (SELECT count(*) AS n FROM embeddings)""",
    "v",
)
def d5_blocks(spark, sf):
    """The same by products of blocks, without the matrix in the driver."""
    white = bm.whiten_blocks(views.vectors(spark, sf), DIM, mo.WHITEN_EPS, DIM // 2)
    return mo.gramian(white, DIM).select("i", "j", F.round("x", 1).alias("x"))


@register(
    "d5_whiten_symmetric",
    "SELECT a.i, b.i AS j, 0.0::DOUBLE AS x FROM (SELECT DISTINCT i FROM v) a, (SELECT DISTINCT i FROM v) b",
    "v",
)
def d5_symmetric(spark, sf):
    """Of all whitenings X W only the one with a symmetric W that commutes with the scatter matrix has X'(X W) symmetric."""
    vectors = views.vectors(spark, sf)
    white = mo.whiten(vectors, DIM).withColumnRenamed("vec", "white")
    both = vectors.join(white, "vec_id").select(F.concat("vec", "white").alias("vec"))
    cross = mo.gramian(both, 2 * DIM).where(F.col("i").between(1, DIM) & (F.col("j") > DIM))
    cross = cross.select("i", (F.col("j") - DIM).alias("j"), "x")
    mirror = cross.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("y"))
    return cross.join(mirror, ["i", "j"]).select("i", "j", (F.round(F.col("x") - F.col("y"), 6) + 0.0).alias("x"))


@register("d5_whiten")
def d5(spark, sf):
    return cells(mo.whiten(views.vectors(spark, sf), DIM), "vec_id", array="vec")
