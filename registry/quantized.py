"""Product quantization: sub-vectors, training, codes, search, evaluation.

Groups 8, clusters 16, three iterations. Every image is a query against all images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import registry.base  # noqa: F401
from pixelseek import views
from pixelseek.operators import quantizer as pq
from pixelseek.operators import ranking as rk
from pixelseek.operators import relational as rel
from pixelseek.plans import quantized as jobs
from registry import cells, fragment, r6, register

GROUPS, CLUSTERS, ITERATIONS = 8, 16, 3
TOP, SWEEP_K, DEMO_K = 10, 100, 4

fragment("sub", "SELECT vec_id, ((i - 1) // 8)::INTEGER AS gid, ((i - 1) % 8 + 1)::INTEGER AS j, x FROM v", "v")
fragment(
    "a0",
    "SELECT vec_id, gid, (('0x' || left(md5('0:' || gid || ':' || vec_id), 8))::BIGINT % 16)::INTEGER AS cid"
    " FROM (SELECT DISTINCT vec_id, gid FROM sub)",
    "sub",
)
for n in range(ITERATIONS):
    fragment(
        f"c{n}",
        f"SELECT s.gid, a.cid, s.j, avg(s.x) AS c FROM sub s JOIN a{n} a"
        " ON a.vec_id = s.vec_id AND a.gid = s.gid GROUP BY s.gid, a.cid, s.j",
        "sub",
        f"a{n}",
    )
    fragment(
        f"a{n + 1}",
        "SELECT vec_id, gid, arg_min(cid, struct_pack(d := dist, c := cid)) AS cid, min(dist) AS dist FROM"
        " (SELECT s.vec_id, s.gid, c.cid, sum((s.x - c.c) * (s.x - c.c)) AS dist FROM sub s"
        f" JOIN c{n} c ON c.gid = s.gid AND c.j = s.j GROUP BY s.vec_id, s.gid, c.cid) GROUP BY vec_id, gid",
        "sub",
        f"c{n}",
    )
CENTERS, CODES = f"c{ITERATIONS - 1}", f"a{ITERATIONS}"
fragment(
    "tables",
    f"SELECT s.vec_id AS query_id, s.gid, c.cid, sum((s.x - c.c) * (s.x - c.c)) AS d FROM sub s JOIN {CENTERS} c"
    " ON c.gid = s.gid AND c.j = s.j GROUP BY s.vec_id, s.gid, c.cid",
    "sub",
    CENTERS,
)
fragment(
    "near",
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM"
    " (SELECT t.query_id, a.vec_id, sum(t.d) AS dist FROM tables t"
    f" JOIN {CODES} a ON a.gid = t.gid AND a.cid = t.cid WHERE a.vec_id <> t.query_id GROUP BY 1, 2)",
    "tables",
    CODES,
)
fragment(
    "named",
    "SELECT n.*, q.label AS query_label, h.label AS hit_label FROM near n"
    " JOIN labels2 q ON q.vec_id = n.query_id JOIN labels2 h ON h.vec_id = n.vec_id",
    "near",
    "labels2",
)
fragment("class_mean", "SELECT label, i, avg(x) AS x FROM v GROUP BY label, i", "v")
fragment(
    "representatives",
    "SELECT arg_min(vec_id, struct_pack(d := dist, i := vec_id)) AS vec_id FROM (SELECT v.label, v.vec_id,"
    " sum((v.x - m.x) * (v.x - m.x)) AS dist FROM v JOIN class_mean m ON m.label = v.label AND m.i = v.i"
    " GROUP BY 1, 2) GROUP BY label",
    "v",
    "class_mean",
)


def _centers(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.fit_pq(views.vectors(spark, sf), GROUPS, CLUSTERS, ITERATIONS, tol=None, seed=0)


def _model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    centers = _centers(spark, sf)
    return centers, pq.encode(views.vectors(spark, sf), centers)


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return views.vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "vec")


@register("p7_subvectors", "SELECT vec_id, gid, j AS i, round(x, 6) AS x FROM sub", "sub")
def p7(spark, sf):
    return cells(rel.subvectors(views.vectors(spark, sf), GROUPS), "vec_id", "gid", array="sub")


@register(
    "p7_unequal_groups",
    """SELECT vec_id, least((i - 1) // 12, 4)::INTEGER AS gid, (i - 12 * least((i - 1) // 12, 4))::INTEGER AS i,
       round(x, 6) AS x FROM v""",
    "v",
)
def p7_unequal(spark, sf):
    """Five groups of 64 values: four of 12, the last of 16."""
    return cells(rel.subvectors(views.vectors(spark, sf), 5), "vec_id", "gid", array="sub")


@register("q1_fit_pq_3iter", f"SELECT gid, cid, j AS i, round(c, 6) AS x FROM {CENTERS}", CENTERS)
def q1(spark, sf):
    return cells(_centers(spark, sf), "gid", "cid", array="c")


@register("x5_assign", f"SELECT vec_id, gid, cid, round(dist, 6) AS dist FROM {CODES}", CODES)
def x5(spark, sf):
    a = pq.assign(views.vectors(spark, sf), _centers(spark, sf))
    return a.select("vec_id", "gid", "cid", r6("dist").alias("dist"))


@register("x5_assign_joined", f"SELECT vec_id, gid, cid, round(dist, 6) AS dist FROM {CODES}", CODES)
def x5_joined(spark, sf):
    a = pq.assign_joined(rel.subvectors(views.vectors(spark, sf), GROUPS), _centers(spark, sf))
    return a.select("vec_id", "gid", "cid", r6("dist").alias("dist"))


@register(
    "g4_centroids",
    f"""SELECT s.gid, a.cid, s.j AS i, round(avg(s.x), 6) AS x FROM sub s JOIN {CODES} a
        ON a.vec_id = s.vec_id AND a.gid = s.gid GROUP BY s.gid, a.cid, s.j""",
    "sub",
    CODES,
)
def g4(spark, sf):
    v = views.vectors(spark, sf)
    assigned = pq.assign(v, _centers(spark, sf)).join(rel.subvectors(v, GROUPS), ["vec_id", "gid"])
    return cells(pq.centroids(assigned), "gid", "cid", array="c")


@register("g5_distortion", f"SELECT round(sum(dist), 6) AS distortion FROM {CODES}", CODES)
def g5(spark, sf):
    return pq.distortion(pq.assign(views.vectors(spark, sf), _centers(spark, sf))).select(
        r6("distortion").alias("distortion")
    )


@register(
    "q2_encode",
    f"SELECT vec_id, string_agg(cid::VARCHAR, ' ' ORDER BY gid) AS code FROM {CODES} GROUP BY vec_id",
    CODES,
)
def q2(spark, sf):
    _, codes = _model(spark, sf)
    return codes.select("vec_id", F.array_join(F.col("code").cast("array<string>"), " ").alias("code"))


@register(
    "u2_union_codes",
    f"SELECT vec_id, string_agg(cid::VARCHAR, ' ' ORDER BY gid) AS code FROM {CODES} GROUP BY vec_id",
    CODES,
)
def u2(spark, sf):
    """Codes of the two classes, encoded apart and united."""
    centers = _centers(spark, sf)
    both = views.vectors(spark, sf).join(views.labels(spark, sf), "vec_id")
    first = pq.encode(both.where(F.col("label") == 1), centers)
    second = pq.encode(both.where(F.col("label") != 1), centers)
    codes = first.unionByName(second)
    return codes.select("vec_id", F.array_join(F.col("code").cast("array<string>"), " ").alias("code"))


@register(
    "x6_adc",
    f"""SELECT t.query_id, a.vec_id, round(sum(t.d), 6) AS dist FROM (SELECT m.label::BIGINT AS query_id,
        c.gid, c.cid, sum((m.x - c.c) * (m.x - c.c)) AS d FROM class_mean m JOIN {CENTERS} c
        ON c.gid = (m.i - 1) // 8 AND c.j = (m.i - 1) % 8 + 1 GROUP BY 1, 2, 3) t
        JOIN {CODES} a ON a.gid = t.gid AND a.cid = t.cid GROUP BY 1, 2""",
    CENTERS,
    CODES,
    "class_mean",
)
def x6(spark, sf):
    centers, codes = _model(spark, sf)
    return pq.adc(views.class_means(spark, sf), codes, centers).select(
        "query_id", "vec_id", r6("dist").alias("dist")
    )


_NEAR = "SELECT query_id, rank::INTEGER AS rank, vec_id, round(dist, 6) AS dist FROM near WHERE rank <= "


@register("q3_topk", _NEAR + str(TOP), "near")
def q3(spark, sf):
    centers, codes = _model(spark, sf)
    near = jobs.search_pq(_queries(spark, sf), codes, centers, TOP)
    return near.select("query_id", "rank", "vec_id", r6("dist").alias("dist"))


@register("q3_topk_blocks", _NEAR + str(TOP), "near")
def q3_blocks(spark, sf):
    """The same with queries cut into blocks."""
    centers, codes = _model(spark, sf)
    near = jobs.search_pq(_queries(spark, sf), codes, centers, TOP, max_bytes=1 << 13)
    return near.select("query_id", "rank", "vec_id", r6("dist").alias("dist"))


@register(
    "t1_nearest_class_images",
    f"""SELECT query_id, rank::INTEGER AS rank, vec_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER
        (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM (SELECT t.query_id, a.vec_id, sum(t.d) AS dist
        FROM (SELECT m.label::BIGINT AS query_id, c.gid, c.cid, sum((m.x - c.c) * (m.x - c.c)) AS d
        FROM class_mean m JOIN {CENTERS} c ON c.gid = (m.i - 1) // 8 AND c.j = (m.i - 1) % 8 + 1
        GROUP BY 1, 2, 3) t JOIN {CODES} a ON a.gid = t.gid AND a.cid = t.cid GROUP BY 1, 2)) WHERE rank <= {TOP}""",
    CENTERS,
    CODES,
    "class_mean",
)
def t1(spark, sf):
    centers, codes = _model(spark, sf)
    near = jobs.search_pq(views.class_means(spark, sf), codes, centers, TOP, without_self=False)
    return near.select("query_id", "rank", "vec_id", r6("dist").alias("dist"))


@register(
    "p5_exclude_self",
    "SELECT query_id, rank::INTEGER AS rank, vec_id FROM near WHERE rank <= 5",
    "near",
)
def p5(spark, sf):
    """Six nearest with the query itself among the images, then without it."""
    centers, codes = _model(spark, sf)
    near = jobs.search_pq(_queries(spark, sf), codes, centers, 6, without_self=False)
    others = rk.exclude_self(near).select("query_id", "vec_id", "dist")
    return rk.top_hits(others, 5).select("query_id", "rank", "vec_id")


@register(
    "q4_neighbour_lines",
    f"""SELECT query_id || '(' || query_label || ')' AS query,
        string_agg(vec_id || '(' || hit_label || ')', ' ' ORDER BY rank) AS neighbours
        FROM named WHERE rank <= {TOP} GROUP BY query_id, query_label""",
    "named",
)
def q4_lines(spark, sf):
    centers, codes = _model(spark, sf)
    labelled = jobs.evaluate_pq(_queries(spark, sf), codes, centers, views.labels(spark, sf), TOP)
    return rk.format_neighbours(labelled)


_RATIO = f"""SELECT count(*) AS neighbours, sum(CASE WHEN query_label = hit_label THEN 1 ELSE 0 END)::BIGINT AS rights,
             round(avg(CASE WHEN query_label = hit_label THEN 1 ELSE 0 END), 6) AS ratio
             FROM named WHERE rank <= {TOP}"""


@register("q4_hit_ratio", _RATIO, "named")
def q4(spark, sf):
    centers, codes = _model(spark, sf)
    labelled = jobs.evaluate_pq(_queries(spark, sf), codes, centers, views.labels(spark, sf), TOP)
    return rk.hit_ratio(labelled).select("neighbours", "rights", r6("ratio").alias("ratio"))


@register(
    "x9_matches_at_k",
    f"""SELECT query_id, query_label, k, sum(CASE WHEN query_label = hit_label THEN 1 ELSE 0 END)::INTEGER AS matches
        FROM named, k_grid WHERE rank <= k AND k <= {SWEEP_K} GROUP BY query_id, query_label, k""",
    "named",
    "k_grid",
)
def x9(spark, sf):
    centers, codes = _model(spark, sf)
    labelled = jobs.evaluate_pq(_queries(spark, sf), codes, centers, views.labels(spark, sf), SWEEP_K)
    at = rk.at_k(rk.cum_matches(labelled, SWEEP_K), SWEEP_K, "keep")
    return at.select("query_id", "query_label", "k", "matches")


_SWEEP = f"""SELECT k, round(avg(ratio), 6) AS precision, round(avg(recall), 6) AS recall,
             round(avg(CASE WHEN ratio > 0.5 THEN 1 ELSE 0 END), 6) AS accuracy FROM
             (SELECT t.query_id, t.k, t.m / t.k AS ratio, t.m / s.n AS recall FROM
             (SELECT query_id, query_label, k, sum(CASE WHEN query_label = hit_label THEN 1 ELSE 0 END) AS m
             FROM named, k_grid WHERE rank <= k AND k <= {SWEEP_K} GROUP BY query_id, query_label, k) t
             JOIN (SELECT label, count(*) AS n FROM labels2 GROUP BY label) s ON s.label = t.query_label)
             GROUP BY k"""


@register("q5_sweep", _SWEEP, "named", "k_grid")
def q5(spark, sf):
    centers, codes = _model(spark, sf)
    curve = jobs.sweep_pq(_queries(spark, sf), codes, centers, views.labels(spark, sf), SWEEP_K)
    return curve.select("k", *[r6(c).alias(c) for c in ("precision", "recall", "accuracy")])


@register("g10_pq_curve", _SWEEP, "named", "k_grid")
def g10(spark, sf):
    centers, codes = _model(spark, sf)
    labels = views.labels(spark, sf)
    labelled = jobs.evaluate_pq(_queries(spark, sf), codes, centers, labels, SWEEP_K)
    curve = rk.pq_curve(rk.at_k(rk.cum_matches(labelled, SWEEP_K), SWEEP_K, "keep"), rk.class_counts(labels))
    return curve.select("k", *[r6(c).alias(c) for c in ("precision", "recall", "accuracy")])


@register(
    "p6_select_queries",
    "SELECT v.vec_id, v.i, round(v.x, 6) AS x FROM v WHERE vec_id IN (SELECT vec_id FROM representatives)",
    "representatives",
)
def p6(spark, sf):
    chosen = rel.select_queries(views.vectors(spark, sf), views.representatives(spark, sf))
    return cells(chosen, "vec_id", array="vec")


_PAGE = """SELECT n.query_id, n.position::INTEGER AS position, n.vec_id, '/images/' || n.vec_id || '.png' AS path,
           CASE WHEN l.label = 1 THEN 'adeno' ELSE 'squma' END AS class_name FROM
           (SELECT vec_id AS query_id, 0 AS position, vec_id FROM representatives UNION ALL
           SELECT query_id, rank, vec_id FROM near WHERE rank <= 4
           AND query_id IN (SELECT vec_id FROM representatives)) n JOIN labels2 l ON l.vec_id = n.vec_id"""


@register("t3_query_demo", _PAGE, "representatives", "near", "labels2")
def t3(spark, sf):
    """Result pages for the most typical image of each class."""
    centers, codes = _model(spark, sf)
    page = jobs.query_demo(
        views.representatives(spark, sf),
        views.vectors(spark, sf),
        codes,
        centers,
        views.images(spark, sf),
        views.labels(spark, sf),
        DEMO_K,
    )
    return page.select("query_id", "position", "vec_id", "path", "class_name")


@register(
    "x10_gallery",
    """SELECT n.query_id, n.rank::INTEGER AS rank, n.vec_id, '/images/' || n.vec_id || '.png' AS path,
       CASE WHEN n.hit_label = 1 THEN 'adeno' ELSE 'squma' END AS class_name FROM named n WHERE rank <= 3""",
    "named",
)
def x10(spark, sf):
    centers, codes = _model(spark, sf)
    near = jobs.search_pq(_queries(spark, sf), codes, centers, 3)
    shown = rk.gallery(near, views.images(spark, sf), views.labels(spark, sf))
    return shown.select("query_id", "rank", "vec_id", "path", "class_name")


@register(
    "p8_label_name",
    "SELECT vec_id, CASE WHEN label = 1 THEN 'adeno' ELSE 'squma' END AS class_name FROM labels2",
    "labels2",
)
def p8(spark, sf):
    return views.labels(spark, sf).select("vec_id", rel.label_name(F.col("label")).alias("class_name"))
