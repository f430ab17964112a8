from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseek.functions.codebooks import Centers
from pixelseek.operators import quantizer as pq
from pixelseek.operators import ranking as rk
from pixelseek.operators import relational as rel
from pixelseek.plans import quantized as jobs


def vectors(spark, matrix, kind="bigint"):
    make = int if kind == "bigint" else (lambda i: f"img{i:03d}")
    return spark.createDataFrame(
        [(make(i), [float(x) for x in row]) for i, row in enumerate(matrix)], f"vec_id {kind}, vec array<double>"
    )


def as_queries(df):
    return df.select(F.col("vec_id").alias("query_id"), "vec")


@pytest.fixture(scope="module")
def unequal(spark):
    """Two groups of lengths 2 and 3; cluster 1 of group 0 is missing; clusters 0 and 2 tie at 0."""
    rows = [(0, 0, [-1.0, 0.0]), (0, 2, [1.0, 0.0]), (1, 0, [0.0, 0.0, 0.0]), (1, 1, [5.0, 5.0, 5.0])]
    return spark.createDataFrame(rows, "gid int, cid int, c array<double>")


def test_tie_takes_lowest_cluster(spark, unequal):
    v = vectors(spark, [[0, 0, 4, 4, 4], [2, 0, 1, 1, 1]])
    got = {(r.vec_id, r.gid): (r.cid, r.dist) for r in pq.assign(v, unequal).collect()}
    assert got == {(0, 0): (0, 1.0), (0, 1): (1, 3.0), (1, 0): (2, 1.0), (1, 1): (0, 3.0)}
    assert {r.vec_id: r.code for r in pq.encode(v, unequal).collect()} == {0: [0, 1], 1: [2, 0]}


def test_wrong_length_is_left_out(spark, unequal):
    v = spark.createDataFrame([(0, [0.0] * 5), (1, [0.0] * 4), (2, None)], "vec_id bigint, vec array<double>")
    assert [r.vec_id for r in pq.encode(v, unequal).collect()] == [0]


def test_joined_assignment_equals_shipped(spark, unequal):
    rng = np.random.default_rng(0)
    v = vectors(spark, rng.normal(size=(50, 5)) * 3)
    subs = rel.subvectors(v, 2)
    a = {tuple(r) for r in pq.assign(v, unequal).select("vec_id", "gid", "cid").collect()}
    assert a == {tuple(r) for r in pq.assign_joined(subs, unequal).select("vec_id", "gid", "cid").collect()}


def lloyd(matrix, first, groups, clusters, passes):
    slices = pq._group_slices(matrix.shape[1], groups)
    costs, at = [], first.copy()
    for step in range(passes + 1):
        books = []
        for g, s in enumerate(slices):
            books.append({c: matrix[at[:, g] == c, s].mean(axis=0) for c in range(clusters) if (at[:, g] == c).any()})
        if step == passes:
            return books, costs
        cost = 0.0
        for g, s in enumerate(slices):
            ids = sorted(books[g])
            d = ((matrix[:, None, s] - np.array([books[g][c] for c in ids])[None]) ** 2).sum(axis=2)
            at[:, g] = np.array(ids)[d.argmin(axis=1)]
            cost += d.min(axis=1).sum()
        costs.append(cost)


def test_fit_equals_brute_force(spark):
    from pixelseek.functions.hashing import hash_bucket

    rng = np.random.default_rng(2)
    m = rng.normal(size=(120, 7))
    v = vectors(spark, m)
    cols = [hash_bucket(5, 3, g, F.col("vec_id")).alias(f"g{g}") for g in range(3)]
    first = np.array([tuple(r) for r in v.orderBy("vec_id").select(*cols).collect()])
    books, costs = lloyd(m, first, 3, 5, 4)
    centers, trace = jobs.fit_pq_trace(v, 3, 5, max_iter=5, tol=None, seed=3)
    assert trace == pytest.approx(costs)
    for r in centers.collect():
        assert r.c == pytest.approx(books[r.gid][r.cid].tolist())
    assert trace == sorted(trace, reverse=True)


def test_fit_stops_when_settled(spark):
    v = vectors(spark, np.repeat(np.eye(4), 5, axis=0))
    centers, trace = jobs.fit_pq_trace(v, 2, 2, max_iter=50)
    assert len(trace) < 50 and abs(trace[-1] - trace[-2]) < 1e-10


def test_more_clusters_than_points_vanish(spark):
    centers = jobs.fit_pq(vectors(spark, [[0.0, 0.0], [1.0, 1.0]]), 1, 50, max_iter=3)
    assert centers.count() <= 2


def brute(m, tables, codes, k, ids):
    out = {}
    for q in range(len(m)):
        d = sum(tables[q, g, codes[:, g]] for g in range(codes.shape[1]))
        order = sorted((d[i], ids[i]) for i in range(len(m)) if i != q)[:k]
        out[ids[q]] = [i for _, i in order]
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("max_bytes", [64 << 20, 1 << 12])
def test_search_equals_brute_force(spark, kind, max_bytes):
    """Both ways of the scan, with a third of the rows identical copies."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(90, 8))
    m[:30] = m[0]
    v = vectors(spark, m, kind)
    centers = jobs.fit_pq(v, 4, 6, max_iter=4)
    codes = pq.encode(v, centers)
    near = jobs.search_pq(as_queries(v), codes, centers, 7, max_bytes=max_bytes)
    got = {}
    for r in near.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    book = Centers.of(centers.collect())
    code = np.array([r.code for r in codes.orderBy("vec_id").collect()])
    ids = [r.vec_id for r in v.orderBy("vec_id").collect()]
    assert got == brute(m, pq.distance_tables(m, book), code, 7, ids)


def test_quantized_equals_exact_when_rows_are_centres(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(12, 4))
    v = vectors(spark, m)
    centers = spark.createDataFrame([(0, i, row.tolist()) for i, row in enumerate(m)], "gid int, cid int, c array<double>")
    near = jobs.search_pq(as_queries(v), pq.encode(v, centers), centers, 3)
    for r in near.collect():
        assert r.dist == pytest.approx(((m[r.query_id] - m[r.vec_id]) ** 2).sum())


def test_list_shorter_than_k(spark, unequal):
    v = vectors(spark, [[0, 0, 4, 4, 4], [2, 0, 1, 1, 1]])
    near = jobs.search_pq(as_queries(v), pq.encode(v, unequal), unequal, 10)
    assert {(r.query_id, r["rank"], r.vec_id) for r in near.collect()} == {(0, 1, 1), (1, 1, 0)}


def test_planted_clusters_are_found(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(10, 16)) * 5
    m = np.repeat(centres, 20, axis=0) + rng.normal(size=(200, 16)) * 0.05
    v = vectors(spark, m)
    labels = v.select("vec_id", F.floor(F.col("vec_id") / 20).cast("int").alias("label"))
    centers = jobs.fit_pq(v, 4, 32, max_iter=15, seed=1)
    found = jobs.evaluate_pq(as_queries(v), pq.encode(v, centers), centers, labels, 10)
    assert rk.hit_ratio(found).first()["ratio"] > 0.95
    curve = jobs.sweep_pq(as_queries(v), pq.encode(v, centers), centers, labels, 10).first()
    assert curve.k == 10 and curve.accuracy > 0.95


def test_result_page(spark, unequal):
    v = vectors(spark, [[0, 0, 4, 4, 4], [2, 0, 1, 1, 1], [0, 0, 5, 5, 5]])
    images = v.select("vec_id", F.format_string("/p/%s.tif", "vec_id").alias("path"))
    labels = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "vec_id bigint, label int")
    ids = spark.createDataFrame([(0,)], "vec_id bigint")
    page = jobs.query_demo(ids, v, pq.encode(v, unequal), unequal, images, labels, 1)
    assert [tuple(r) for r in page.select("position", "vec_id", "path", "class_name").orderBy("position").collect()] == [
        (0, 0, "/p/0.tif", "adeno"),
        (1, 2, "/p/2.tif", "adeno"),
    ]


def test_neighbour_lines(spark):
    rows = [(1, 1, 5, 2), (1, 2, 4, 1)]
    df = spark.createDataFrame(rows, "query_id int, rank int, vec_id int, hit_label int").withColumn("query_label", F.lit(1))
    assert [tuple(r) for r in rk.format_neighbours(df).collect()] == [("1(1)", "5(2) 4(1)")]
