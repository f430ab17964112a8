"""The same answer whatever the size of dictionary, weights or ranking."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pixelseek.functions.codebooks import MAX_BYTES
from pixelseek.operators import descriptors as de
from pixelseek.operators import network as nw
from pixelseek.operators import pixels as px
from pixelseek.operators import quantizer as qz
from pixelseek.operators import ranking as rk
from pixelseek.operators import relational as rel
from pixelseek.operators import training as tr
from pixelseek.operators import words as wd
from pixelseek.plans import quantized as pq
from pixelseek.plans import retrieval as jobs

VEC = "vec_id bigint, vec array<double>"
WORDS = "word_id int, wv array<double>"

MIXED = [(1, [1.0, 2.0]), (2, [3.0]), (3, [0.5, 0.25, 4.0]), (4, None), (5, [2.0, 0.0]), (6, []), (7, [0.0, 5.0])]
SIZES = [0, MAX_BYTES]


def rows(df, *cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def same(make, *cols):
    small, large = (rows(make(b), *cols) for b in SIZES)
    assert small == large and small
    return small


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame(MIXED, VEC).repartition(2).cache()


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(0, [1.0, 1.0]), (1, [4.0, 0.5]), (2, [0.0, 3.0])], WORDS)


@pytest.fixture(scope="module")
def two_lengths(spark):
    return spark.createDataFrame([(0, [1.0, 1.0]), (1, [4.0, 0.5]), (2, [0.0]), (3, [2.0])], WORDS)


def test_llc_code(spark, vecs, words, two_lengths):
    d = vecs.select(F.lit(1).alias("image_id"), F.col("vec_id").alias("desc_id"), F.col("vec").alias("d"))
    got = same(lambda b: de.llc_code(d, words, 2, max_bytes=b), "desc_id", "slot", "word_id", "w")
    assert {r[0] for r in got} == {1, 5, 7}
    for b in SIZES:
        with pytest.raises(ValueError):
            de.llc_code(d, two_lengths, 2, max_bytes=b)


@pytest.mark.parametrize("fn", ["soft_assign", "knn"])
def test_words(vecs, words, two_lengths, fn):
    for book in (words, two_lengths):
        if fn == "knn":
            same(lambda b: wd.knn(vecs, book, 2, max_bytes=b), "vec_id", "rank", "word_id", "dist")
        else:
            same(lambda b: wd.soft_assign(vecs, book, max_bytes=b), "vec_id", "word_id", "weight")


def test_dense(spark, vecs):
    weights = spark.createDataFrame([(1, 1, 0.5), (1, 2, -1.0), (3, 2, 2.0)], "out int, inp int, w double")
    biases = spark.createDataFrame([(2, 0.25)], "out int, w double")
    got = same(lambda b: nw.dense(vecs, weights, biases, "linear", max_bytes=b), "vec_id", "vec")
    assert got[0] == (1, [-1.5, 0.25, 4.0]) and [r[0] for r in got] == [1, 5, 7]


def test_assign_and_encode(spark, vecs):
    centers = spark.createDataFrame(
        [(0, 0, [0.0]), (0, 3, [2.0]), (1, 1, [0.0]), (1, 2, [4.0])], "gid int, cid int, c array<double>"
    )
    same(lambda b: qz.assign(vecs, centers, b), "vec_id", "gid", "cid", "dist")
    assert same(lambda b: qz.encode(vecs, centers, b), "vec_id", "code") == [(1, [0, 1]), (5, [3, 1]), (7, [0, 2])]


def test_fit_pq_needs_one_length(spark, vecs):
    with pytest.raises(ValueError):
        pq.fit_pq(vecs, 1, 1)
    assert pq.fit_pq(vecs, 1, 1, max_iter=2, dim=2).count() == 1


def test_query_prefix_is_no_query(spark, vecs):
    centers = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [2.0, 2.0])], "gid int, cid int, c array<double>")
    codes = qz.encode(vecs, centers)
    asked = vecs.select(F.col("vec_id").alias("query_id"), "vec")
    assert {r.query_id for r in pq.search_pq(asked, codes, centers, 2).collect()} == {1, 5, 7}
    assert {r.query_id for r in qz.adc(asked, codes, centers).collect()} == {1, 5, 7}


@pytest.mark.parametrize("max_k", [None, 2])
def test_search_and_rank(spark, vecs, words, two_lengths, max_k):
    asked = vecs.select(F.col("vec_id").alias("query_id"), "vec")
    for book in (words, two_lengths):
        same(
            lambda b: jobs.search_and_rank(asked, book, vecs, max_k, max_bytes=b), "query_id", "rank", "vec_id", "dist"
        )


def test_all_hits_are_ranked(spark):
    hits = spark.range(6000).select(
        F.when(F.col("id") < 5500, 0).otherwise(F.col("id") % 7).alias("query_id"),
        F.col("id").alias("vec_id"),
        ((F.col("id") * 7919) % 1000).cast("double").alias("dist"),
    )
    got = rk.top_hits(hits).collect()
    by_query: dict = {}
    for r in hits.collect():
        by_query.setdefault(r.query_id, []).append((r.dist, r.vec_id))
    want = {(q, v): n for q, ds in by_query.items() for n, (_, v) in enumerate(sorted(ds), start=1)}
    assert {(r.query_id, r.vec_id): r["rank"] for r in got} == want
    assert max(r["rank"] for r in got) > 5000


def test_hot_keys_are_salted(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("vec_id"))
    side = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = rows(big.join(side, "k"), "k", "vec_id", "v")
    assert rows(rel.salted_join(big, side, "k", "vec_id", hot_rows=50), "k", "vec_id", "v") == want
    assert rows(rel.hot_join(big, side, "k", "vec_id"), "k", "vec_id", "v") == want
    assert rows(rel.hot_join(big, side, "k", "vec_id", max_bytes=0), "k", "vec_id", "v") == want


def test_padding_is_checked(spark):
    pixels = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 2.0)], "image_id int, width int, height int, ch int, x int, y int, v double")
    kernel = spark.createDataFrame([(1, 1, 0, 0, 1.0)], "out int, inp int, dy int, dx int, w double")
    with pytest.raises(ValueError):
        px.convolve(pixels, kernel, (1, 1), padding=(1, 1))


def test_rate_and_momentum_per_epoch():
    assert [tr.at_epoch([1.0, 0.5], e) for e in range(3)] == [1.0, 0.5, 0.5] and tr.at_epoch(0.1, 4) == 0.1
