from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseek.functions import vector as vf
from pixelseek.operators import postings as po
from pixelseek.operators import ranking as rk
from pixelseek.operators import relational as rel
from pixelseek.operators import words as wd
from pixelseek.plans import retrieval as jobs


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def words(spark):
    return table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])], "word_id int, wv array<double>")


@pytest.fixture(scope="module")
def images(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.5, 0.5])]
    return table(spark, rows, "vec_id string, vec array<double>")


def test_equidistant_image_gets_no_posting(images, words):
    got = {(r.word_id, r.vec_id): r.weight for r in jobs.build_index(images, words).collect()}
    assert got == {(0, "a"): 0.0, (1, "b"): 0.0}


def test_threshold_is_strict(spark, words):
    near = table(spark, [("a", [1.0, 0.0])], "vec_id string, vec array<double>")
    weights = {r.word_id: r.weight for r in wd.soft_assign(near, words, threshold=1.0).collect()}
    assert weights == {0: 0.0}
    weights = {r.word_id: r.weight for r in wd.soft_assign(near, words, threshold=1.01).collect()}
    assert weights == {0: 0.0, 1: 1.0}


def test_words_of_other_length_are_skipped(spark, images):
    words = table(spark, [(0, [1.0, 0.0]), (1, [1.0]), (2, [])], "word_id int, wv array<double>")
    assert {r.word_id for r in wd.word_distances(images, words).collect()} == {0}
    assert {r.word_id for r in wd.word_distances(images, words, max_bytes=0).collect()} == {0}
    assert {r.word_id for r in wd.word_distances(images, words, vf.chi2).collect()} == {0}


def test_no_words_no_rows(spark, images):
    words = table(spark, [], "word_id int, wv array<double>")
    assert jobs.build_index(images, words).count() == 0


@pytest.mark.parametrize("metric", ["chi2", "l2sq"])
def test_large_dictionary_gives_the_same(spark, metric):
    rng = np.random.default_rng(1)
    vecs = table(spark, [(i, rng.random(6).tolist()) for i in range(60)], "vec_id bigint, vec array<double>")
    words = table(spark, [(i, rng.random(6).tolist()) for i in range(600)], "word_id int, wv array<double>")
    small = wd.soft_assign(vecs, words, 0.5, metric).toPandas()
    large = wd.soft_assign(vecs, words, 0.5, metric, max_bytes=0).toPandas()
    key = ["vec_id", "word_id"]
    small, large = (d.sort_values(key).reset_index(drop=True) for d in (small, large))
    assert small[key].equals(large[key])
    assert np.allclose(small["weight"], large["weight"])


def test_ragged_batch(spark):
    words = table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0]), (3, [3.0])], "word_id int, wv array<double>")
    rows = [(1, [1.0, 0.0]), (2, [3.0]), (3, [1.0, 1.0, 1.0]), (4, [0.2, 1.0])]
    vecs = table(spark, rows, "vec_id bigint, vec array<double>")
    got = {(r.vec_id, r.word_id) for r in wd.soft_assign(vecs.coalesce(1), words).collect()}
    assert got == {(1, 0), (2, 3), (4, 1)}


def test_repeated_image_keeps_least_weight(spark):
    rows = table(spark, [(0, "a", 0.5), (0, "a", 0.2), (1, "a", 0.1)], "word_id int, vec_id string, weight double")
    assert {tuple(r) for r in po.postings(rows).collect()} == {(0, "a", 0.2), (1, "a", 0.1)}


def test_hot_word_is_cut_into_blocks(spark):
    rows = spark.range(1000).select(
        F.lit(0).alias("word_id"), F.col("id").alias("vec_id"), F.lit(0.1).alias("weight")
    )
    lists = po.posting_lists(rows, 100).collect()
    assert len(lists) == 10 and max(len(r.docs) for r in lists) < 200
    assert sorted(d.vec_id for r in lists for d in r.docs) == list(range(1000))


def test_salted_probe_equals_broadcast_probe(spark):
    docs = spark.range(500).select((F.col("id") % 3).cast("int").alias("word_id"), F.col("id").alias("vec_id"))
    asked = table(spark, [(7, 0), (7, 1), (8, 0), (9, 5)], "query_id bigint, word_id int")
    near = {tuple(r) for r in po.probe(asked, docs).collect()}
    assert near == {tuple(r) for r in po.probe(spark.createDataFrame(asked.rdd, asked.schema), docs, max_bytes=16).collect()}
    assert po.candidates(po.probe(asked, docs)).count() == 334 + 167


def test_search_unknown_word_gives_nothing(spark, images, words):
    index = table(spark, [(5, "a")], "word_id int, vec_id string")
    asked = images.select(F.col("vec_id").alias("query_id"), "vec")
    assert jobs.search_index(asked, words, index).count() == 0


def ranked_case(spark):
    """Query 0 of class 1 with three hits, query 9 of class 2 with one; neither holds itself."""
    scored = table(
        spark,
        [(0, 1, 0.1), (0, 2, 0.3), (0, 3, 0.3), (9, 1, 0.5)],
        "query_id bigint, vec_id bigint, dist double",
    )
    labels = table(spark, [(0, 1), (1, 1), (2, 2), (3, 1), (9, 2)], "vec_id bigint, label int")
    return rel.attach_labels(rk.top_hits(scored), labels), labels


def test_short_lists_clamp_k(spark):
    ranked, labels = ranked_case(spark)
    cum = rk.cum_matches(ranked)
    assert {(r.query_id, r["rank"]): r.matches for r in cum.collect()} == {(0, 1): 1, (0, 2): 1, (0, 3): 2, (9, 1): 0}
    per = rk.pr_per_query(rk.at_k(cum, 100, "clamp"), rk.class_counts(labels))
    rows = {(r.query_id, r.k): r for r in per.collect()}
    assert len(rows) == 20
    assert rows[0, 10].precision == pytest.approx(2 / 3) and rows[0, 10].recall == pytest.approx(2 / 3)
    assert rows[0, 10].vote == 1 and rows[9, 100].vote == 1
    curve = rk.pr_curve(per).where("k = 10").first()
    assert curve.precision == pytest.approx(1 / 3) and curve.accuracy == 0.5


def test_vote_needs_a_strict_majority(spark):
    at = table(
        spark, [(0, 1, 10, 2, 1), (1, 2, 10, 2, 1)], "query_id bigint, query_label int, k int, shown int, matches int"
    )
    sizes = table(spark, [(1, 4), (2, 4)], "label int, n bigint")
    assert {r.query_id: r.vote for r in rk.pr_per_query(at, sizes).collect()} == {0: 2, 1: 1}


def test_recall_grows_with_k(spark):
    ranked, labels = ranked_case(spark)
    at = rk.at_k(rk.cum_matches(ranked), 100, "keep")
    curve = [r.recall for r in rk.pq_curve(at, rk.class_counts(labels)).orderBy("k").collect()]
    assert curve == sorted(curve)


def test_k_grid(spark):
    ks = [r.k for r in rk.k_grid(spark).collect()]
    assert len(ks) == 59 and ks[:11] == [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200] and ks[-1] == 5000


def test_same_result_with_one_partition(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.random(8).tolist()) for i in range(80)]
    vecs = table(spark, rows, "vec_id bigint, vec array<double>")
    words = table(spark, [(i, v) for i, (_, v) in enumerate(rows[:9])], "word_id int, wv array<double>")
    spread = {tuple(r) for r in jobs.build_index(vecs.repartition(8), words).collect()}
    assert spread == {tuple(r) for r in jobs.build_index(vecs.coalesce(1), words).collect()}


def test_class_sizes_total(spark):
    rows = table(spark, [("x",), ("x",), ("y",)], "class_name string")
    assert {(r.class_name, r.n) for r in rk.class_sizes(rows).collect()} == {("x", 2), ("y", 1), (None, 3)}


@pytest.mark.parametrize("without_self", [True, False])
@pytest.mark.parametrize("max_bytes", [64 << 20, 1 << 11, 0])
def test_scan_equals_search_and_rerank(spark, without_self, max_bytes):
    """One scan, the scan in blocks, and the way through the index; a third of the images are copies."""
    rng = np.random.default_rng(11)
    m = rng.random((60, 6)) ** 4
    m[:20] = m[0]
    vecs = table(spark, [(i, row.tolist()) for i, row in enumerate(m)], "vec_id bigint, vec array<double>")
    words = table(spark, [(i, row.tolist()) for i, row in enumerate(rng.random((5, 6)) ** 4)], "word_id int, wv array<double>")
    asked = vecs.select(F.col("vec_id").alias("query_id"), "vec")
    index = jobs.build_index(vecs, words, threshold=0.1)
    hits = jobs.search_index(asked, words, index, threshold=0.1)
    assert 0 < hits.count() < 3600
    hits = rk.exclude_self(hits) if without_self else hits
    cols = ["query_id", "rank", "vec_id"]
    want = {tuple(r) for r in rk.top_hits(rk.rerank(hits, asked, vecs), 9).select(*cols).collect()}
    got = jobs.search_and_rank(asked, words, vecs, 9, 0.1, without_self=without_self, max_bytes=max_bytes)
    assert {tuple(r) for r in got.select(*cols).collect()} == want


def test_ranks_merged_in_two_steps(spark):
    rng = np.random.default_rng(12)
    rows = [(int(q), i, float(d)) for i, (q, d) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 9, 400)))]
    scored = table(spark, rows, "query_id bigint, vec_id bigint, dist double")
    once, twice = ({tuple(r) for r in rel.top_ranked(scored, 30, ["dist", "vec_id"], m).collect()} for m in (1, 5))
    assert once == twice and len(once) == 90


def test_nearest_words_are_narrow(spark, images, words):
    near = wd.knn(images, words, 1)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    assert {(r.vec_id, r.word_id) for r in near.collect()} == {("a", 0), ("b", 1), ("c", 0)}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_one_distance_is_ranked_in_many_tasks(spark, kind):
    """A third of all rows belong to one query and have one distance."""
    hits = [(7, i, 0.5) for i in range(4000)] + [(7, 4000 + i, i / 4000) for i in range(4000)]
    hits += [(i % 5, 9000 + i, float(i % 3)) for i in range(4000)]
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"img{i:05d}")
    rows = [(q, name(i), d) for q, i, d in hits]
    scored = spark.createDataFrame(rows, f"query_id long, vec_id {kind}, dist double").repartition(6)
    got = rk.top_hits(scored)
    want, last = [], {}
    for q, i, d in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last[q] = last.get(q, 0) + 1
        want.append((q, i, d, last[q]))
    assert sorted(map(tuple, got.select("query_id", "vec_id", "dist", "rank").collect())) == sorted(want)
    ranges = rel.in_ranges(scored, ["dist", "vec_id"], 12)
    sizes = [r["count"] for r in ranges.groupBy(F.shiftright("_place", rel.PLACE_BITS)).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2.5 * len(rows) / 12
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("range_rows", [1, 3, 1000])
def test_running_matches_in_ranges(spark, range_rows):
    ranked = [(1, k, 1, 1 + (k % 3 > 0)) for k in range(1, 40)] + [(2, k, 2, 1 if k % 2 else None) for k in range(1, 6)]
    df = spark.createDataFrame(ranked, "query_id int, rank int, query_label int, hit_label int")
    got = rk.cum_matches(df, range_rows=range_rows)
    assert {(r.query_id, r.rank): r.matches for r in got.collect()} == {
        (q, k): sum(a == b for p, j, a, b in ranked if p == q and j <= k) for q, k, _, _ in ranked
    }
    assert got.dtypes == rk.cum_matches(df, max_k=50).dtypes
