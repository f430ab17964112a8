"""Search that skips buckets, and queries in blocks beside a base that is read once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseek.functions.blocks import write_blocks
from pixelseek.operators import quantizer as pq
from pixelseek.operators import words as wd
from pixelseek.operators.abandon import Abandoning
from pixelseek.operators.multi_index import MultiIndex
from pixelseek.functions import kernels
from pixelseek.plans import quantized as jobs
from pixelseek.plans import retrieval
from tests.test_quantizer import as_queries, vectors


def nearest(tables, codes, k):
    full = pq.table_distances(tables, codes)
    out = []
    for row in full:
        order = np.lexsort((np.arange(len(row)), row))[:k]
        out.append([(int(i), row[i]) for i in order if np.isfinite(row[i])])
    return out


def found(index, tables, k, limit=None):
    q, at, dist = index.search(tables, np.full(len(tables), np.inf) if limit is None else limit, k)
    out = []
    for n in range(len(tables)):
        rows = sorted(zip(dist[q == n], at[q == n].tolist()))[:k]
        out.append([(i, d) for d, i in rows])
    return out


@pytest.mark.parametrize("groups", [1, 2, 3, 8])
@pytest.mark.parametrize("k", [1, 7, 5000])
def test_search_equals_full_scan(groups, k):
    """With ties: a third are copies, table entries are small whole numbers, one cluster does not exist."""
    rng = np.random.default_rng(groups)
    codes = rng.integers(0, 6, size=(3000, groups)).astype(np.int32)
    codes[codes == 4] = 3
    codes[::3] = codes[0]
    tables = rng.integers(0, 9, size=(20, groups, 6)).astype(float)
    tables[:, :, 4] = np.inf
    assert found(MultiIndex(codes), tables, k) == nearest(tables, codes, k)


def test_far_buckets_are_skipped():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 16, size=(50_000, 8)).astype(np.int32)
    tables = rng.random((30, 8, 16)) ** 2
    index = MultiIndex(codes)
    assert found(index, tables, 10) == nearest(tables, codes, 10)
    assert index.met == 30 * 256 and index.read < index.met / 3 and index.begun < 30 * 50_000 / 3
    # A limit from earlier rows skips more, and loses none within it.
    read = index.read
    limit = np.array([rows[-1][1] for rows in nearest(tables, codes, 10)])
    assert found(index, tables, 10, limit) == nearest(tables, codes, 10)
    assert index.read - read <= read


def test_rounding_at_the_limit_loses_nothing():
    """All codes equally far, by sums that round differently in another order."""
    tables = np.full((1, 8, 4), 0.1)
    codes = np.random.default_rng(0).integers(0, 4, size=(500, 8)).astype(np.int32)
    assert found(MultiIndex(codes), tables, 5) == nearest(tables, codes, 5)


@pytest.mark.parametrize("max_bytes", [64 << 20, 1 << 12])
def test_indexed_scan_equals_plain_scan(spark, max_bytes):
    rng = np.random.default_rng(4)
    v = vectors(spark, rng.normal(size=(300, 8)))
    centers = jobs.fit_pq(v, 4, 6, max_iter=3)
    codes = pq.encode(v, centers)
    plain, indexed = (
        jobs.search_pq(as_queries(v), codes, centers, 9, max_bytes=max_bytes, index_rows=n).collect() for n in (1 << 30, 1)
    )
    assert len(plain) == 300 * 9 and sorted(plain) == sorted(indexed)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_blocks_of_queries_share_one_scan(spark, monkeypatch):
    """However many blocks, the base is encoded once and no query row reaches the driver."""
    rng = np.random.default_rng(5)
    v = vectors(spark, rng.normal(size=(200, 8)))
    centers = jobs.fit_pq(v, 4, 6, max_iter=2)
    codes = pq.encode(v, centers)
    whole = jobs.search_pq(as_queries(v), codes, centers, 5)
    shipped = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: shipped.append(a))
    blocks = jobs.search_pq(as_queries(v), codes, centers, 5, max_bytes=1 << 10)
    assert not shipped and scans(blocks) == scans(whole) == 2
    assert sorted(blocks.collect()) == sorted(whole.collect())


def test_written_blocks_hold_every_row(spark):
    rows = spark.createDataFrame(
        [(i, [float(i)] * 4) for i in range(500)] + [(None, [1.0]), (7, None), (8, []), (9, [2.0])], "id long, vec array<double>"
    ).repartition(3)
    blocks = write_blocks(rows, "id", "vec", block_bytes=2000)
    assert len(blocks.files) > 5
    got = [(r["id"], tuple(r["vec"])) for t in blocks for r in t.to_pylist()]
    want = [(r["id"], tuple(r["vec"])) for r in rows.where(F.col("vec").isNotNull()).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert write_blocks(rows.limit(0), "id", "vec", block_bytes=2000).files == []


@pytest.mark.parametrize("name", ["q4_hit_ratio", "q5_sweep"])
def test_evaluation_holds_one_search(spark, name):
    import __spark_entry__ as entry

    assert scans(entry.queries()[name](spark, "/root/testdata/sf0.001")) == 2


WORD_FNS = {
    "distances": lambda v, w, b: wd.word_distances(v, w, max_bytes=b),
    "soft": lambda v, w, b: wd.soft_assign(v, w, max_bytes=b),
    "knn": lambda v, w, b: wd.knn(v, w, 3, "l2sq", max_bytes=b),
}


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("fn", WORD_FNS)
def test_words_in_blocks(spark, fn, kind):
    """Vectors and words of two lengths, ties, equal words, a third of the vectors copies."""
    rng = np.random.default_rng(8)
    m = rng.integers(1, 4, size=(90, 4)).astype(float)
    m[:30] = m[0]
    v = vectors(spark, m, kind).unionByName(vectors(spark, m[:5, :2] + 1, kind)).repartition(3)
    book = [(i, [float(x) for x in row]) for i, row in enumerate(rng.integers(1, 4, size=(40, 4)))]
    book += [(100 + i, [float(i), 1.0]) for i in range(3)] + [(200, []), (201, None)]
    words = spark.createDataFrame(book, "word_id int, wv array<double>")
    whole, blocks = (WORD_FNS[fn](v, words, b) for b in (64 << 20, 500))
    assert whole.schema.simpleString() == blocks.schema.simpleString()
    told = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert told(whole) == told(blocks) and told(whole)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Generate ", "Window ", "Exchange hashpartitioning(vec_id", "SortMergeJoin"))


def test_equal_words_give_no_word(spark):
    words = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "word_id int, wv array<double>")
    assert wd.soft_assign(vectors(spark, [[3.0, 3.0]]), words, max_bytes=1).count() == 0


def test_centres_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = vectors(spark, np.repeat(rng.normal(size=(40, 7)), 2, axis=0))
    centers = jobs.fit_pq(v, 3, 9, max_iter=3)
    whole, blocks = (pq.assign(v, centers, max_bytes=b) for b in (64 << 20, 200))
    assert sorted(blocks.collect()) == sorted(whole.select(blocks.columns).collect())
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert not any(f"{node} " in plan for node in ("Exchange", "SortMergeJoin", "BroadcastHashJoin"))


@pytest.mark.parametrize("metric", ["chi2", "l2sq"])
@pytest.mark.parametrize("k", [1, 6, 4000])
def test_abandoned_candidates_are_not_near(metric, k):
    """Same rows and distances as all distances, a third of the rows copies, some not candidates."""
    rng = np.random.default_rng(k)
    rows = rng.random((3000, 40)) + rng.random((3000, 1)) * 3
    rows[::3] = rows[1]
    queries = rows[:12] + 0.01
    marks = rng.random((12, 3000)) < 0.8
    index = Abandoning(rows, metric, lambda rest: rest)
    full = np.where(marks, kernels.BLOCKS[metric](rows, queries).T, np.inf)
    q, at, dist = index.search((queries, marks), np.full(12, np.inf), k)
    for n in range(12):
        order = np.lexsort((np.arange(3000), full[n]))[:k]
        got = sorted(zip(dist[q == n], at[q == n].tolist()))[:k]
        assert got == [(full[n, i], i) for i in order if np.isfinite(full[n, i])]
    assert (index.read < 0.8 * index.held) if k < 10 else (index.read <= 2 * index.held)


def test_few_coordinates_are_read():
    rng = np.random.default_rng(0)
    rows = rng.random((3000, 160)) + rng.random((3000, 1)) * 3
    index = Abandoning(rows, "chi2", lambda rest: rest)
    index.search((rows[:20] + 0.01, np.ones((20, 3000), dtype=bool)), np.full(20, np.inf), 5)
    assert index.read < 0.4 * index.held


@pytest.mark.parametrize("max_bytes", [64 << 20, 2000])
def test_abandoning_report_equals_plain_report(spark, max_bytes):
    rng = np.random.default_rng(2)
    v = vectors(spark, rng.random((300, 20)) + 1)
    words = spark.createDataFrame([(i, (rng.random(20) + 1).tolist()) for i in range(4)], "word_id int, wv array<double>")
    plain, cut = (
        retrieval.search_and_rank(as_queries(v), words, v, 7, max_bytes=max_bytes, index_rows=n).collect() for n in (1 << 30, 1)
    )
    assert sorted(plain) == sorted(cut) and len(cut) > 1000
