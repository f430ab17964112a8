"""Many queries against all codes: tables of bytes, limits from a sample, queries dealt to tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelseek.operators import code_tables
from pixelseek.operators import quantizer as pq
from pixelseek.operators.code_tables import CodeTables
from pixelseek.plans import quantized as jobs
from tests.oracle import compare, connect, plan
from tests.test_quantizer import as_queries, vectors
from tests.test_search import scans

SMALL = "/root/testdata/sf0.001"


def nearest(tables, codes, ids, k):
    full = pq.table_distances(tables, codes)
    order = [np.lexsort((ids, row))[:k] for row in full]
    return [[(row[i], ids[i]) for i in at if np.isfinite(row[i])] for row, at in zip(full, order)]


def found(index, tables, ids, k, limit=None):
    q, at, dist = index.search(tables, np.full(len(tables), np.inf) if limit is None else limit, k)
    return [sorted(zip(dist[q == n], ids[at[q == n]]))[:k] for n in range(len(tables))]


@pytest.mark.parametrize("groups", [1, 3, 8])
@pytest.mark.parametrize("k", [1, 7, 400, 5000])
@pytest.mark.parametrize("held", [1 << 21, 500])
@pytest.mark.parametrize("kind", ["whole", "tiny", "huge"])
def test_search_equals_full_scan(monkeypatch, groups, k, held, kind):
    """With ties: a third are copies, whole entries, one cluster does not exist; limits from few rows, some too low."""
    monkeypatch.setattr(code_tables, "HELD", held)
    monkeypatch.setattr(code_tables, "SAMPLE", 64)
    rng = np.random.default_rng(groups)
    codes = rng.integers(0, 6, size=(6000, groups)).astype(np.int32)
    codes[codes == 4] = 3
    codes[::3] = codes[0]
    ids = rng.permutation(6000) * 3
    tables = rng.integers(0, 9, size=(140, groups, 6)) * 1.0 if kind == "whole" else rng.random((140, groups, 6)) ** 3
    tables *= {"whole": 1, "tiny": 1e-60, "huge": 1e60}[kind]
    tables[:, :, 4] = np.inf
    tables[3], tables[4, 0], tables[5, 0, 1], tables[6] = np.nan, np.inf, np.nan, 0
    want = nearest(tables, codes, ids, k)
    assert found(CodeTables(codes, ids, 6), tables, ids, k) == want
    assert want[3] == want[4] == [] and (len(want[5]), len(want[6])) > (0, 0)
    # A limit from earlier rows loses none within it.
    limit = np.array([w[-1][0] if w else np.inf for w in want])
    assert found(CodeTables(codes, ids, 6), tables, ids, k, limit) == want


def test_few_rows_are_added_up_exactly():
    """Before, the distance of every row was; queries are asked again where the sample's limit is too low."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 16, size=(50_000, 8)).astype(np.int32)
    tables = rng.random((30, 8, 16)) ** 2
    index = CodeTables(codes, np.arange(50_000), 16)
    assert found(index, tables, np.arange(50_000), 101) == nearest(tables, codes, np.arange(50_000), 101)
    assert index.met < 30 * 50_000 / 50
    index.sample = index.sample[np.argsort(-pq.table_distances(tables[:1], index.columns.T[index.sample])[0])]
    index._first_rank = lambda k: 1
    assert found(index, tables, np.arange(50_000), 101) == nearest(tables, codes, np.arange(50_000), 101)
    assert index.again > 0


def test_wrong_codes_raise():
    with pytest.raises(IndexError):
        CodeTables(np.array([[0, 6]]), np.array([1]), 6)


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("max_bytes", [64 << 20, 1 << 12])
@pytest.mark.parametrize("without_self", [True, False])
def test_dealt_queries_equal_shipped_ones(spark, monkeypatch, kind, max_bytes, without_self):
    """Ids that come twice on both sides, unknown query ids, vectors of another length, a third of the rows copies."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(300, 8))
    m[::3] = m[0]
    v = vectors(spark, m, kind)
    centers = jobs.fit_pq(v, 4, 6, max_iter=3)
    twice = v.unionByName(v.where("substr(vec_id, -1) = '7'"))
    codes = pq.encode(twice, centers).coalesce(1)
    odd = F.when(F.expr("substr(vec_id, -2) <> '11'"), F.col("vec_id")).alias("query_id")
    asked = twice.select(odd, "vec").unionByName(v.limit(3).select(F.col("vec_id").alias("query_id"), F.slice("vec", 1, 5).alias("vec")))
    monkeypatch.setattr(jobs, "SHIPPED_PART", 1 << 40)
    many = jobs.search_pq(asked, codes, centers, 9, without_self=without_self, max_bytes=max_bytes)
    monkeypatch.undo()
    few = jobs.search_pq(asked, codes, centers, 9, without_self=without_self)
    assert "RoundRobin" not in plan(few) and "RoundRobin" in plan(many)
    assert many.schema.simpleString() == few.schema.simpleString()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    told = [sorted(map(tuple, df.select("query_id", "rank", "vec_id", "dist").collect()), key=key) for df in (many, few)]
    assert told[0] == told[1] and len(told[0]) > 2000


def test_one_file_is_searched_by_many_tasks(spark, monkeypatch):
    """Before, a task of its own searched each file, and each gave k rows per query to a window."""
    monkeypatch.setattr(jobs, "SHIPPED_PART", 1 << 40)
    v = vectors(spark, np.random.default_rng(3).normal(size=(2000, 8)), "bigint").coalesce(1)
    centers = jobs.fit_pq(v, 4, 6, max_iter=2)
    near = jobs.search_pq(as_queries(v), pq.encode(v, centers), centers, 5)
    assert near.groupBy("query_id").count().where("count <> 5").count() == 0
    text = plan(near)
    assert "RoundRobinPartitioning(16)" in text and "Window" not in text


@pytest.mark.parametrize("name", ["g10_pq_curve", "x9_matches_at_k", "q5_sweep"])
def test_curves_of_dealt_queries_equal_sql(spark, monkeypatch, name):
    monkeypatch.setattr(jobs, "SHIPPED_PART", 1 << 40)
    df = entry.queries()[name](spark, SMALL)
    assert scans(df) == 2 and "RoundRobin" in plan(df)
    assert compare(df, connect(SMALL), entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["x9_matches_at_k", "q5_sweep"])
def test_no_window_ranks_the_neighbours(spark, monkeypatch, name):
    """Before, one more window sorted what all tasks kept of every query; these two count matches and cut to k."""
    monkeypatch.setattr(jobs, "SHIPPED_PART", 1 << 40)
    assert plan(entry.queries()[name](spark, SMALL)).count("Window [") == 2
