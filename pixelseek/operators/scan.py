"""Exhaustive top-k scans: every query against every row, keeping k per query in each task.

Tasks emit at most k rows per query, never the pairs. The base table is read in place, once: neither
side is copied or shuffled. Queries that, with their k best rows, fit STATE_FACTOR x ``max_bytes`` are
shipped. More are written once to the shared folder in blocks of that size; each task then holds a
stretch of its rows and reads one block after the other past it, so no query row reaches the driver
and the base is read and described once whatever the number of blocks.

Where a stretch is long, an index of its rows may find the k nearest without looking at all of them.

``topk_spread`` goes the other way round, for as many queries as rows: the queries are dealt to tasks, and the base goes
past them in blocks. A query's k rows come from one task, so the number of tasks does not multiply them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseek.functions import kernels
from pixelseek.functions.blocks import Blocks, write_blocks
from pixelseek.functions.codebooks import MAX_BYTES, fetch
from pixelseek.operators.relational import top_ranked

QUERY_STEP = 128
# Bytes of rows that are scored together, and that are gathered before queries are prepared.
CHUNK_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
# Bytes of rows that a task holds while the blocks of queries go past.
STRETCH_BYTES = 128 << 20
# From so many rows on an index of a stretch pays.
INDEX_ROWS = 16384
# Neighbours found before they are merged with the k best.
MERGE_ROWS = 1 << 20
# A task may hold STATE_FACTOR x max_bytes of queries with their k best rows.
STATE_FACTOR = 4
# Queries that are dealt to a task, and tasks for each core at least.
SPREAD_ROWS, SPREAD_TASKS = 8192, 3

Prepare = Callable[[np.ndarray], Any]
Describe = Callable[[np.ndarray], Any]
Score = Callable[[Any, Any], np.ndarray]


class Index(Protocol):
    """Rows laid out for search: places, by query, of all rows among the ``k`` nearest and not beyond ``limit``."""

    def search(self, prepared: Any, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, distance); rows that can't be among the k nearest may be among them."""


class BestOf:
    """The k nearest (distance, id) seen so far for each query; ties keep the lowest id."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        # Distances beyond a query's limit cannot be among its k best.
        self.limit = np.full(n_queries, np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add_rows(self, rows: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Distances |rows| x |ids|; ``rows`` are numbers of different queries."""
        limit = self.limit[rows]
        if dist.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
            self.limit[rows] = limit
        q, at = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
        self.add_found(rows[q], dist[q, at], ids[at])

    def add_found(self, q: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        self.parts.append((q, dist, ids))
        self.held += len(q)
        if self.held > MERGE_ROWS + len(self.limit) * self.k:
            self.merge()

    def merge(self) -> None:
        if not self.parts:
            return
        q, dist, ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, dist, q))
        q, dist, ids = q[order], dist[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.limit[q[last]] = dist[last]
        keep = place < self.k
        self.parts = [(q[keep], dist[keep], ids[keep])]
        self.held = int(keep.sum())

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query number, distance, id, rank from 1), in that order."""
        self.merge()
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        ((q, dist, ids),) = self.parts
        return q, dist, ids, 1 + np.arange(len(q)) - np.searchsorted(q, q)

    def table(self, query_ids: np.ndarray, schema: pa.Schema) -> pa.Table:
        self.merge()
        if not self.parts:
            return schema.empty_table()
        ((q, dist, ids),) = self.parts
        cols = [query_ids[q], ids, dist]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _ids(col: pa.Array) -> np.ndarray:
    values = col.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _parts(
    ids: np.ndarray,
    rows: np.ndarray,
    describe: Describe | None,
    index: Callable[[np.ndarray], Index] | None,
    index_rows: int,
) -> list[tuple[np.ndarray, Any, bool]]:
    """(ids, rows as ``score`` or an index takes them, whether it is an index) of a stretch."""
    if index and len(rows) >= index_rows:
        return [(ids, index(rows), True)]
    step = max(1, CHUNK_BYTES // (8 * rows.shape[1]))
    return [
        (ids[a : a + step], describe(rows[a : a + step]) if describe else rows[a : a + step], False)
        for a in range(0, len(rows), step)
    ]


def _scan(best: BestOf, queries: np.ndarray, parts: list, prepare: Prepare, score: Score) -> None:
    for b in range(0, len(queries), QUERY_STEP):
        prepared = prepare(queries[b : b + QUERY_STEP])
        numbers = np.arange(b, min(b + QUERY_STEP, len(queries)))
        for ids, part, indexed in parts:
            if indexed:
                q, at, dist = part.search(prepared, best.limit[b : b + QUERY_STEP], best.k)
                best.add_found(q + b, dist, ids[at])
            else:
                best.add_rows(numbers, score(prepared, part), ids)


def _collected(
    batches: Iterator[pa.RecordBatch], width: int, size: int = BLOCK_BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches joined to stretches of about ``size`` bytes, so that queries are prepared less often."""
    ids, rows, n = [], [], 0
    for batch in batches:
        ids.append(_ids(batch.column(0)))
        rows.append(kernels.list_matrix(batch.column(1), width))
        n += batch.num_rows
        if n * 8 * width >= size:
            yield np.concatenate(ids), np.concatenate(rows)
            ids, rows, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(rows)


def topk_scan(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    prepare: Prepare,
    score: Score,
    base_col: str,
    width: int,
    describe: Describe | None = None,
    without_self: bool = True,
    max_bytes: int = MAX_BYTES,
    index: Callable[[np.ndarray], Index] | None = None,
    index_rows: int = INDEX_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, dist) of the k nearest rows of ``base`` per query.

    ``base`` has vec_id and the array ``base_col`` of length ``width``; ``queries`` has query_id
    and vec. Inside the task ``prepare`` turns a few queries, and ``describe`` a few rows, into
    what ``score`` takes; ``score(q, rows)`` returns the |q| x |rows| distances, infinite for
    rows that do not answer a query. ``index`` lays out a long stretch of rows for search instead;
    it must find the same rows at the same distances.
    """
    keep = k + 1 if without_self else k
    q_type = dict(queries.dtypes)["query_id"]
    v_type = dict(base.dtypes)["vec_id"]
    out_type = f"query_id {q_type}, vec_id {v_type}, dist double"
    arrow_of = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema(
        [("query_id", arrow_of[q_type]), ("vec_id", arrow_of[v_type]), ("dist", pa.float64())]
    )
    table = base.where(F.size(base_col) == width).select("vec_id", base_col)
    asked = queries.select("query_id", "vec")
    limit = STATE_FACTOR * max_bytes
    rows = fetch(asked, "vec", limit, row_bytes=16 * keep)

    def shipped_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shipped.value
        best = BestOf(len(matrix), keep)
        for ids, x in _collected(batches, width):
            _scan(best, matrix, _parts(ids, x, describe, index, index_rows), prepare, score)
        yield from best.table(query_ids, schema).to_batches()

    def block_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _collected(batches, width, STRETCH_BYTES):
            parts = _parts(ids, x, describe, index, index_rows)
            for block in blocks:
                vec = block.column("vec").combine_chunks()
                matrix = kernels.list_matrix(vec, len(vec[0])).astype(float)
                best = BestOf(len(matrix), keep)
                _scan(best, matrix, parts, prepare, score)
                yield from best.table(_ids(block.column("query_id").combine_chunks()), schema).to_batches()

    if rows is None:
        blocks: Blocks = write_blocks(asked, "query_id", "vec", limit, row_bytes=16 * keep)
        partial = table.mapInArrow(block_scan, out_type)
    elif rows:
        sent = np.array([r["query_id"] for r in rows]), np.array([r["vec"] for r in rows], dtype=float)
        shipped = base.sparkSession.sparkContext.broadcast(sent)
        partial = table.mapInArrow(shipped_scan, out_type)
    else:
        partial = base.sparkSession.createDataFrame([], out_type)

    if without_self:
        partial = partial.where(F.col("query_id") != F.col("vec_id"))
    return top_ranked(partial, k, ["dist", "vec_id"]).select("query_id", "rank", "vec_id", "dist")


def _lists(q: np.ndarray, n_queries: int, *columns: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """Numbers of the queries that have rows, and each column as one list for each of them; ``q`` ascends."""
    counts = np.bincount(q, minlength=n_queries)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts[counts > 0]))), pa.int32())
    return pa.array(np.flatnonzero(counts)), [pa.ListArray.from_arrays(offsets, c) for c in columns]


def _merged(
    batches: Iterator[pa.RecordBatch], k: int, without_self: bool, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """(query_id, rank, vec_id, dist) of the k nearest, from rows (query_id, vec_ids, dists) sorted by query_id.

    Rows of one query_id are merged; its k nearest wait for the next batch, in which more of them may follow."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is None and not held:
            return
        rows = pa.concat_batches(held + ([] if batch is None else [batch]))
        asked, lists = rows.column(0), rows.column(1)
        same = pc.fill_null(pc.equal(asked[1:], asked[:-1]), False)
        same = pc.or_(same, pc.and_(pc.is_null(asked[1:]), pc.is_null(asked[:-1]))).to_numpy(zero_copy_only=False)
        group = np.cumsum(np.concatenate(([0], ~same)))
        line = np.repeat(np.arange(len(group)), lists.value_lengths().to_numpy())
        ids, dist = lists.flatten(), rows.column(2).flatten().to_numpy()
        if without_self:
            own = (asked.take(pa.array(line)), ids)
            if pa.types.is_string(asked.type) != pa.types.is_string(ids.type):
                own = [x.cast(pa.string()) for x in own]
            other = pc.not_equal(*own).to_numpy(zero_copy_only=False)
            line, ids, dist = line[other], ids.filter(pa.array(other)), dist[other]
        q = group[line]
        if same.any():
            order = np.lexsort((_ids(ids), dist, q))
            line, ids, dist, q = line[order], ids.take(pa.array(order)), dist[order], q[order]
        rank = 1 + np.arange(len(q)) - np.searchsorted(q, q)
        keep, last = rank <= k, q == (-1 if batch is None else group[-1])
        made, wait = np.flatnonzero(keep & ~last), np.flatnonzero(keep & last)
        held = []
        if batch is not None:
            _, lists = _lists(np.zeros(len(wait), np.int64), 1, ids.take(pa.array(wait)), pa.array(dist[wait]))
            held = [pa.RecordBatch.from_arrays([asked[-1:], *lists], rows.schema.names)] if len(wait) else []
        query, place = asked.take(pa.array(line[made])), pa.array(rank[made], pa.int32())
        columns = [query, place, ids.take(pa.array(made)), pa.array(dist[made])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def topk_spread(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    prepare: Prepare,
    index: Callable[[np.ndarray, np.ndarray], Index],
    base_col: str,
    width: int,
    dim: int,
    without_self: bool = True,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The rows of ``topk_scan``, for many queries (query_id, vec of length ``dim``).

    The base is written once, in blocks of ``max_bytes``, to the shared folder. Queries are dealt evenly, whatever their
    ids and files, to tasks that hold SPREAD_ROWS of them at most with their k nearest; each reads the blocks one after
    the other and lays them out by ``index(rows, ids)``. A query's rows are shuffled as one list, to the other rows of
    its query_id, and ranked there without a window.
    """
    keep = k + 1 if without_self else k
    spark = base.sparkSession
    q_type, v_type = dict(queries.dtypes)["query_id"], dict(base.dtypes)["vec_id"]
    table = base.where(F.size(base_col) == width).select("vec_id", base_col)
    asked = queries.where(F.size("vec") == dim).select("query_id", "vec")
    if without_self:
        # An unknown id can't be told from the query's own: no such row is a neighbour.
        table, asked = table.where("vec_id is not null"), asked.where("query_id is not null")
    table = table.persist()
    blocks = write_blocks(table, "vec_id", base_col, max_bytes)
    table.unpersist()
    n, cores = asked.count(), spark.sparkContext.defaultParallelism
    most = max(QUERY_STEP, min(SPREAD_ROWS, max_bytes // (8 * dim + 16 * keep)))
    tasks = max(1, -(-n // most), min(SPREAD_TASKS * cores, -(-n // QUERY_STEP)))
    arrow_of = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    out = pa.schema(
        [("query_id", arrow_of[q_type]), ("rank", pa.int32()), ("vec_id", arrow_of[v_type]), ("dist", pa.float64())]
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in kernels.stretches(batches, most * 8 * dim):
            matrix = kernels.list_matrix(stretch.column(1), dim)
            best = BestOf(len(matrix), keep)
            for block in blocks:
                rows = kernels.list_matrix(block.column(base_col).combine_chunks(), width)
                ids = _ids(block.column("vec_id").combine_chunks())
                _scan(best, matrix, [(ids, index(rows, ids), True)], prepare, None)
            q, dist, ids, _ = best.ranked()
            at, lists = _lists(q, len(matrix), pa.array(ids, out.field("vec_id").type), pa.array(dist))
            yield pa.RecordBatch.from_arrays([stretch.column(0).take(at), *lists], ["query_id", "vec_ids", "dists"])

    packed = asked.repartition(tasks).mapInArrow(
        searched, f"query_id {q_type}, vec_ids array<{v_type}>, dists array<double>"
    )
    return (
        packed.repartition(tasks, "query_id")
        .sortWithinPartitions("query_id")
        .mapInArrow(
            lambda batches: _merged(batches, k, without_self, out),
            f"query_id {q_type}, rank int, vec_id {v_type}, dist double",
        )
    )
