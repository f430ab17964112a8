"""Product quantization: nearest sub-centres, centroids, distortion, codes, asymmetric distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseek.functions import kernels
from pixelseek.functions.blocks import write_blocks
from pixelseek.functions.codebooks import MAX_BYTES, Centers, fetch
from pixelseek.functions.hashing import hash_bucket
from pixelseek.functions.vector import l2sq
from pixelseek.operators.relational import join_side, with_dim

# Bytes of sub-vectors that a task holds while blocks of centres go past, and distances made at once.
STRETCH_BYTES = 64 << 20
PAIRS = 1 << 20
STATS = "gid int, cid int, n bigint, total array<double>, cost double"


def fetch_centers(centers: DataFrame, max_bytes: int | None = MAX_BYTES) -> Centers | None:
    """Centres on the driver, or ``None`` beyond ``max_bytes``."""
    rows = fetch(centers, "c", max_bytes)
    return None if rows is None else Centers.of(rows)


def _cut_by_centers(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(vec_id, gid, sub) with the group lengths of the centres; one number per group reaches the driver."""
    widths = [r["w"] for r in centers.groupBy("gid").agg(F.max(F.size("c")).alias("w")).orderBy("gid").collect()]
    starts = np.cumsum([0, *widths]).tolist()
    subs = F.array(*[F.slice("vec", s + 1, w) for s, w in zip(starts, widths)])
    rows = with_dim(vectors, starts[-1])
    return rows.select("vec_id", F.posexplode(subs).alias("gid", "sub"))


def _assign_udf(centers: Centers):
    slices = centers.slices()

    @F.arrow_udf("array<struct<gid:int,cid:int,dist:double>>")
    def assigned(vec: pa.Array) -> pa.Array:
        x = kernels.list_matrix(vec, centers.dim)
        cid = np.empty((len(x), len(slices)), dtype=np.int32)
        dist = np.empty(cid.shape)
        for g, (s, (cids, book)) in enumerate(zip(slices, centers.groups)):
            cid[:, g], dist[:, g] = kernels.nearest(x[:, s], cids, book)
        gid = np.tile(np.arange(len(slices), dtype=np.int32), len(x))
        return kernels.ragged_struct(
            np.full(len(x), len(slices)),
            gid=pa.array(gid, pa.int32()),
            cid=pa.array(cid.ravel(), pa.int32()),
            dist=pa.array(dist.ravel(), pa.float64()),
        )

    return assigned


def assign(vectors: DataFrame, centers: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(vec_id, gid, cid, dist): nearest centre of each sub-vector, a narrow projection.

    Centres beyond ``max_bytes`` are read in blocks.
    """
    book = fetch_centers(centers, max_bytes)
    if book is None:
        return assign_joined(_cut_by_centers(vectors, centers), centers, max_bytes)
    cells = _assign_udf(book)
    return with_dim(vectors, book.dim).select("vec_id", F.inline(cells("vec")))


def assign_joined(subs: DataFrame, centers: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The same for (vec_id, gid, sub) rows and centre sets too large to ship.

    Centres are written to the shared folder in blocks, which tasks read past the sub-vectors they hold; each
    sub-vector keeps its nearest. Ties take the lowest cid.
    """
    blocks = write_blocks(centers.select("gid", "cid", "c"), "cid", "c", max_bytes)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in kernels.stretches(batches, STRETCH_BYTES):
            gid = stretch.column(1).to_numpy()
            dist, cid = np.full(len(gid), np.inf), np.zeros(len(gid), dtype=np.int32)
            subs = list(kernels.list_rows(stretch.column(2)))
            for block in blocks:
                for at, book in kernels.list_rows(block.column("c").combine_chunks()):
                    gids, cids = block.column("gid").to_numpy()[at], block.column("cid").to_numpy()[at]
                    for rows, x in (g for g in subs if g[1].shape[1] == book.shape[1]):
                        for g in np.unique(gids):
                            own = np.flatnonzero(gids == g)
                            own = own[np.argsort(cids[own])]
                            _keep_nearest(x, rows, gid[rows] == g, cids[own], book[own], dist, cid)
            met = np.flatnonzero(np.isfinite(dist))
            columns = [stretch.column(0).take(pa.array(met)), pa.array(gid[met], pa.int32())]
            columns += [pa.array(cid[met], pa.int32()), pa.array(dist[met], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "gid", "cid", "dist"])

    rows = subs.select("vec_id", F.col("gid").cast("int").alias("gid"), "sub")
    return rows.mapInArrow(nearest, f"vec_id {dict(subs.dtypes)['vec_id']}, gid int, cid int, dist double")


def _keep_nearest(
    x: np.ndarray, rows: np.ndarray, mask: np.ndarray, cids: np.ndarray, book: np.ndarray, dist: np.ndarray, cid: np.ndarray
) -> None:
    """Update (dist, cid) of the masked rows where a centre is nearer, or as near and lower."""
    places = np.flatnonzero(mask)
    step = max(1, PAIRS // len(book))
    for a in range(0, len(places), step):
        part = places[a : a + step]
        found, d = kernels.nearest(x[part], cids, book)
        at = rows[part]
        better = (d < dist[at]) | ((d == dist[at]) & (found < cid[at]))
        dist[at[better]], cid[at[better]] = d[better], found[better]


def centroids(assigned: DataFrame) -> DataFrame:
    """(gid, cid, c) from rows (gid, cid, sub): coordinate means, combined before the shuffle."""
    cells = assigned.select("gid", "cid", F.posexplode("sub").alias("i", "x"))
    means = cells.groupBy("gid", "cid", "i").agg(F.avg("x").alias("m"))
    rows = means.groupBy("gid", "cid").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))
    return rows.select("gid", "cid", F.transform("m", lambda p: p["m"]).alias("c"))


def distortion(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("dist").alias("distortion"))


def _group_slices(dim: int, groups: int) -> list[slice]:
    width = dim // groups
    return [slice(g * width, dim if g == groups - 1 else (g + 1) * width) for g in range(groups)]


class _Totals:
    """Members, coordinate sums and cost per cluster of one group, added up within a task."""

    def __init__(self, cids: np.ndarray, width: int) -> None:
        self.cids = cids
        self.n = np.zeros(len(cids), dtype=np.int64)
        self.cost = np.zeros(len(cids))
        self.sums = np.zeros((len(cids), width))

    def add(self, at: np.ndarray, x: np.ndarray, dist: np.ndarray | None = None) -> None:
        size = len(self.cids)
        self.n += np.bincount(at, minlength=size)
        if dist is not None:
            self.cost += np.bincount(at, weights=dist, minlength=size)
        for j in range(x.shape[1]):
            self.sums[:, j] += np.bincount(at, weights=x[:, j], minlength=size)

    def batch(self, gid: int) -> pa.RecordBatch:
        seen = self.n > 0
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(seen.sum(), gid), pa.int32()),
                pa.array(self.cids[seen], pa.int32()),
                pa.array(self.n[seen], pa.int64()),
                kernels.to_list_array(self.sums[seen], pa.float64()),
                pa.array(self.cost[seen], pa.float64()),
            ],
            names=["gid", "cid", "n", "total", "cost"],
        )


def cluster_stats(vectors: DataFrame, centers: Centers) -> DataFrame:
    """Per (gid, cid): members, coordinate sums and cost, from one pass over the vectors.

    Each task adds up its own rows, so the shuffle carries groups x clusters rows per task.
    """
    slices, dim = centers.slices(), centers.dim

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [_Totals(cids, book.shape[1]) for cids, book in centers.groups]
        for batch in batches:
            x = kernels.list_matrix(batch.column(0), dim)
            for total, s, (cids, book) in zip(groups, slices, centers.groups):
                at, dist = kernels.nearest(x[:, s], np.arange(len(cids)), book)
                total.add(at, x[:, s], dist)
        for gid, total in enumerate(groups):
            yield total.batch(gid)

    return with_dim(vectors, dim).select("vec").mapInArrow(totals, STATS)


def initial_stats(vectors: DataFrame, dim: int, groups: int, clusters: int, seed: int) -> DataFrame:
    """The same totals under the random first assignment, a seeded hash of group and image."""
    slices = _group_slices(dim, groups)
    first = F.array(*[hash_bucket(clusters, seed, g, F.col("vec_id")) for g in range(groups)])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_Totals(np.arange(clusters), s.stop - s.start) for s in slices]
        for batch in batches:
            x = kernels.list_matrix(batch.column(0), dim)
            at = kernels.list_matrix(batch.column(1), groups)
            for g, (total, s) in enumerate(zip(parts, slices)):
                total.add(at[:, g], x[:, s])
        for gid, total in enumerate(parts):
            yield total.batch(gid)

    return with_dim(vectors, dim).select("vec", first.alias("first")).mapInArrow(totals, STATS)


def merge_stats(stats: DataFrame) -> DataFrame:
    """(gid, cid, c, cost): centres from per-task totals."""
    cells = stats.select("gid", "cid", "n", "cost", F.posexplode("total").alias("i", "s"))
    sums = cells.groupBy("gid", "cid", "i").agg(
        (F.sum("s") / F.sum("n")).alias("m"), F.sum("cost").alias("cost")
    )
    rows = sums.groupBy("gid", "cid").agg(
        F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"), F.max("cost").alias("cost")
    )
    return rows.select("gid", "cid", F.transform("p", lambda p: p["m"]).alias("c"), "cost")


def encode(vectors: DataFrame, centers: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(vec_id, code): one cluster id per group, group lengths taken from the centres."""
    book = fetch_centers(centers, max_bytes)
    if book is None:
        cells = assign(vectors, centers, max_bytes).groupBy("vec_id")
        lists = cells.agg(F.array_sort(F.collect_list(F.struct("gid", "cid"))).alias("cs"))
        return lists.select("vec_id", F.transform("cs", lambda c: c["cid"]).alias("code"))
    slices = book.slices()

    def code(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(slices)), dtype=np.int32)
        for g, (s, (cids, matrix)) in enumerate(zip(slices, book.groups)):
            out[:, g], _ = kernels.nearest(x[:, s], cids, matrix)
        return out

    rows = with_dim(vectors, book.dim).select("vec_id", "vec")
    return kernels.map_vectors(rows, code, book.dim, out="code", cell="int")


def distance_tables(queries: np.ndarray, centers: Centers) -> np.ndarray:
    """Squared distance from each query's sub-vectors to every centre: |q| x groups x (max cid + 1).

    Clusters that do not exist are infinitely far."""
    width = 1 + max(int(cids[-1]) for cids, _ in centers.groups)
    tables = np.full((len(queries), len(centers.groups), width), np.inf)
    for g, (s, (cids, book)) in enumerate(zip(centers.slices(), centers.groups)):
        tables[:, g, cids] = kernels.l2_block(queries[:, s], book)
    return tables


def table_distances(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Asymmetric distance: the table entries picked by each code, added group by group."""
    total = np.zeros((len(tables), len(codes)))
    for g in range(tables.shape[1]):
        total += tables[:, g, codes[:, g]]
    return total


def adc(queries: DataFrame, codes: DataFrame, centers: DataFrame) -> DataFrame:
    """(query_id, vec_id, dist) for every query and code, by joining codes with distance tables.

    It makes and shuffles every pair: a check of ``search_pq`` on small tables, not for large ones.
    Rows of the tables are (query_id, gid, cid, d). For top-k answers use ``search_pq``,
    which keeps k per query in each task and does not emit the pairs.
    """
    asked = queries.select(F.col("query_id").alias("vec_id"), "vec")
    subs = _cut_by_centers(asked, centers).withColumnRenamed("vec_id", "query_id")
    tables = subs.join(centers, "gid").select("query_id", "gid", "cid", l2sq(F.col("sub"), F.col("c")).alias("d"))
    picks = codes.select("vec_id", F.posexplode("code").alias("gid", "cid"))
    met = join_side(picks, tables, ["gid", "cid"])
    return met.groupBy("query_id", "vec_id").agg(F.sum("d").alias("dist"))
