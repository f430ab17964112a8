"""Product-quantization jobs: train, encode, search, evaluate, sweep."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseek.functions.codebooks import MAX_BYTES, Centers, local_table
from pixelseek.operators.code_tables import CodeTables
from pixelseek.operators.multi_index import MultiIndex
from pixelseek.operators.quantizer import (
    cluster_stats,
    distance_tables,
    fetch_centers,
    initial_stats,
    merge_stats,
    table_distances,
)
from pixelseek.operators.ranking import (
    MAX_K,
    at_k,
    class_counts,
    cum_matches,
    gallery,
    pq_curve,
)
from pixelseek.operators.relational import join_side, select_queries, with_dim
from pixelseek.operators.scan import INDEX_ROWS, QUERY_STEP, topk_scan, topk_spread

# Iteration limit and stop rule.
MAX_ITER, TOLERANCE = 100, 1e-10
# Queries that, with their neighbours, take more than a SHIPPED_PART of max_bytes are dealt to the tasks, unless they are
# but one step of a task.
SHIPPED_PART = 8


def fit_pq(
    vectors: DataFrame,
    groups: int,
    clusters: int,
    max_iter: int = MAX_ITER,
    tol: float | None = TOLERANCE,
    seed: int = 0,
    dim: int | None = None,
) -> DataFrame:
    """Cartesian k-means: centres (gid, cid, c) of ``groups`` independent Lloyd runs.

    Each iteration is one job that reads the vectors once, assigns, and adds up per task; only
    groups x clusters centres reach the driver. Iterations share no lineage, so nothing has to be
    checkpointed and a lost executor repeats its part of one pass. The first assignment is a
    seeded hash. Empty clusters vanish. ``tol=None`` runs all iterations. Vectors of another length
    than ``dim`` are left out; without ``dim`` all must have one length.
    """
    return fit_pq_trace(vectors, groups, clusters, max_iter, tol, seed, dim)[0]


def fit_pq_trace(
    vectors: DataFrame,
    groups: int,
    clusters: int,
    max_iter: int = MAX_ITER,
    tol: float | None = TOLERANCE,
    seed: int = 0,
    dim: int | None = None,
) -> tuple[DataFrame, list[float]]:
    """Centres and the distortion seen by each assignment pass."""
    if dim is None:
        sizes = vectors.where(F.col("vec").isNotNull()).agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
        if sizes[0] is None or sizes[0] != sizes[1]:
            raise ValueError(f"vectors of lengths {sizes[0]} to {sizes[1]}: say which by dim")
        dim = sizes[0]
    rows = merge_stats(initial_stats(vectors, dim, groups, clusters, seed)).collect()
    costs: list[float] = []
    for _ in range(max_iter - 1):
        rows = merge_stats(cluster_stats(vectors, Centers.of(rows))).collect()
        costs.append(sum(r["cost"] for r in rows))
        if tol is not None and len(costs) > 1 and abs(costs[-1] - costs[-2]) < tol:
            break
    centers = local_table(
        vectors.sparkSession,
        {
            "gid": pa.array([r["gid"] for r in rows], pa.int32()),
            "cid": pa.array([r["cid"] for r in rows], pa.int32()),
            "c": pa.array([r["c"] for r in rows], pa.list_(pa.float64())),
        },
    )
    return centers, costs


def search_pq(
    queries: DataFrame,
    codes: DataFrame,
    centers: DataFrame,
    k: int,
    without_self: bool = True,
    max_bytes: int = MAX_BYTES,
    index_rows: int = INDEX_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, dist): the k nearest codes by asymmetric distance.

    With ``without_self`` the query's own id is left out and exactly k others are kept. A few queries are
    shipped to the codes: stretches of at least ``index_rows`` of them are laid out by their first two groups, and
    buckets that cannot hold a neighbour are skipped. Many queries are dealt to tasks that read all codes, laid out as
    ``CodeTables``. Either way the answer is that of the full scan.
    """
    # Centres are parameter-sized (groups x clusters x sub-dimension), whatever the number of images.
    book = fetch_centers(centers, None)
    asked = with_dim(queries, book.dim)
    few = max(QUERY_STEP, max_bytes // SHIPPED_PART // (8 * book.dim + 16 * (k + 1)))
    if asked.limit(few + 1).count() > few:
        width = 1 + max(int(cids[-1]) for cids, _ in book.groups)
        return topk_spread(
            codes,
            asked,
            k,
            prepare=lambda q: distance_tables(q, book),
            index=lambda rows, ids: CodeTables(rows, ids, width),
            base_col="code",
            width=len(book.groups),
            dim=book.dim,
            without_self=without_self,
            max_bytes=max_bytes,
        )
    return topk_scan(
        codes,
        asked,
        k,
        prepare=lambda q: distance_tables(q, book),
        score=table_distances,
        base_col="code",
        width=len(book.groups),
        without_self=without_self,
        max_bytes=max_bytes,
        index=MultiIndex,
        index_rows=index_rows,
    )


def query_demo(
    ids: DataFrame,
    vectors: DataFrame,
    codes: DataFrame,
    centers: DataFrame,
    images: DataFrame,
    labels: DataFrame,
    k: int = 4,
) -> DataFrame:
    """Result page per chosen query: the query at position 0, then its k nearest, with path and class."""
    chosen = select_queries(vectors, ids).select(F.col("vec_id").alias("query_id"), "vec")
    near = search_pq(chosen, codes, centers, k).select("query_id", F.col("rank").alias("position"), "vec_id")
    own = chosen.select("query_id", F.lit(0).alias("position"), F.col("query_id").alias("vec_id"))
    return gallery(own.unionByName(near), images, labels)


def evaluate_pq(
    queries: DataFrame, codes: DataFrame, centers: DataFrame, labels: DataFrame, k: int
) -> DataFrame:
    """Neighbours with query and hit labels; feed to ``hit_ratio`` or ``format_neighbours``."""
    # A query has k hits at most, so no key of the first join is hot; the search stands once in the plan.
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    other = labels.select("vec_id", F.col("label").alias("hit_label"))
    near = search_pq(queries, codes, centers, k)
    return join_side(join_side(near, own, "query_id"), other, "vec_id")


def sweep_pq(
    queries: DataFrame, codes: DataFrame, centers: DataFrame, labels: DataFrame, max_k: int = MAX_K
) -> DataFrame:
    """Quality for every k of the grid, from one search at the largest k."""
    ranked = evaluate_pq(queries, codes, centers, labels, max_k)
    at = at_k(cum_matches(ranked, max_k), max_k, short_lists="keep")
    return pq_curve(at, class_counts(labels))
