"""Ranking of hits, top-k, running matches and precision / recall metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelseek.functions.vector import METRICS
from pixelseek.operators.relational import all_ranked, hot_join, join_side, label_name, top_ranked

# The grid is 10, 20 ... 100, 200 ... 5000.
FINE_STEP, FINE_END, COARSE_STEP, MAX_K = 10, 100, 100, 5000
# Ranks of a list that are counted in one window.
RANGE_ROWS = 100_000


def k_values(max_k: int = MAX_K) -> list[int]:
    fine = range(FINE_STEP, min(FINE_END, max_k) + 1, FINE_STEP)
    return [*fine, *range(FINE_END + COARSE_STEP, max_k + 1, COARSE_STEP)]


def k_grid(spark: SparkSession, max_k: int = MAX_K) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in k_values(max_k)])).alias("k"))


def exclude_self(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("query_id") != F.col("vec_id"))


def rerank(hits: DataFrame, queries: DataFrame, vectors: DataFrame, metric="chi2") -> DataFrame:
    """Exact distance of every hit: (query_id, vec_id, dist).

    Queries (query_id, vec) are broadcast when small; the vectors are joined on their id.
    """
    fn = METRICS.get(metric, metric) if isinstance(metric, str) else metric
    asked = queries.select("query_id", F.col("vec").alias("query_vec"))
    met = hits.select("query_id", "vec_id").join(vectors.select("vec_id", "vec"), "vec_id")
    met = join_side(met, asked, "query_id", array_col="query_vec")
    return met.select("query_id", "vec_id", fn(F.col("query_vec"), F.col("vec")).alias("dist"))


def top_hits(scored: DataFrame, max_k: int | None = None, tie: str = "vec_id") -> DataFrame:
    """Rank each query's hits by distance: all of them, or the best ``max_k``.

    A bound is part of the ranking, so Spark cuts to ``max_k`` rows per query inside each
    task before the shuffle; a query that hits a third of the table costs max_k rows per task.
    Without a bound ranks are counted range by range, so no task holds all hits of a query.
    """
    if max_k is None:
        return all_ranked(scored, ["dist", tie])
    return top_ranked(scored, max_k, ["dist", tie])


def cum_matches(ranked: DataFrame, max_k: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Running count of hits that carry the query's label, by rank.

    Lists cut to ``max_k`` are counted in one window each. Without a bound counts run inside ranges of ``range_rows``
    ranks, and the sums of earlier ranges are added, so no task holds one query's whole list.
    """
    same = (F.col("query_label") == F.col("hit_label")).cast("int")
    if max_k is not None:
        run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        return ranked.withColumn("matches", F.sum(same).over(run).cast("int"))
    cut = ranked.withColumn("_range", F.floor((F.col("rank") - 1) / range_rows))
    sums = cut.groupBy("query_id", "_range").agg(F.sum(same).alias("_n"))
    earlier = Window.partitionBy("query_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("query_id", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    run = Window.partitionBy("query_id", "_range").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = cut.withColumn("_inside", F.coalesce(F.sum(same).over(run), F.lit(0))).join(offsets, ["query_id", "_range"])
    matches = (F.col("_before") + F.col("_inside")).cast("int")
    return counted.select(*ranked.columns, matches.alias("matches"))


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def query_context(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Composite key of each hit: query, its label, and the sizes of class 1 and of the rest."""
    sizes = labels.agg(
        F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") != 1).alias("tn")
    )
    key = F.struct("query_id", F.col("label").alias("query_label"), "tp", "tn")
    owners = labels.select(F.col("vec_id").alias("query_id"), "label")
    return (
        hot_join(hits, owners, "query_id", "vec_id")
        .withColumn("_sizes", sizes.select(F.struct("tp", "tn")).scalar())
        .select("*", "_sizes.tp", "_sizes.tn")
        .select(key.alias("key"), "vec_id")
    )


def at_k(cumulated: DataFrame, max_k: int, short_lists: str) -> DataFrame:
    """(query_id, query_label, k, shown, matches) for every k of the grid.

    One ranked pass serves all k: the row at rank min(k, list length) answers for k. ``shown``
    is k, or the list length when ``short_lists`` is "clamp". Ranks beyond the grid answer for none.
    """
    grid = F.array(*[F.lit(k) for k in k_values(max_k)])
    ends = cumulated.where(F.col("rank") <= max_k).withColumn("last", F.max("rank").over(Window.partitionBy("query_id")))
    answers = F.explode(F.filter(grid, lambda k: F.least(k, F.col("last")) == F.col("rank")))
    shown = F.col("rank") if short_lists == "clamp" else F.col("k")
    return ends.select("query_id", "query_label", "rank", "matches", answers.alias("k")).select(
        "query_id", "query_label", "k", shown.alias("shown"), "matches"
    )


def pr_per_query(at: DataFrame, class_sizes: DataFrame) -> DataFrame:
    """Precision, recall and two-class vote per (query, k).

    The vote is the query's own label only if matches outnumber mismatches.
    """
    sizes = class_sizes.select(F.col("label").alias("query_label"), F.col("n").alias("class_size"))
    misses = F.col("shown") - F.col("matches")
    own = F.col("query_label")
    return join_side(at, sizes, "query_label").select(
        "query_id",
        "k",
        "query_label",
        (F.col("matches") / F.col("shown")).alias("precision"),
        (F.col("matches") / F.col("class_size")).alias("recall"),
        F.when(F.col("matches") > misses, own)
        .when(own == 1, F.lit(2))
        .otherwise(F.lit(1))
        .alias("vote"),
    )


def pr_curve(per_query: DataFrame) -> DataFrame:
    """Means over queries for each k; accuracy is the share of right votes."""
    right = (F.col("vote") == F.col("query_label")).cast("int")
    return per_query.groupBy("k").agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg(right).alias("accuracy"),
    )


def pq_curve(at: DataFrame, class_sizes: DataFrame) -> DataFrame:
    """Quality per k: mean share of right neighbours, mean recall, share of queries with a right majority."""
    sizes = class_sizes.select(F.col("label").alias("query_label"), F.col("n").alias("class_size"))
    ratio = F.col("matches") / F.col("k")
    return (
        join_side(at, sizes, "query_label")
        .groupBy("k")
        .agg(
            F.avg(ratio).alias("precision"),
            F.avg(F.col("matches") / F.col("class_size")).alias("recall"),
            F.avg((ratio > 0.5).cast("int")).alias("accuracy"),
        )
    )


def hit_ratio(labelled: DataFrame) -> DataFrame:
    """Same-label neighbours over all neighbours."""
    same = (F.col("query_label") == F.col("hit_label")).cast("int")
    return labelled.agg(
        F.count(F.lit(1)).alias("neighbours"), F.sum(same).alias("rights"), F.avg(same).alias("ratio")
    )


def format_neighbours(labelled: DataFrame) -> DataFrame:
    """One line per query, ``id(label) id(label) ...`` in rank order. Lists are top-k lists, hence bounded."""
    item = F.struct("rank", F.format_string("%s(%s)", "vec_id", "hit_label").alias("text"))
    lists = labelled.groupBy("query_id", "query_label").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    return lists.select(
        F.format_string("%s(%s)", "query_id", "query_label").alias("query"),
        F.array_join(F.transform("items", lambda i: i["text"]), " ").alias("neighbours"),
    )


def gallery(neighbours: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """Neighbours with image path and class name."""
    named = labels.select("vec_id", label_name(F.col("label")).alias("class_name"))
    return neighbours.join(images.select("vec_id", "path"), "vec_id").join(named, "vec_id")


def classification_error(predicted: DataFrame) -> DataFrame:
    """Share of rows whose ``pred`` differs from ``label``."""
    wrong = (F.col("pred") != F.col("label")).cast("int")
    return predicted.agg(
        F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("wrong"), F.avg(wrong).alias("error")
    )


def misclassified(predicted: DataFrame) -> DataFrame:
    return predicted.where(F.col("pred") != F.col("label"))


def class_sizes(images: DataFrame, class_col: str = "class_name") -> DataFrame:
    """Images per class, and in total in the row with a NULL class."""
    return images.rollup(class_col).agg(F.count(F.lit(1)).alias("n"))
