"""Small relational helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelseek.functions.codebooks import MAX_BYTES, measured_bytes, stored
from pixelseek.functions.hashing import hash_bucket
from pixelseek.functions.vector import subvector_array

SALTS = 32
HOT_ROWS = 100_000
RANK_RANGES = 32
# Bits of a row's number in Spark's increasing ids.
PLACE_BITS = 33
TASKS_PER_MERGE, SMALL_K = 32, 100
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def with_dim(df: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """Drop records whose dimension differs from the expected one."""
    return df.where(F.size(vec) == dim)


def nonblank(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.length(F.trim(F.col(c).cast("string"))) > 0)
    return df


def select_queries(df: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows whose key is in ``ids`` (one column of the same name)."""
    return df.join(ids.select(key), key, "left_semi")


def subvectors(df: DataFrame, groups: int) -> DataFrame:
    return df.select("vec_id", F.posexplode(subvector_array(F.col("vec"), groups)).alias("gid", "sub"))


def mean_vectors(df: DataFrame, key: str, vec: str = "vec", out: str = "mean") -> DataFrame:
    """Coordinate means per key. The sums are combined before the shuffle, so a hot key costs d rows per task."""
    cells = df.select(key, F.posexplode(vec).alias("i", "x"))
    means = cells.groupBy(key, "i").agg(F.avg("x").alias("m"))
    rows = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells"))
    return rows.select(key, F.transform("cells", lambda c: c["m"]).alias(out))


def small_side(df: DataFrame, array_col: str | None = None, max_bytes: int = MAX_BYTES) -> bool:
    """True when the measured size of ``df`` allows a broadcast."""
    if array_col is not None:
        return measured_bytes(df, array_col)[1] <= max_bytes
    limit = max_bytes // sum(64 if t == "string" else 16 for _, t in df.dtypes)
    return df.isLocal() or df.limit(limit + 1).count() <= limit


def join_side(
    big: DataFrame,
    side: DataFrame,
    on: str | list[str],
    array_col: str | None = None,
    max_bytes: int = MAX_BYTES,
    how: str = "inner",
) -> DataFrame:
    """Join with a side table: broadcast when its measured size allows, else a shuffled join.

    The shuffled form carries no hint; adaptive execution splits skewed partitions.
    """
    if small_side(side, array_col, max_bytes):
        return big.join(F.broadcast(side), on, how)
    return big.join(side, on, how)


def salts_of(spark: SparkSession) -> int:
    """Tasks over which a hot key is spread: those of a shuffle, but not fewer than SALTS."""
    return max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted_join(big: DataFrame, side: DataFrame, key: str, big_id: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equi join that spreads the hot keys of ``big`` over many tasks.

    A key is hot from ``hot_rows`` rows, so there are at most (rows / hot_rows) hot keys; only
    their rows of ``side`` are repeated, once for each ``hot_rows`` rows of ``big``.
    """
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
    hot = F.broadcast(counts.select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    spread = F.pmod(F.xxhash64(big_id), F.coalesce("_salts", F.lit(1))).cast("int")
    left = big.join(hot, key, "left").withColumn("_salt", spread).drop("_salts")
    places = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = side.join(hot, key, "left").withColumn("_salt", F.explode(places)).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def hot_join(big: DataFrame, side: DataFrame, key: str, big_id: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Equi join on a key of which one value may hold a large share of ``big``.

    A ``side`` whose measured size allows is broadcast; ``big`` then stands once in the plan, and no job
    runs on it beforehand. Else hot keys are salted, for which ``big`` is counted by key first.
    """
    if small_side(side, max_bytes=max_bytes):
        return big.join(F.broadcast(side), key)
    return salted_join(big, side, key, big_id)


def cut_before_shuffle(spark: SparkSession, k: int) -> None:
    """Let the planner cut ranked rows to ``k`` per group inside tasks.

    Spark does so only for limits up to a session setting; it is raised where ``k`` is greater.
    """
    if int(spark.conf.get(GROUP_LIMIT)) < k:
        spark.conf.set(GROUP_LIMIT, str(k))


def top_ranked(df: DataFrame, k: int, order: list[str], merges: int | None = None) -> DataFrame:
    """Add ``rank`` within query_id and keep ranks up to ``k``.

    Every task keeps k rows per query. On a wide cluster with a large k what thousands of tasks
    keep is merged in two steps, so that one query's rows do not meet in one task at once.
    """
    cut_before_shuffle(df.sparkSession, k)
    if merges is None:
        merges = salts_of(df.sparkSession) // TASKS_PER_MERGE if k > SMALL_K else 1
    if merges > 1:
        part = Window.partitionBy("query_id", hash_bucket(merges, F.col("vec_id"))).orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= k).drop("_rank")
    whole = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def in_ranges(df: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """Stored rows with ``_place``: the number of the range in the upper bits, of the row in its range in the lower ones."""
    sorted_ = df.repartitionByRange(ranges, "query_id", *order).sortWithinPartitions("query_id", *order)
    return stored(sorted_.withColumn("_place", F.monotonically_increasing_id()), "ranges")


def all_ranked(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """Add ``rank`` within query_id to all rows; ``order`` ends with a column that tells equal rows apart.

    Rows are cut into ranges of (query_id, order) by splitters that Spark samples, sorted and stored with their place
    in the range. A long list, and a part of it that has one distance, so lies in many ranges, split by id. A rank is
    the row's place in the whole order less that of the query's first row: of each range only its length reaches the
    driver, of each query its first place is joined.
    """
    rows = in_ranges(df, order, ranges or max(RANK_RANGES, salts_of(df.sparkSession)))
    piece = F.shiftright("_place", PLACE_BITS).cast("int")
    sizes = rows.groupBy(piece.alias("_range")).agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    starts, before = [], 0
    for r in sizes:
        starts.append((r["_range"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _before bigint")
    at = F.col("_before") + F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1)
    placed = rows.withColumn("_range", piece).join(F.broadcast(offsets), "_range").withColumn("_at", at)
    firsts = placed.groupBy("query_id").agg(F.min("_at").alias("_first"))
    ranked = join_side(placed, firsts, "query_id").withColumn("rank", (F.col("_at") - F.col("_first") + 1).cast("int"))
    return ranked.drop("_place", "_range", "_before", "_at", "_first")


def label_name(label: Column) -> Column:
    return F.when(label == 1, "adeno").otherwise("squma")


def attach_labels(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``query_label`` and ``hit_label``; a query may own a large share of the hits."""
    q = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    h = labels.select("vec_id", F.col("label").alias("hit_label"))
    return hot_join(hits, q, "query_id", "vec_id").join(h, "vec_id")
