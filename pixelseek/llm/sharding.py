"""Proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. Row r of a source with n rows gets the fractional
rank (2r + 1) / 2n; sorted by it, every stretch of the order holds the sources in their overall proportions, so cutting
the order into equal pieces gives shards that all match the mixture, with row counts at most one apart.

Ranks are those of keys (source, hash of the id, hash of the row), which are all that is sorted for them: no window
holds a whole source or the whole table, as hashes and fractional ranks are evenly spread and each source, and then the
whole order, is cut into buckets of about ``bucket_rows`` rows; ranks are bucket offset plus row number. The rows of one
source in one output file are a stretch of its hash order, so a document finds its file by the first hash of each
stretch in its bucket, a table of one row per bucket and stretch. Each text is then shuffled once, to its file, where
rows are numbered in the same order. Rows that are equal in all columns are one key with a count.

Defined cases: a null source is a source of its own; rows of equal id are ordered by a hash of all their columns, rows
equal in all columns are interchangeable; an empty table gives an empty table; fewer rows than shards leave shards
empty; columns named like the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseek.llm.common import broadcast_if_small, stored

BUCKET_ROWS = 4_000
#: Tables of offsets and stretches up to this many rows (some 30 MB) are broadcast, larger ones are joined by a shuffle.
MAX_OFFSETS = 500_000
_KEY = ["_source", "_h", "_tie"]
_FILE = ["shard", "_piece"]


def _offsets(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Rows in earlier buckets, within the same ``by``."""
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def _ranked(
    rows: DataFrame, by: list[str], bucket: str, order: list[str], max_offsets: int, weight: str = "1"
) -> DataFrame:
    """``_rank`` from 0 within ``by``, without a window over a whole group: the sum of weights before a row."""
    counts = rows.groupBy(*by, bucket).agg(F.sum(F.expr(weight)).alias("_rows"))
    offsets = broadcast_if_small(stored(_offsets(counts, by, bucket).drop("_rows"), "offsets"), max_offsets)
    before = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    number = F.coalesce(F.sum(F.expr(weight)).over(before), F.lit(0))
    return rows.withColumn("_number", number).join(offsets, [*by, bucket]).withColumn(
        "_rank", F.col("_before") + F.col("_number")
    ).drop("_number", "_before")


def _fraction(rank: str) -> Column:
    return (2 * F.col(rank) + 1) / (2 * F.col("_n"))


def _placed(keyed: DataFrame, total: int, shards: int, bucket_rows: int, rows_per_file: int, max_offsets: int) -> DataFrame:
    """(_source, _h, _tie, _copies, _bucket, _r, shard, _piece): every row's rank in its source, its shard and file."""
    keys = keyed.groupBy(*_KEY, "_n", "_bucket").agg(F.count(F.lit(1)).alias("_copies"))
    ranked = _ranked(keys, ["_source"], "_bucket", ["_h", "_tie"], max_offsets, "_copies")
    each = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    each = each.withColumn("_r", F.col("_rank") + F.col("_copy")).drop("_rank", "_copy").withColumn("_f", _fraction("_r"))
    buckets = max(1, -(-total // bucket_rows))
    dealt = stored(
        each.withColumn("_cut", F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1)).cast("long")), "ranked"
    )
    placed = _ranked(dealt, [], "_cut", ["_f", "_source", "_r"], max_offsets)
    shard = F.expr(f"_rank * {shards} div {max(1, total)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return stored(
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("_piece", F.floor((F.col("_rank") - start) / rows_per_file))
        .select(*_KEY, "_copies", "_bucket", "_r", *_FILE),
        "placed",
    )


def interleave(
    docs: DataFrame,
    shards: int,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
    max_offsets: int = MAX_OFFSETS,
    rows_per_file: int = BUCKET_ROWS,
) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0 without gaps); needs doc_id and source.

    Rows lie in one partition with the others of their stretch of ``rows_per_file`` slots, as ``write_shards`` wants."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    key = [
        # A prefix keeps a null source apart from all others.
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("_source"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), 1).alias("_h"),
        F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("_tie"),
    ]
    sizes = stored(docs.select(key[0]).groupBy("_source").agg(F.count(F.lit(1)).alias("_n")), "sources")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    sizes = broadcast_if_small(sizes, max_offsets)
    pieces = F.ceil(F.col("_n") / bucket_rows)

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.join(sizes, "_source").withColumn("_bucket", F.shiftright(F.shiftright("_h", 31) * pieces, 32))

    placed = _placed(bucketed(docs.select(*key)), total, shards, bucket_rows, rows_per_file, max_offsets)
    # The stretches of a bucket, by their first key; no more than the bucket has rows.
    first = F.min(F.struct("_h", "_tie")).alias("start")
    cells = placed.groupBy("_source", "_bucket", *_FILE).agg(first, F.min("_r").alias("_first"))
    listed = cells.groupBy("_source", "_bucket").agg(F.sort_array(F.collect_list(F.struct("start", *_FILE, "_first"))).alias("_cells"))
    listed = broadcast_if_small(stored(listed, "stretches"), max_offsets)
    repeated = placed.filter("_copies > 1")
    rows = bucketed(docs.select(row.alias("_row"), *key))
    again = None
    if not repeated.isEmpty():
        known = broadcast_if_small(repeated.select(*_KEY).distinct(), max_offsets)
        one = rows.join(known, _KEY).groupBy(*_KEY, "_n").agg(F.first("_row").alias("_row"))
        again = one.join(repeated.drop("_copies", "_r"), _KEY).join(cells.drop("start"), ["_source", "_bucket", *_FILE])
        rows = rows.join(known, _KEY, "left_anti")
    here = F.struct("_h", "_tie")
    found = rows.join(listed, ["_source", "_bucket"]).withColumn(
        "_cell", F.element_at(F.filter("_cells", lambda c: c["start"] <= here), -1)
    )
    columns = ["_row", *_KEY, "_n", "_bucket"]
    found = found.select(*columns, "_cell.shard", "_cell._piece", "_cell._first")
    if again is not None:
        found = found.unionByName(again.select(found.columns))
    stretch = Window.partitionBy(*_FILE, "_source", "_bucket").orderBy("_h", "_tie")
    whole = Window.partitionBy(*_FILE).orderBy("_f", "_source", "_r")
    numbered = (
        found.repartition(*_FILE)
        .withColumn("_r", F.col("_first") + F.row_number().over(stretch) - 1)
        .withColumn("_f", _fraction("_r"))
        .withColumn("slot", F.col("_piece") * rows_per_file + F.row_number().over(whole) - 1)
    )
    return numbered.select("_row.*", "shard", "slot")


def write_shards(dealt: DataFrame, path: str, rows_per_file: int = BUCKET_ROWS) -> None:
    """Rows of ``interleave`` as a folder ``shard=N`` per shard, of Parquet files that each are stretches of slots in order.

    They are written where they lie."""
    (
        dealt.sortWithinPartitions("shard", "slot")
        .write.option("maxRecordsPerFile", rows_per_file)
        .partitionBy("shard")
        .parquet(path)
    )
