"""Exact deduplication with a heavy-hitter split.

A Misra-Gries sketch (``approx_top_k``) finds the digests that may be frequent. Their exact counts and largest ids are
verified by one aggregation with map-side combining, and the few verified winners are broadcast: copies of them are
decided, or removed, in the task that reads them. All other digests are grouped by an ordinary shuffle, in which no
digest has more than a small share of the rows.

Defined cases: a null text counts as the empty text; a null id is smaller than any other; rows that repeat both id and
text are one document, of which ``duplicate_groups`` reports each row and ``drop_duplicates`` keeps one row; an empty
table gives an empty table; other columns, of whatever name, are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseek.llm.common import stored

#: Digests a sketch may hold: any digest with more than about 1/3000 of the rows is among them.
TRACKED = 4096
#: Candidates taken from the sketch; the broadcast table has at most so many rows.
CANDIDATES = 1024
#: A candidate is a winner from so many verified copies.
FREQUENT = 32


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def frequent_digests(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of frequent digests, exact: at most ``CANDIDATES`` rows."""
    sketch = digests.agg(F.expr(f"approx_top_k(digest, {CANDIDATES}, {TRACKED})").alias("top"))
    candidates = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("digest"))
    return (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= FREQUENT)
    )


def _digests(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; the largest id of equal texts is kept."""
    digests = _digests(docs)
    winners = stored(frequent_digests(digests), "winners")
    hot = digests.join(F.broadcast(winners), "digest")
    alone = Window.partitionBy("digest")
    rest = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("keep_id", F.max("doc_id").over(alone))
        .withColumn("group_size", F.count(F.lit(1)).over(alone))
    )
    return hot.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of equal texts the one with the largest id."""
    winners = stored(frequent_digests(_digests(docs)), "winners")
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col("doc_id").alias("_id"),
        text_digest(F.col("text")).alias("digest"),
    )
    small = winners.select("digest", F.col("keep_id").alias("_keep"))
    # Copies of a winner go where they are read.
    left = keyed.join(F.broadcast(small), "digest", "left").filter(
        F.col("_keep").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))
    )
    # A limit on the row number is also applied before the shuffle, so repeated rows don't gather in one task.
    order = Window.partitionBy("digest").orderBy(F.col("_id").desc())
    return left.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("row.*")
