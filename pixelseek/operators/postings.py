"""Inverted index: postings, posting lists and probing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseek.functions.codebooks import MAX_BYTES
from pixelseek.functions.hashing import hash_bucket
from pixelseek.operators.relational import join_side, salted_join, small_side

LIST_DOCS = 100_000


def postings(weights: DataFrame, unique_ids: bool = False) -> DataFrame:
    """(word_id, vec_id, weight), one row per word and image; a repeated image keeps its least weight.

    ``unique_ids=True`` promises that ``vec_id`` is a key and leaves out the shuffle.
    """
    rows = weights.select("word_id", "vec_id", "weight")
    if unique_ids:
        return rows
    return rows.groupBy("word_id", "vec_id").agg(F.min("weight").alias("weight"))


def posting_lists(rows: DataFrame, list_docs: int = LIST_DOCS) -> DataFrame:
    """(word_id, block, docs): each word's list cut into hashed blocks of about ``list_docs`` images.

    A word used by a third of all images becomes many rows, none of which outgrows a task.
    """
    counts = rows.groupBy("word_id").agg(F.count("weight").alias("n"))
    blocks = counts.select("word_id", F.ceil(F.col("n") / list_docs).cast("int").alias("blocks"))
    # One row per word: the counts travel to the postings.
    sized = join_side(rows, blocks, "word_id")
    placed = sized.withColumn("block", hash_bucket(F.col("blocks"), F.col("vec_id")))
    return placed.groupBy("word_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "weight"))).alias("docs")
    )


def probe(query_words: DataFrame, rows: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Equi join of query words (query_id, word_id) with postings.

    A measured small query side is broadcast, so postings never move. Otherwise words are
    salted by image, because a common word may carry a third of the postings.
    """
    docs = rows.select("word_id", "vec_id")
    words = query_words.select("query_id", "word_id")
    if small_side(words, max_bytes=max_bytes):
        met = docs.join(F.broadcast(words), "word_id")
    else:
        met = salted_join(docs, words, "word_id", "vec_id")
    return met.select("query_id", "word_id", "vec_id")


def candidates(probed: DataFrame) -> DataFrame:
    """Distinct (query_id, vec_id); duplicates are combined inside tasks before the shuffle."""
    return probed.select("query_id", "vec_id").distinct()
