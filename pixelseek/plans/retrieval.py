"""Inverted-index jobs: build, search, and report precision and recall."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseek.functions import kernels
from pixelseek.functions.codebooks import MAX_BYTES, Dictionary, fetch
from pixelseek.operators.abandon import Abandoning
from pixelseek.operators.postings import candidates, postings, probe
from pixelseek.operators.ranking import (
    MAX_K,
    at_k,
    class_counts,
    cum_matches,
    exclude_self,
    pr_curve,
    pr_per_query,
    rerank,
    top_hits,
)
from pixelseek.operators.scan import INDEX_ROWS, topk_scan
from pixelseek.operators.words import THRESHOLD, soft_assign


def build_index(
    vectors: DataFrame,
    words: DataFrame,
    threshold: float = THRESHOLD,
    metric="chi2",
    unique_ids: bool = False,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Postings (word_id, vec_id, weight) of all vectors softly assigned to all words."""
    return postings(soft_assign(vectors, words, threshold, metric, max_bytes), unique_ids)


def query_words(
    queries: DataFrame,
    words: DataFrame,
    threshold: float = THRESHOLD,
    metric="chi2",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    named = queries.where(F.length(F.trim(F.col("query_id").cast("string"))) > 0)
    asked = named.select(F.col("query_id").alias("vec_id"), "vec")
    assigned = soft_assign(asked, words, threshold, metric, max_bytes)
    return assigned.select(F.col("vec_id").alias("query_id"), "word_id", "weight")


def search_index(
    queries: DataFrame,
    words: DataFrame,
    index: DataFrame,
    threshold: float = THRESHOLD,
    metric="chi2",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Distinct (query_id, vec_id) that share at least one word."""
    return candidates(probe(query_words(queries, words, threshold, metric, max_bytes), index, max_bytes))


def ranked_hits(
    hits: DataFrame,
    queries: DataFrame,
    vectors: DataFrame,
    labels: DataFrame,
    max_k: int | None = None,
    metric="chi2",
    without_self: bool = True,
) -> DataFrame:
    """Hits re-scored on the full vectors, all or the best ``max_k`` per query, with both labels.

    ``queries`` has (query_id, vec, query_label). Hit labels are joined after the cut.
    """
    if without_self:
        hits = exclude_self(hits)
    return _with_labels(top_hits(rerank(hits, queries, vectors, metric), max_k), queries, labels)


def search_and_rank(
    queries: DataFrame,
    words: DataFrame,
    vectors: DataFrame,
    max_k: int | None = None,
    threshold: float = THRESHOLD,
    metric: str = "chi2",
    without_self: bool = True,
    max_bytes: int = MAX_BYTES,
    index_rows: int = INDEX_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, dist): search and exact re-ranking in one scan of the vectors.

    Gives the best ``max_k`` of ``rerank(search_index(...))`` without ever writing the
    (query, image) pairs: a task finds the words of its images, drops those that share none with
    a query, scores the rest on the full vectors and keeps ``max_k`` per query. In stretches of at
    least ``index_rows`` images it gives up on an image once part of its coordinates is too far. A dictionary
    too large to ship or with words of several lengths, and a ranking of all hits (no ``max_k``),
    take the way through the index.
    """
    rows = fetch(words, "wv", max_bytes)
    by_length = Dictionary.of(rows).by_length if rows is not None else {}
    if max_k is None or len(by_length) != 1:
        index = build_index(vectors, words, threshold, metric, max_bytes=max_bytes)
        hits = search_index(queries, words, index, threshold, metric, max_bytes)
        if without_self:
            hits = exclude_self(hits)
        return top_hits(rerank(hits, queries, vectors, metric), max_k).select("query_id", "rank", "vec_id", "dist")
    ((_, book),) = by_length.values()
    block = kernels.BLOCKS[metric]

    def with_words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x, (kernels.minmax_rows(block(x, book)) < threshold).astype(np.float32)

    def score(asked: tuple[np.ndarray, np.ndarray], shown: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        (q, q_words), (x, x_words) = asked, shown
        share = q_words @ x_words.T > 0
        out = np.full(share.shape, np.inf)
        # Each query is scored against the images that share a word with it, and no others.
        for line, marks, one in zip(out, share, q):
            if marks.any():
                line[marks] = block(x[marks], one[None, :])[:, 0]
        return out

    def abandoning(rows: np.ndarray) -> Abandoning:
        _, words = with_words(rows)
        return Abandoning(rows, metric, lambda q_words: q_words @ words.T > 0)

    return topk_scan(
        vectors,
        queries.where(F.size("vec") == book.shape[1]),
        max_k,
        prepare=with_words,
        describe=with_words,
        score=score,
        base_col="vec",
        width=book.shape[1],
        without_self=without_self,
        max_bytes=max_bytes,
        index=abandoning,
        index_rows=index_rows,
    )


def report(best: DataFrame, queries: DataFrame, labels: DataFrame, max_k: int) -> DataFrame:
    at = at_k(cum_matches(_with_labels(best, queries, labels), max_k), max_k, short_lists="clamp")
    return pr_curve(pr_per_query(at, class_counts(labels)))


def _with_labels(best: DataFrame, queries: DataFrame, labels: DataFrame) -> DataFrame:
    named = best.join(labels.select("vec_id", F.col("label").alias("hit_label")), "vec_id")
    return named.join(queries.select("query_id", "query_label"), "query_id")


def search_report(
    queries: DataFrame,
    words: DataFrame,
    vectors: DataFrame,
    labels: DataFrame,
    max_k: int = MAX_K,
    threshold: float = THRESHOLD,
    metric: str = "chi2",
    without_self: bool = True,
) -> DataFrame:
    """(k, precision, recall, accuracy) of searching ``queries``, by ``search_and_rank``."""
    best = search_and_rank(queries, words, vectors, max_k, threshold, metric, without_self)
    return report(best, queries, labels, max_k)


def pr_report(
    hits: DataFrame,
    queries: DataFrame,
    vectors: DataFrame,
    labels: DataFrame,
    max_k: int = MAX_K,
    metric="chi2",
    without_self: bool = True,
) -> DataFrame:
    """(k, precision, recall, accuracy) of a result set."""
    ranked = ranked_hits(hits, queries, vectors, labels, max_k, metric, without_self)
    at = at_k(cum_matches(ranked, max_k), max_k, short_lists="clamp")
    return pr_curve(pr_per_query(at, class_counts(labels)))
