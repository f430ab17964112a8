"""Visual words: distances from vectors to a dictionary, and soft assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseek.functions import kernels
from pixelseek.functions.blocks import Blocks, write_blocks
from pixelseek.functions.codebooks import MAX_BYTES, Dictionary, fetch
from pixelseek.functions.hashing import hash_bucket
from pixelseek.functions.vector import minmax
from pixelseek.operators.relational import salts_of
from pixelseek.operators.scan import BestOf

THRESHOLD = 0.8
ARROW_IDS = {"int": pa.int32(), "bigint": pa.int64()}
BLOCK_WORDS = 256
# Bytes of vectors that a task holds while blocks of words go past, and distances made at once.
STRETCH_BYTES = 64 << 20
PAIRS = 1 << 20


def _distance_udf(book: Dictionary, metric: str, id_type: str) -> Column:
    block = kernels.BLOCKS[metric]
    arrow_id = ARROW_IDS[id_type]

    @F.arrow_udf(f"array<struct<word_id:{id_type},dist:double>>")
    def distances(vec: pa.Array) -> pa.Array:
        groups = [g for g in kernels.list_rows(vec) if g[1].shape[1] in book.by_length]
        counts = np.zeros(len(vec), dtype=np.int64)
        for rows, x in groups:
            counts[rows] = len(book.by_length[x.shape[1]][0])
        starts = np.cumsum(counts) - counts
        all_ids, all_dist = np.empty(counts.sum(), np.int64), np.empty(counts.sum())
        for rows, x in groups:
            ids, matrix = book.by_length[x.shape[1]]
            at = starts[rows][:, None] + np.arange(len(ids))
            all_ids[at], all_dist[at] = ids, block(x, matrix)
        return kernels.ragged_struct(
            counts, word_id=pa.array(all_ids, arrow_id), dist=pa.array(all_dist, pa.float64())
        )

    return distances


def _soft_udf(book: Dictionary, metric: str, threshold: float, id_type: str) -> Column:
    block = kernels.BLOCKS[metric]
    arrow_id = ARROW_IDS[id_type]

    @F.arrow_udf(f"array<struct<word_id:{id_type},weight:double>>")
    def soft_words(vec: pa.Array) -> pa.Array:
        rows_out, ids_out, weights_out = [], [], []
        for rows, x in kernels.list_rows(vec):
            if x.shape[1] not in book.by_length:
                continue
            ids, matrix = book.by_length[x.shape[1]]
            w = kernels.minmax_rows(block(x, matrix))
            r, c = np.nonzero(w < threshold)
            rows_out.append(rows[r])
            ids_out.append(ids[c])
            weights_out.append(w[r, c])
        r = np.concatenate(rows_out) if rows_out else np.empty(0, np.int64)
        order = np.argsort(r, kind="stable")
        ids = np.concatenate(ids_out)[order] if rows_out else np.empty(0, np.int64)
        weights = np.concatenate(weights_out)[order] if rows_out else np.empty(0)
        return kernels.ragged_struct(
            np.bincount(r, minlength=len(vec)),
            word_id=pa.array(ids, arrow_id),
            weight=pa.array(weights, pa.float64()),
        )

    return soft_words


def _word_blocks(words: DataFrame, max_bytes: int) -> Blocks:
    """For dictionaries too large to ship: blocks in the shared folder, which tasks read past the vectors they hold."""
    return write_blocks(words.where(F.size("wv") > 0).select("word_id", "wv"), "word_id", "wv", max_bytes)


def _met(stretch: pa.RecordBatch, blocks: Blocks, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, word ids, distances rows x words) for every word of a vector's length, PAIRS at a time."""
    groups = [g for g in kernels.list_rows(stretch.column("vec")) if g[1].shape[1]]
    for block in blocks:
        ids = block.column("word_id").to_numpy()
        words = {m.shape[1]: (ids[at], m) for at, m in kernels.list_rows(block.column("wv").combine_chunks())}
        for rows, x in groups:
            if x.shape[1] not in words:
                continue
            word_ids, matrix = words[x.shape[1]]
            step = max(1, PAIRS // len(matrix))
            for a in range(0, len(rows), step):
                yield rows[a : a + step], word_ids, kernels.BLOCKS[metric](x[a : a + step], matrix)


def _streamed(vectors: DataFrame, names: list[str], types: list[str], found) -> DataFrame:
    """(vec_id, names): ``found`` yields (row numbers, columns) for each stretch of vectors, which stay where they are."""
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in kernels.stretches(batches, STRETCH_BYTES):
            for rows, *columns in found(stretch):
                made = [pa.array(c, arrow[t]) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([stretch.column("vec_id").take(pa.array(rows)), *made], ["vec_id", *names])

    schema = ", ".join([f"vec_id {dict(vectors.dtypes)['vec_id']}", *[f"{n} {t}" for n, t in zip(names, types)]])
    return vectors.select("vec_id", "vec").mapInArrow(run, schema)


def _streamed_distances(vectors: DataFrame, words: DataFrame, metric: str, max_bytes: int) -> DataFrame:
    blocks = _word_blocks(words, max_bytes)

    def found(stretch: pa.RecordBatch):
        for rows, ids, dist in _met(stretch, blocks, metric):
            yield np.repeat(rows, len(ids)), np.tile(ids, len(rows)), dist.ravel()

    return _streamed(vectors, ["word_id", "dist"], [dict(words.dtypes)["word_id"], "double"], found)


def _streamed_soft(vectors: DataFrame, words: DataFrame, metric: str, threshold: float, max_bytes: int) -> DataFrame:
    """Two passes over the blocks for each stretch: least and greatest distance of each vector, then its near words."""
    blocks = _word_blocks(words, max_bytes)

    def found(stretch: pa.RecordBatch):
        low, high = np.full(stretch.num_rows, np.inf), np.full(stretch.num_rows, -np.inf)
        for rows, _, dist in _met(stretch, blocks, metric):
            low[rows] = np.minimum(low[rows], dist.min(axis=1))
            high[rows] = np.maximum(high[rows], dist.max(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            for rows, ids, dist in _met(stretch, blocks, metric):
                weight = (dist - low[rows, None]) / (high - low)[rows, None]
                r, c = np.nonzero(weight < threshold)
                yield rows[r], ids[c], weight[r, c]

    return _streamed(vectors, ["word_id", "weight"], [dict(words.dtypes)["word_id"], "double"], found)


def _streamed_knn(vectors: DataFrame, base: DataFrame, k: int, metric: str, max_bytes: int) -> DataFrame:
    """The k best of each vector are kept while the blocks go past; ties keep the lowest word."""
    blocks = _word_blocks(base, max_bytes)

    def found(stretch: pa.RecordBatch):
        best = BestOf(stretch.num_rows, k)
        for rows, ids, dist in _met(stretch, blocks, metric):
            best.add_rows(rows, dist, ids)
        rows, dist, ids, rank = best.ranked()
        yield rows, rank, ids, dist

    types = ["int", dict(base.dtypes)["word_id"], "double"]
    return _streamed(vectors, ["rank", "word_id", "dist"], types, found)


def _joined_distances(vectors: DataFrame, words: DataFrame, metric) -> DataFrame:
    """For a metric given as a column function: equi join of vectors with blocks of words.

    A block holds about BLOCK_WORDS words. Blocks and vectors meet on (block, salt), so the
    vectors of one block spread over many tasks.
    """
    salts = salts_of(vectors.sparkSession)
    n_blocks = max(1, -(-words.count() // BLOCK_WORDS))
    packed = (
        words.where(F.size("wv") > 0)
        .groupBy(hash_bucket(n_blocks, F.col("word_id")).alias("block"))
        .agg(F.collect_list(F.struct("word_id", "wv")).alias("ws"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    spread = vectors.select(
        "vec_id",
        "vec",
        hash_bucket(salts, F.col("vec_id")).alias("salt"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
    )
    met = spread.join(packed, ["block", "salt"])
    pairs = F.transform(
        F.filter("ws", lambda w: F.size(w["wv"]) == F.size(F.col("vec"))),
        lambda w: F.struct(w["word_id"].alias("word_id"), metric(F.col("vec"), w["wv"]).alias("dist")),
    )
    return met.select("vec_id", F.inline(pairs))


def word_distances(
    vectors: DataFrame, words: DataFrame, metric="chi2", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """(vec_id, word_id, dist) for every word of the vector's length.

    ``metric`` is "chi2", "l2sq" or any ``(Column, Column) -> Column``. Named metrics on a
    dictionary within ``max_bytes`` run as a narrow Arrow projection; a larger one is read in blocks
    past vectors that stay where they are. A column function joins words and vectors.
    """
    if isinstance(metric, str):
        rows = fetch(words, "wv", max_bytes)
        if rows is not None:
            distances = _distance_udf(Dictionary.of(rows), metric, dict(words.dtypes)["word_id"])
            return vectors.select("vec_id", F.inline(distances("vec")))
        return _streamed_distances(vectors, words, metric, max_bytes)
    return _joined_distances(vectors, words, metric)


def scaled_distances(distances: DataFrame) -> DataFrame:
    """Min-max scale the distances of each vector; at most one row per word is in a window."""
    w = Window.partitionBy("vec_id")
    return distances.select(
        "vec_id",
        "word_id",
        minmax(F.col("dist"), F.min("dist").over(w), F.max("dist").over(w)).alias("weight"),
    )


def soft_assign(
    vectors: DataFrame,
    words: DataFrame,
    threshold: float = THRESHOLD,
    metric="chi2",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """(vec_id, word_id, weight) with scaled distance strictly below the threshold.

    A vector equally far from all words has no scaled distance and gets no word.
    """
    if isinstance(metric, str):
        rows = fetch(words, "wv", max_bytes)
        if rows is not None:
            soft_words = _soft_udf(Dictionary.of(rows), metric, threshold, dict(words.dtypes)["word_id"])
            return vectors.select("vec_id", F.inline(soft_words("vec")))
        return _streamed_soft(vectors, words, metric, threshold, max_bytes)
    scaled = scaled_distances(word_distances(vectors, words, metric, max_bytes))
    return scaled.where(F.col("weight") < threshold)


def knn(
    vectors: DataFrame, base: DataFrame, k: int, metric="l2sq", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """(vec_id, rank, word_id, dist): the k nearest words of each vector, ties by word id.

    A dictionary within ``max_bytes`` gives a narrow projection that keeps k words per row, a larger
    one is read in blocks while each vector keeps its k best.
    """
    rows = fetch(base, "wv", max_bytes) if isinstance(metric, str) else None
    if rows is not None:
        distances = _distance_udf(Dictionary.of(rows), metric, dict(base.dtypes)["word_id"])
        by_distance = F.transform(distances("vec"), lambda d: F.struct(d["dist"], d["word_id"]))
        near = vectors.select("vec_id", F.posexplode(F.slice(F.array_sort(by_distance), 1, k)).alias("p", "d"))
        return near.select("vec_id", (F.col("p") + 1).alias("rank"), "d.word_id", "d.dist")
    if isinstance(metric, str):
        return _streamed_knn(vectors, base, k, metric, max_bytes)
    order = Window.partitionBy("vec_id").orderBy("dist", "word_id")
    found = word_distances(vectors, base, metric, max_bytes)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("vec_id", "rank", "word_id", "dist")
