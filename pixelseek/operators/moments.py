"""Coordinate statistics: standardizer, class weights, scatter matrix, whitening."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelseek.functions import kernels
from pixelseek.functions.vector import l2_normalize

# Fixed value: virtual data added to the scatter matrix.
WHITEN_EPS = 1e-4
# A task holds one d x d matrix and the driver decomposes one; d is a parameter, not data size.
BLOCK_DIM = 4096


def fit_standardizer(
    df: DataFrame, mean: float = 0.0, maxdev: float = 1.0, norm: float | None = None, vec: str = "vec"
) -> DataFrame:
    """(i, shift, scale) per coordinate: shift = mean - average, scale = maxdev / max(stdev, maxdev).

    The deviation is of the population. With ``norm`` rows are first scaled to that norm. Apply
    with ``affine``.
    """
    source = F.col(vec) if norm is None else l2_normalize(F.col(vec), norm)
    cells = df.select(F.posexplode(source).alias("p", "x"))
    stats = cells.groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return stats.select(
        (F.col("p") + 1).cast("int").alias("i"),
        (F.lit(float(mean)) - F.col("m")).alias("shift"),
        (F.lit(float(maxdev)) / F.greatest("s", F.lit(float(maxdev)))).alias("scale"),
    )


def class_weights(labels: DataFrame) -> DataFrame:
    """(label, weight) = 1 / (share of the class x number of classes).

    The window has no partition but holds one row per class.
    """
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    share = F.col("n") / F.sum("n").over(everything)
    return counts.select("label", (1 / (share * F.count(F.lit(1)).over(everything))).alias("weight"))


def _scatter(df: DataFrame, dim: int, vec: str, block: int = BLOCK_DIM) -> DataFrame:
    """(i, j, x) of the scatter matrix, and the number of rows at i = 0.

    Each task multiplies its batches and adds up one matrix of at most ``block`` x ``block``: wider
    vectors are read once for each pair of column blocks on or above the diagonal.
    """
    rows = df.where(F.size(vec) == dim)
    starts = range(0, dim, block)
    parts = [_block_sums(rows, vec, a, min(a + block, dim), b, min(b + block, dim)) for a in starts for b in starts if a <= b]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.unionByName(rows.agg(F.lit(0).alias("i"), F.lit(1).alias("j"), F.count(F.lit(1)).cast("double").alias("x")))


def _block_sums(rows: DataFrame, vec: str, a: int, a_end: int, b: int, b_end: int) -> DataFrame:
    """Cells of the scatter matrix in rows a … a_end and columns b … b_end, and their mirror images."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((a_end - a, b_end - b))
        for batch in batches:
            left = kernels.list_matrix(batch.column(0), a_end - a)
            total += left.T @ (left if a == b else kernels.list_matrix(batch.column(1), b_end - b))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(a + 1, a_end + 1), pa.int32()), kernels.to_list_array(total, pa.float64())],
            names=["i", "line"],
        )

    sides = [F.slice(vec, a + 1, a_end - a).alias("left")]
    if a != b:
        sides.append(F.slice(vec, b + 1, b_end - b).alias("right"))
    lines = rows.select(*sides).mapInArrow(partial, "i int, line array<double>")
    cells = lines.select("i", F.posexplode("line").alias("p", "x"))
    sums = cells.groupBy("i", (F.col("p") + b + 1).cast("int").alias("j")).agg(F.sum("x").alias("x"))
    if a == b:
        return sums
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return sums.select(F.explode(both).alias("c"), "x").select("c.i", "c.j", "x")


def gramian(df: DataFrame, dim: int, vec: str = "vec", block: int = BLOCK_DIM) -> DataFrame:
    """(i, j, x): the scatter matrix of vectors of length ``dim``."""
    return _scatter(df, dim, vec, block).where(F.col("i") > 0)


def whitening_matrix(df: DataFrame, dim: int, eps: float = WHITEN_EPS, vec: str = "vec") -> np.ndarray:
    """Root-inverse of the regularized scatter matrix; the data are not centred.

    The driver decomposes the matrix: it needs about 300 x dim x dim bytes.
    """
    scatter, n = eps * np.eye(dim), eps
    for r in _scatter(df, dim, vec).collect():
        if r["i"] == 0:
            n += r["x"]
        else:
            scatter[r["i"] - 1, r["j"] - 1] += r["x"]
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
    return np.sqrt(n - 1) * (vectors / np.sqrt(np.maximum(values, eps))) @ vectors.T


def whiten(df: DataFrame, dim: int, eps: float = WHITEN_EPS) -> DataFrame:
    """``df`` with ``vec`` replaced by its whitened form."""
    w = whitening_matrix(df, dim, eps)
    return kernels.map_vectors(df.where(F.size("vec") == dim), lambda x: x @ w, dim)
