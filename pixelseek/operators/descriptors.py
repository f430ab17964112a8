"""Local descriptors: dictionary, locality-constrained codes, spatial pyramid, dense grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseek.functions import kernels
from pixelseek.functions.codebooks import MAX_BYTES, Dictionary, fetch, local_table
from pixelseek.functions.vector import sift_normalize, sqnorm
from pixelseek.operators.words import knn as knn_words
from pixelseek.plans.quantized import MAX_ITER, TOLERANCE, fit_pq

# Neighbours and regularization of the codes, pyramid, and descriptor geometry.
KNN, BETA = 5, 1e-4
PYRAMID = (1, 2, 4)
ANGLES, CELLS, ALPHA = 8, 4, 9
GRID_STEP, PATCH, SIGMA = 6, 16, 0.8
POSITION = ("x", "y", "width", "height")


def learn_dictionary(
    descriptors: DataFrame,
    method: str = "kmeans",
    size: int = 512,
    seed: int = 0,
    max_iter: int = MAX_ITER,
    tol: float | None = TOLERANCE,
) -> DataFrame:
    """(word_id, wv): k-means centres of the descriptors, or with "none" the descriptors themselves.

    "kmeans" starts from Spark's seeded choice of centres, "lloyd" from a hashed first assignment of (image_id, desc_id)
    that any SQL engine can repeat; ``max_iter`` passes at most, ``tol=None`` all of them, both for "lloyd" only.
    """
    if method == "lloyd":
        name = F.concat_ws(":", F.col("image_id").cast("string"), F.col("desc_id").cast("string"))
        rows = descriptors.select(name.alias("vec_id"), F.col("d").alias("vec"))
        return fit_pq(rows, 1, size, max_iter, tol, seed).select(F.col("cid").alias("word_id"), F.col("c").alias("wv"))
    if method == "none":
        return descriptors.select(F.monotonically_increasing_id().alias("word_id"), F.col("d").alias("wv"))
    if method != "kmeans":
        raise ValueError(f"unknown dictionary method {method!r}")
    rows = descriptors.select(array_to_vector("d").alias("features"))
    model = KMeans(k=size, seed=seed, featuresCol="features").fit(rows)
    centers = [np.asarray(c, dtype=float) for c in model.clusterCenters()]
    return local_table(
        descriptors.sparkSession,
        {
            "word_id": pa.array(np.arange(len(centers)), pa.int32()),
            "wv": pa.array(centers, pa.list_(pa.float64())),
        },
    )


def local_weights(x: np.ndarray, near: np.ndarray, beta: float) -> np.ndarray:
    """Weights of the nearest words (n x k x d) that rebuild each descriptor, adding up to one.

    Where all words equal the descriptor the system is empty and the words share equally.
    """
    z = near - x[:, None, :]
    c = z @ z.transpose(0, 2, 1)
    k = near.shape[1]
    trace = np.trace(c, axis1=1, axis2=2)
    c = c + np.eye(k) * np.where(trace > 0, beta * trace, 1.0)[:, None, None]
    w = np.linalg.solve(c, np.ones((len(x), k, 1)))[:, :, 0]
    return w / w.sum(axis=1, keepdims=True)


def _code_udf(book: Dictionary, knn: int, beta: float):
    ((ids, matrix),) = book.by_length.values()
    knn = min(knn, len(ids))

    @F.arrow_udf("array<struct<slot:int,word_id:bigint,w:double>>")
    def code(d: pa.Array) -> pa.Array:
        x = kernels.list_matrix(d, matrix.shape[1])
        at = np.argsort(kernels.l2_block(x, matrix), axis=1, kind="stable")[:, :knn]
        w = local_weights(x, matrix[at], beta)
        return kernels.ragged_struct(
            np.full(len(x), knn),
            slot=pa.array(np.tile(np.arange(knn), len(x)), pa.int32()),
            word_id=pa.array(ids[at].ravel(), pa.int64()),
            w=pa.array(w.ravel(), pa.float64()),
        )

    return code


def _weights_udf(beta: float):
    @F.arrow_udf("array<double>")
    def weights(d: pa.Array, near: pa.Array) -> pa.Array:
        n = len(d)
        x = d.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        words = near.flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, -1, x.shape[1])
        return kernels.to_list_array(local_weights(x, words, beta), pa.float64())

    return weights


def llc_code(
    descriptors: DataFrame,
    words: DataFrame,
    knn: int = KNN,
    beta: float = BETA,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """(image_id, desc_id, slot, word_id, w): the non-zero weights per descriptor, nearest word first.

    Positions (x, y, width, height) are carried along where the table has them. Descriptors of
    another length than the words, or NULL, are left out. A dictionary within ``max_bytes`` gives
    a narrow projection. A larger one is searched in blocks, and only the k chosen words are
    joined back.
    """
    id_type = dict(words.dtypes)["word_id"]
    keys = ["image_id", "desc_id", *[c for c in POSITION if c in descriptors.columns]]
    # One rule for both ways: words of one length, and only descriptors of that length are coded.
    sizes = words.where(F.size("wv") > 0).agg(F.min(F.size("wv")), F.max(F.size("wv"))).first()
    if sizes[0] is None or sizes[0] != sizes[1]:
        raise ValueError("the dictionary needs words, all of one length")
    descriptors = descriptors.where(F.size("d") == sizes[0])
    words = words.where(F.size("wv") > 0)
    rows = fetch(words, "wv", max_bytes)
    if rows is not None:
        code = _code_udf(Dictionary.of(rows), knn, beta)
        coded = descriptors.select(*keys, F.inline(code("d")))
        return coded.withColumn("word_id", F.col("word_id").cast(id_type))
    keyed = descriptors.select(F.struct(*keys).alias("vec_id"), F.col("d").alias("vec"))
    near = knn_words(keyed, words, knn, "l2sq", max_bytes).join(words, "word_id")
    lists = near.groupBy("vec_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word_id", "wv"))).alias("near")
    )
    solved = keyed.join(lists, "vec_id").select(
        "vec_id",
        F.transform("near", lambda n: n["word_id"]).alias("ids"),
        _weights_udf(beta)("vec", F.transform("near", lambda n: n["wv"])).alias("ws"),
    )
    pairs = solved.select("vec_id", F.posexplode(F.arrays_zip("ids", "ws")).alias("slot", "p"))
    return pairs.select("vec_id.*", "slot", F.col("p.ids").alias("word_id"), F.col("p.ws").alias("w"))


def pyramid_bins(pyramid: tuple[int, ...] = PYRAMID) -> Column:
    """Array of the bin of a descriptor at (x, y) on every level; bins count from 1 across levels."""
    bins, offset = [], 0
    for p in pyramid:
        col = F.ceil(F.col("x") / (F.col("width") / p))
        row = F.ceil(F.col("y") / (F.col("height") / p))
        bins.append((F.lit(offset) + (row - 1) * p + col).cast("int"))
        offset += p * p
    return F.array(*bins)


def place(codes: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Codes with the positions of their descriptors, for tables that were stored apart."""
    return codes.join(descriptors.select("image_id", "desc_id", *POSITION), ["image_id", "desc_id"])


def spm_pool(codes: DataFrame, pyramid: tuple[int, ...] = PYRAMID) -> DataFrame:
    """(image_id, bin, word_id, v): per bin the largest weight of each word, scaled to unit norm per image.

    ``codes`` carry positions. They are sparse but the maximum is over all descriptors of a bin,
    so a word that only some of them use cannot fall below zero. Zeros are not stored. Codes are
    merged inside tasks; what is left of an image, at most bins x words rows, is brought
    together once for both windows.
    """
    used = codes.select(
        "image_id", F.explode(pyramid_bins(pyramid)).alias("bin"), "word_id", "w", (F.col("slot") == 0).alias("first")
    )
    best = used.groupBy("image_id", "bin", "word_id").agg(
        F.max("w").alias("top"), F.count(F.lit(1)).alias("users"), F.count_if("first").alias("firsts")
    )
    members = F.sum("firsts").over(Window.partitionBy("image_id", "bin"))
    value = F.when(F.col("users") == members, F.col("top")).otherwise(F.greatest("top", F.lit(0.0)))
    pooled = best.repartition("image_id").select("image_id", "bin", "word_id", value.alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("image_id")))
    return pooled.where(F.col("v") != 0).select("image_id", "bin", "word_id", (F.col("v") / norm).alias("v"))


def length_histogram(df: DataFrame, bins: int = 100, vec: str = "d") -> DataFrame:
    """(bin, n): vector norms counted in equal bins between the least and the greatest norm."""
    norms = df.select(F.sqrt(sqnorm(F.col(vec))).alias("len"))
    ends = norms.agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
    lo, span = ends.select("lo").scalar(), ends.select(F.col("hi") - F.col("lo")).scalar()
    place = F.coalesce(F.try_divide(F.col("len") - lo, span), F.lit(0.0))
    number = F.least(F.floor(place * bins) + 1, F.lit(bins)).cast("int")
    return norms.select(number.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def gradient_filters(sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Horizontal and vertical derivative of a Gaussian, each scaled to absolute sum 2."""
    half = 2 * int(np.ceil(sigma))
    axis = np.arange(-half, half + 1)
    g = np.exp(-(axis[:, None] ** 2 + axis[None, :] ** 2) / (2 * sigma**2))
    g[g < np.finfo(float).eps * g.max()] = 0
    gy, gx = np.gradient(g / g.sum())
    return gx * 2 / np.abs(gx).sum(), gy * 2 / np.abs(gy).sum()


def _correlate(image: np.ndarray, filt: np.ndarray) -> np.ndarray:
    half = filt.shape[0] // 2
    padded = np.pad(image, half)
    windows = np.lib.stride_tricks.sliding_window_view(padded, filt.shape)
    return np.einsum("ijuv,uv->ij", windows, filt)


def _cell_weights(patch: int) -> np.ndarray:
    """Bilinear share of each patch coordinate in each of the cells along one axis: cells x patch."""
    width = patch / CELLS
    centres = width * (np.arange(CELLS) + 0.5) - 0.5
    away = np.abs(np.arange(patch)[None, :] - centres[:, None]) / width
    return np.where(away <= 1, 1 - away, 0)


def _grid(size: int, step: int, patch: int) -> np.ndarray:
    """0-based patch corners along one axis, centred in the image."""
    return np.arange(((size - patch) % step) // 2, size - patch + 1, step)


def _describe(image: np.ndarray, step: int, patch: int, filters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gx, gy = (_correlate(image, f) for f in filters)
    theta, strength = np.arctan2(gy, gx), np.hypot(gx, gy)
    angles = 2 * np.pi / ANGLES * np.arange(ANGLES)
    tuned = np.cos(theta[None] - angles[:, None, None]) ** ALPHA
    layers = np.maximum(tuned, 0) * strength
    share = _cell_weights(patch)
    ys, xs = _grid(image.shape[0], step, patch), _grid(image.shape[1], step, patch)
    corner_x, corner_y = np.meshgrid(xs, ys)
    corner_x, corner_y = corner_x.T.ravel(), corner_y.T.ravel()
    patches = np.stack([layers[:, y : y + patch, x : x + patch] for x, y in zip(corner_x, corner_y)])
    cells = np.einsum("nayx,vy,ux->nuva", patches, share, share)
    return corner_x, corner_y, cells.reshape(len(cells), -1)


def dense_descriptors(
    images: DataFrame,
    step: int = GRID_STEP,
    patch: int = PATCH,
    sigma: float = SIGMA,
    threshold: float = 1.0,
) -> DataFrame:
    """Gradient-orientation descriptors on a regular grid of patches.

    ``images`` has image_id, width, height and px, the row-major grey values in [0, 1]. Returns
    (image_id, desc_id, x, y, width, height, length, d) with ``length`` the norm before
    normalization. An image smaller than a patch gives no rows. Patches are numbered down the
    columns of the grid; a descriptor lists cells column by column with the angles innermost.
    """
    filters = gradient_filters(sigma)
    id_type = dict(images.dtypes)["image_id"]
    out_type = f"image_id {id_type}, desc_id int, x double, y double, width int, height int, d array<double>"
    id_arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[id_type]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, numbers, places, values = [], [], [], [], []
            for name, w, h, px in zip(*[c.to_numpy(zero_copy_only=False) for c in batch.columns]):
                if min(w, h) < patch:
                    continue
                cx, cy, d = _describe(np.asarray(px, dtype=float).reshape(h, w), step, patch, filters)
                names += [name] * len(d)
                sizes += [(w, h)] * len(d)
                numbers.append(np.arange(len(d)))
                places.append(np.stack([cx, cy], axis=1) + 1 + patch / 2 - 0.5)
                values.append(d)
            if not names:
                continue
            size, place = np.array(sizes), np.concatenate(places)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, id_arrow),
                    pa.array(np.concatenate(numbers), pa.int32()),
                    pa.array(place[:, 0], pa.float64()),
                    pa.array(place[:, 1], pa.float64()),
                    pa.array(size[:, 0], pa.int32()),
                    pa.array(size[:, 1], pa.int32()),
                    kernels.to_list_array(np.concatenate(values), pa.float64()),
                ],
                names=["image_id", "desc_id", "x", "y", "width", "height", "d"],
            )

    source = images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), "px")
    raw = source.mapInArrow(extract, out_type)
    return raw.select(
        "image_id",
        "desc_id",
        "x",
        "y",
        "width",
        "height",
        F.sqrt(sqnorm(F.col("d"))).alias("length"),
        sift_normalize(F.col("d"), threshold).alias("d"),
    )
