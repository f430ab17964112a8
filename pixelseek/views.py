"""Views of the driver's ``embeddings`` table that feed every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseek.functions.codebooks import pinned
from pixelseek.functions.vector import l2sq
from pixelseek.operators.relational import join_side, mean_vectors

SIDE = 8
PARTS, PART_DIM, GRID = 16, 4, 4


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, vec) in double precision."""
    return embeddings(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 + value: strictly positive, as histogram distances expect."""
    return vectors(spark, sf_dir).select("vec_id", F.transform("vec", lambda v: v + 1).alias("vec"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classes: 1 for labels 0-4, else 2."""
    return embeddings(spark, sf_dir).select(
        "vec_id", F.when(F.col("label") < 5, 1).otherwise(2).alias("label")
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", "label")


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, vec): mean histogram of every class, over the whole table and computed once."""
    shifted = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + 1)
    rows = embeddings(spark, sf_dir).select("label", shifted.alias("vec"))
    return pinned(mean_vectors(rows, "label", out="vec"), "vec")


def words(spark: SparkSession, sf_dir: str, means: DataFrame | None = None) -> DataFrame:
    """Dictionary: one visual word per class."""
    return (means or prototypes(spark, sf_dir)).select(
        F.col("label").cast("int").alias("word_id"), F.col("vec").alias("wv")
    )


def class_queries(spark: SparkSession, sf_dir: str, means: DataFrame | None = None) -> DataFrame:
    """(query_id, vec, query_label): the class prototypes as queries, with the two-class label."""
    return (means or prototypes(spark, sf_dir)).select(
        F.col("label").cast("bigint").alias("query_id"),
        "vec",
        F.when(F.col("label") < 5, 1).otherwise(2).alias("query_label"),
    )


def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, vec): mean vector of every class as a query."""
    rows = embeddings(spark, sf_dir).select("label", F.col("embedding").cast("array<double>").alias("vec"))
    means = pinned(mean_vectors(rows, "label", out="vec"), "vec")
    return means.select(F.col("label").cast("bigint").alias("query_id"), "vec")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id): the image nearest to its class mean, for every class."""
    means = class_means(spark, sf_dir).select(
        F.col("query_id").cast("int").alias("label"), F.col("vec").alias("mean")
    )
    rows = embeddings(spark, sf_dir).select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
    )
    scored = join_side(rows, means, "label", array_col="mean").select(
        "label", F.struct(l2sq(F.col("vec"), F.col("mean")).alias("d"), "vec_id").alias("s")
    )
    return scored.groupBy("label").agg(F.min("s").alias("s")).select("s.vec_id")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(
        "vec_id", F.format_string("/images/%s.png", "vec_id").alias("path")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 one-channel image: (image_id, width, height, ch, x, y, v), x and y from 1."""
    grey = F.floor(F.least(F.greatest(F.col("e") * 256 + 128, F.lit(0.0)), F.lit(255.0))).cast("int")
    cells = vectors(spark, sf_dir).select("vec_id", F.posexplode("vec").alias("pos", "e"))
    return cells.select(
        F.col("vec_id").alias("image_id"),
        F.lit(SIDE).alias("width"),
        F.lit(SIDE).alias("height"),
        (F.floor(F.col("pos") / (SIDE * SIDE)) + 1).cast("int").alias("ch"),
        (F.col("pos") % SIDE + 1).cast("int").alias("x"),
        (F.floor(F.col("pos") / SIDE) + 1).cast("int").alias("y"),
        grey.alias("v"),
    )


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 16 descriptors of 4 values on a 4 x 4 grid."""
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.slice("vec", i * PART_DIM + 1, PART_DIM)
    )
    rows = vectors(spark, sf_dir).select(
        F.col("vec_id").alias("image_id"), F.posexplode(parts).alias("desc_id", "d")
    )
    return rows.select(
        "image_id",
        "desc_id",
        (F.col("desc_id") % GRID + 0.5).cast("double").alias("x"),
        (F.floor(F.col("desc_id") / GRID) + 0.5).cast("double").alias("y"),
        F.lit(GRID).alias("width"),
        F.lit(GRID).alias("height"),
        "d",
    )


def descriptor_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary of descriptors: mean of all descriptors with the same sign pattern."""
    signs = F.aggregate(
        "d", F.lit(0), lambda s, x: s * 2 + F.when(x >= 0, 1).otherwise(0)
    )
    rows = descriptors(spark, sf_dir).select(signs.alias("word_id"), "d")
    return pinned(mean_vectors(rows, "word_id", vec="d", out="wv"), "wv")
