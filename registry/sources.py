"""Stores and output forms: written under the session's shared folder and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import registry.base  # noqa: F401
import registry.imaging  # noqa: F401
from pixelseek import views
from pixelseek.functions.codebooks import use_checkpoint_folder
from pixelseek.sources import images as im
from pixelseek.sources import tables as tb
from pixelseek.sources import text as tx
from registry import r6, register


def _folder(spark: SparkSession) -> str:
    return os.path.join(use_checkpoint_folder(spark), f"store-{uuid.uuid4().hex}")


def _named(spark: SparkSession, sf: str):
    rows = views.embeddings(spark, sf)
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("d"), "label")


_CELLS = "SELECT vec_id, label, i, round(x, 6) AS x FROM v"


@register(
    "s8_image_catalogue",
    """SELECT 'root/class' || label || '/image' || vec_id || '.png' AS path, 'image' || vec_id || '.png' AS name,
       'class' || label AS class_name, dense_rank() OVER (ORDER BY 'class' || label)::INTEGER AS label FROM embeddings""",
)
def s8(spark, sf):
    """The catalogue of one file name per image, in a folder per class."""
    name = F.concat(F.lit("root/class"), F.col("label"), F.lit("/image"), F.col("vec_id"), F.lit(".png"))
    return im.catalogue(views.embeddings(spark, sf).select(name.alias("path")))


def _cells(df):
    rows = df.select("vec_id", F.col("label").cast("int").alias("label"), F.posexplode("d").alias("p", "x"))
    return rows.select("vec_id", "label", (F.col("p") + 1).cast("int").alias("i"), r6("x").alias("x"))


@register("s9_descriptor_store", _CELLS, "v")
def s9(spark, sf):
    folder = _folder(spark)
    tb.write_descriptors(_named(spark, sf), folder, "label")
    return _cells(tb.read_descriptors(spark, folder))


@register("s10_pooled_feature_store", _CELLS.replace("label", "CASE WHEN label < 5 THEN 1 ELSE 2 END::INTEGER AS label", 1), "v")
def s10(spark, sf):
    """Features of two runs, each in a folder per label, assembled to one table."""
    rows = _named(spark, sf).select(F.col("vec_id").alias("image_id"), "d")
    even = F.col("image_id") % 2 == 0
    folders = [_folder(spark), _folder(spark)]
    for part, folder in zip((rows.where(even), rows.where(~even)), folders):
        tb.write_image_features(part, views.labels(spark, sf), folder)
    return _cells(tb.assemble_features(spark, *folders).withColumnRenamed("image_id", "vec_id"))


@register("s12_output_by_key", "SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY label")
def s12(spark, sf):
    folder = _folder(spark)
    tb.write_by_key(views.embeddings(spark, sf).select("vec_id", "label"), "label", folder)
    back = spark.read.parquet(folder).groupBy(F.col("label").cast("int").alias("label"))
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


@register("s13_single_file", "SELECT vec_id, label, 1::BIGINT AS files FROM embeddings")
def s13(spark, sf):
    folder = _folder(spark)
    tb.write_single(views.embeddings(spark, sf).select("vec_id", "label"), folder)
    back = spark.read.parquet(folder)
    files = back.select(F.input_file_name().alias("f")).agg(F.count_distinct("f").alias("n"))
    return back.select("vec_id", "label", files.scalar().alias("files"))


@register("s14_replaced_output", "SELECT vec_id || ' ' || label AS value FROM embeddings")
def s14(spark, sf):
    folder = _folder(spark)
    lines = views.embeddings(spark, sf).select(F.concat_ws(" ", "vec_id", "label").alias("value"))
    tx.write_lines(lines.select(F.upper("value").alias("value")), folder)
    tx.write_lines(lines, folder)
    return spark.read.text(folder)
