"""Catalogue of image files: one sub-folder per class, or a flat folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Paths only; the content column is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", glob).load(path).select("path")


def _part(at: int) -> Column:
    return F.element_at(F.split("path", "/"), at)


def list_images(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """(path, name, class_name, label) of the image files under ``path``."""
    return catalogue(_files(spark, path, f"*.{ext}"))


def catalogue(files: DataFrame) -> DataFrame:
    """(path, name, class_name, label): label is the 1-based place of the class among all class names.

    ``files`` has paths that end in class folder and file name. Only the class names are numbered,
    one row per folder; images take the number by a join.
    """
    rows = files.select("path", _part(-1).alias("name"), _part(-2).alias("class_name"))
    names = rows.select("class_name").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("class_name")
    return rows.join(names.withColumn("label", F.row_number().over(order)), "class_name").select(
        "path", "name", "class_name", "label"
    )


def list_files(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """(path, name, extension) of the files directly in ``path`` with one of the extensions, in any case."""
    found = (
        spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))
    )
    wanted = [e.lower().lstrip(".") for e in extensions]
    rows = found.select(
        "path",
        F.regexp_replace("file", r"\.[^.]*$", "").alias("name"),
        F.regexp_extract("file", r"\.([^.]*)$", 1).alias("extension"),
    )
    return rows.where(F.lower("extension").isin(wanted))
