"""Parquet tables: descriptors, pooled features, results by key, single-file output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_descriptors(descriptors: DataFrame, path: str, class_col: str = "class_name") -> None:
    descriptors.write.mode("overwrite").partitionBy(class_col).parquet(path)


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_image_features(features: DataFrame, labels: DataFrame, path: str) -> None:
    """Pooled features with the label of their image, in one folder per label."""
    named = features.join(labels.select(F.col("vec_id").alias("image_id"), "label"), "image_id")
    named.write.mode("overwrite").partitionBy("label").parquet(path)


def assemble_features(spark: SparkSession, *paths: str) -> DataFrame:
    """One feature table from the outputs of several classes or runs."""
    tables = [spark.read.parquet(p) for p in paths]
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """One folder per key. Rows are brought together by key and adaptive execution splits hot keys."""
    df.hint("rebalance", F.col(key)).write.mode("overwrite").partitionBy(key).parquet(path)


def write_single(df: DataFrame, path: str) -> None:
    """Parquet in one file, written by one task: for codebooks and metric tables."""
    df.repartition(1).write.mode("overwrite").parquet(path)
