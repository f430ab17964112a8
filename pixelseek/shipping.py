"""The package on the workers' path, from whatever folder the session was started."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))

Query = Callable[[SparkSession, str], DataFrame]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, present and future, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="pixelseek-package-")
    copy = os.path.join(folder, "source", "pixelseek")
    shutil.copytree(PACKAGE, copy, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "pixelseek"), "zip", os.path.dirname(copy)))
    _shipped.add(app)


def shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
