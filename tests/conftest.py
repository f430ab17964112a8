from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
        .appName("pixelseek-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def checkpoint_dir(spark, tmp_path_factory):
    """The session's shared folder where it names one, else a folder of the test run."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = str(tmp_path_factory.mktemp("checkpoint"))
        spark.sparkContext.setCheckpointDir(folder)
    return folder
