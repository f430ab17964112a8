"""Shared folder, stored intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseek.functions.codebooks import one_machine


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary folder is set in a session on one machine
    (tests), and ValueError is raised in any other: executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not one_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pixelseek-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/pixelseek/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends here, lost executors don't matter."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def gathered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All batches of a task as one frame: for samples of bounded size."""
    every = list(batches)
    return pd.concat(every, ignore_index=True) if every else pd.DataFrame()


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint where the (stored) table has at most ``max_rows`` rows, else the plain table: an ordinary join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's text modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: an expression written inside a lambda is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
