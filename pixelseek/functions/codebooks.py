"""Codebook-sized tables on the driver, behind a size check.

Words, centres, weights and matrices whose size depends on parameters, not on the number of
images, are shipped to tasks in one piece. ``fetch`` stops at a size limit and returns ``None``
beyond it; callers then take a join-based way.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

PIN_BYTES = 8 << 20
MAX_BYTES = 64 << 20
ROW_BYTES = 16
PROBE_ROWS = 1000


def measured_bytes(df: DataFrame, array_col: str) -> tuple[int, int]:
    """(rows, approximate bytes) of a table of vectors, from one small aggregation."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.size(array_col).cast("bigint")), F.lit(0)).alias("cells"),
    ).first()
    return row["n"], 8 * row["cells"] + ROW_BYTES * row["n"]


def fetch(
    df: DataFrame, array_col: str, max_bytes: int | None = MAX_BYTES, row_bytes: int = ROW_BYTES
) -> list[Row] | None:
    """All rows, or ``None`` once they pass ``max_bytes``; without a limit, all of a table whose size is a parameter.

    Up to PROBE_ROWS rows take one job. A longer table is read partition by partition, and
    reading stops at the limit. Rows are Python numbers, about four times the counted bytes.
    """
    found = df.collect() if df.isLocal() else df.limit(PROBE_ROWS + 1).collect()
    if not df.isLocal() and len(found) > PROBE_ROWS:
        found = df.toLocalIterator()
    rows, size = [], 0
    for row in found:
        size += 8 * len(row[array_col] or ()) + row_bytes
        if max_bytes is not None and size > max_bytes:
            return None
        rows.append(row)
    return rows


def fetch_rows(df: DataFrame, max_rows: int) -> list[Row] | None:
    """At most ``max_rows`` rows, or ``None`` if the table is longer."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small driver-side table; the planner knows its size."""
    return spark.createDataFrame(pa.table(columns))


def pinned(df: DataFrame, array_col: str, max_bytes: int = PIN_BYTES) -> DataFrame:
    """The same small table, computed once instead of by every use.

    Up to ``max_bytes`` it becomes a local table. A larger one stays a distributed table that is
    kept after its first use; what a lost executor held of it is computed again.
    """
    rows = fetch(df, array_col, max_bytes)
    if rows is not None:
        schema = to_arrow_schema(df.schema)
        columns = {f.name: pa.array([r[f.name] for r in rows], f.type) for f in schema}
        return local_table(df.sparkSession, columns)
    return df.persist()


def one_machine(master: str) -> bool:
    """Whether the session runs in one process; executors of ``local-cluster`` have processes of their own."""
    return re.match(r"local(\[|$)", master) is not None


def use_checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which all executors share; unset, a temporary one in a session on one machine.

    Elsewhere an unset folder raises ValueError: executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not one_machine(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or tempfile.mkdtemp(prefix="pixelseek-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the checkpoint folder and read from there: later uses don't compute it again."""
    folder = f"{use_checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate files, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Dictionary:
    """Words grouped by length: length -> (word ids ascending, matrix)."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[Row]) -> Dictionary:
        grouped: dict[int, list[Row]] = {}
        for r in sorted(rows, key=lambda r: r["word_id"]):
            if r["wv"]:
                grouped.setdefault(len(r["wv"]), []).append(r)
        return Dictionary(
            {
                n: (
                    np.array([r["word_id"] for r in rs], dtype=np.int64),
                    np.array([r["wv"] for r in rs], dtype=float),
                )
                for n, rs in grouped.items()
            }
        )


@dataclass(frozen=True)
class Centers:
    """Sub-centres per group: list over gid of (cids ascending, matrix)."""

    groups: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[Row]) -> Centers:
        n_groups = max(r["gid"] for r in rows) + 1
        groups = []
        for g in range(n_groups):
            rs = sorted((r for r in rows if r["gid"] == g), key=lambda r: r["cid"])
            if not rs:
                raise ValueError(f"no centres for group {g}")
            groups.append(
                (
                    np.array([r["cid"] for r in rs], dtype=np.int32),
                    np.array([r["c"] for r in rs], dtype=float),
                )
            )
        return Centers(groups)

    @property
    def dim(self) -> int:
        return sum(m.shape[1] for _, m in self.groups)

    def slices(self) -> list[slice]:
        ends = np.cumsum([m.shape[1] for _, m in self.groups])
        return [slice(int(e) - m.shape[1], int(e)) for e, (_, m) in zip(ends, self.groups)]
