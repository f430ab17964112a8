"""Tables of vectors too large to ship: written once in blocks to the shared folder, read by tasks block by block.

No row passes the driver; it knows the files' names only. A task holds one block at a time beside its own rows, so
neither side is copied per block or shuffled again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseek.functions.codebooks import measured_bytes, use_checkpoint_folder

BLOCK = "_block"


@dataclass(frozen=True)
class Blocks:
    """Files of each block, in block order; every block has the columns of the table."""

    files: list[list[str]]
    columns: list[str]

    def __iter__(self) -> Iterator[pa.Table]:
        for files in self.files:
            yield pa.concat_tables([self._read(f) for f in files])

    def _read(self, uri: str) -> pa.Table:
        system, name = fs.FileSystem.from_uri(uri)
        with system.open_input_file(name) as f:
            return pq.ParquetFile(f).read(columns=self.columns)


def write_blocks(df: DataFrame, key: str, array_col: str, block_bytes: int, row_bytes: int = 0) -> Blocks:
    """Rows spread over blocks by a hash of ``key``, about ``block_bytes`` of arrays and ``row_bytes`` a row each.

    Rows without an array are left out. The files stay under the session's checkpoint folder: tasks that are repeated
    after the loss of an executor read them again.
    """
    spark, columns = df.sparkSession, df.columns
    n, size = measured_bytes(df, array_col)
    n_blocks = max(1, -(-(size + row_bytes * n) // max(1, block_bytes)))
    n_blocks = max(1, min(n_blocks, n))
    folder = f"{use_checkpoint_folder(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    spread = df.where(F.col(array_col).isNotNull()).withColumn(BLOCK, F.pmod(F.xxhash64(key), F.lit(n_blocks)))
    spread.repartition(n_blocks, BLOCK).write.partitionBy(BLOCK).parquet(folder)
    by_block: dict[str, list[str]] = {}
    for f in spark.read.schema(df.schema).parquet(folder).inputFiles():
        by_block.setdefault(f.split(f"/{BLOCK}=")[1].split("/")[0], []).append(f)
    return Blocks([sorted(by_block[b]) for b in sorted(by_block, key=int)], columns)
