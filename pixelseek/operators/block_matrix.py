"""Square matrices as tables of blocks, for dimensions whose matrices no single process should hold.

A matrix is (bi, bj, cells): block row, block column, the block's cells row by row. The last block row and column may be
smaller. Products are joins on the inner block number; partial products are added up as they arrive in the task that owns
the result's block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseek.functions import kernels
from pixelseek.functions.blocks import write_blocks
from pixelseek.functions.codebooks import delete_folder, use_checkpoint_folder

BLOCK = "bi int, bj int, cells array<double>"
MAX_STEPS, TOLERANCE = 100, 1e-11


def _batch(bi: list[int], bj: list[int], blocks: list[np.ndarray]) -> pa.RecordBatch:
    cells = pa.array([b.ravel() for b in blocks], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(bi, pa.int32()), pa.array(bj, pa.int32()), cells], ["bi", "bj", "cells"])


class Blocked:
    """Operations on matrices of one dimension and block size."""

    def __init__(self, dim: int, block: int) -> None:
        self.dim, self.block, self.count = dim, block, -(-dim // block)

    def height(self, b: int) -> int:
        return min(self.block, self.dim - b * self.block)

    def _each(self, df: DataFrame, names: list[str], make: Callable[..., np.ndarray]) -> DataFrame:
        """(bi, bj, cells) of ``make(bi, bj, *blocks)`` for rows (bi, bj, names), one block at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for row, (bi, bj) in enumerate(numbers):
                    held = [batch.column(2 + c)[row].values.to_numpy() for c in range(len(names))]
                    yield _batch([bi], [bj], [make(bi, bj, *held)])

        return df.select("bi", "bj", *names).mapInArrow(run, BLOCK)

    def added(self, parts: DataFrame) -> DataFrame:
        """Blocks of equal place added up, one after the other."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for row, place in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    cells = batch.column(2)[row].values.to_numpy()
                    total[place] = total[place] + cells if place in total else np.array(cells)
            for (bi, bj), cells in total.items():
                yield _batch([bi], [bj], [cells])

        return parts.repartition("bi", "bj").mapInArrow(run, BLOCK)

    def multiply(self, a: DataFrame, b: DataFrame) -> DataFrame:
        left = a.select("bi", F.col("bj").alias("k"), F.col("cells").alias("l"))
        right = b.select(F.col("bi").alias("k"), "bj", F.col("cells").alias("r"))

        def product(bi: int, bj: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return x.reshape(self.height(bi), -1) @ y.reshape(-1, self.height(bj))

        return self.added(self._each(left.join(right, "k"), ["l", "r"], product))

    def combined(self, a: DataFrame, scale: float, diagonal: float) -> DataFrame:
        """scale * a + diagonal * I."""

        def cell(bi: int, bj: int, x: np.ndarray) -> np.ndarray:
            out = scale * x.reshape(self.height(bi), self.height(bj))
            return out + diagonal * np.eye(*out.shape) if bi == bj else out

        return self._each(a, ["cells"], cell)

    def norm(self, a: DataFrame, diagonal: float = 0.0) -> float:
        """Frobenius norm of a + diagonal * I."""
        off = self.combined(a, 1.0, diagonal) if diagonal else a
        squares = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x * x)
        return float(off.agg(F.sum(squares)).first()[0]) ** 0.5

    def scatter(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """Sums of x'x over vectors of this dimension; one scan for each pair of blocks on or above the diagonal."""
        rows = df.where(F.size(vec) == self.dim)
        pairs = [(i, j) for i in range(self.count) for j in range(i, self.count)]
        parts = [self._scatter_part(rows, vec, i, j) for i, j in pairs]
        upper = parts[0]
        for p in parts[1:]:
            upper = upper.unionByName(p)
        upper = self.added(upper)
        mirrored = self._each(
            upper.where("bi < bj"), ["cells"], lambda bi, bj, x: x.reshape(self.height(bi), self.height(bj)).T
        )
        return upper.unionByName(mirrored.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), "cells"))

    def _scatter_part(self, rows: DataFrame, vec: str, i: int, j: int) -> DataFrame:
        h, w = self.height(i), self.height(j)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros((h, w)), False
            for batch in batches:
                total += kernels.list_matrix(batch.column(0), h).T @ kernels.list_matrix(batch.column(1), w)
                seen = True
            if seen:
                yield _batch([i], [j], [total])

        sides = [F.slice(vec, b * self.block + 1, n).alias(s) for b, n, s in ((i, h, "left"), (j, w, "right"))]
        return rows.select(*sides).mapInArrow(run, BLOCK)

    def inverse_root(self, a: DataFrame, tol: float = TOLERANCE, max_steps: int = MAX_STEPS) -> DataFrame:
        """a^(-1/2) of a symmetric positive definite matrix by the coupled Newton-Schulz iteration, stored.

        Y goes to (a / c)^(1/2) and Z to its inverse: P = (3 I - Z Y) / 2, Y P, P Z. Each step is stored, so a lost
        executor costs a part of one step, and what it no longer needs is deleted. One number a step reaches the
        driver: the distance of Z Y from I, which stops the iteration once it no longer falls below ``tol``.
        """
        spark = a.sparkSession
        root = f"{use_checkpoint_folder(spark).rstrip('/')}/root-{uuid.uuid4().hex}"

        def stored(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{root}/{name}")
            return spark.read.schema(BLOCK).parquet(f"{root}/{name}")

        c = self.norm(a)
        y = stored(self.combined(a, 1 / c, 0.0), "y0")
        z = stored(self.combined(y, 0.0, 1.0), "z0")
        last = np.inf
        for step in range(1, max_steps + 1):
            p = stored(self.combined(self.multiply(z, y), -0.5, 1.5), f"p{step}")
            off = 2 * self.norm(p, -1.0)
            # Far away each step brings it nearer; near the end rounding stops that.
            if off < tol * self.dim or (off >= last and off < 1e-3):
                break
            last = off
            y, z = stored(self.multiply(y, p), f"y{step}"), stored(self.multiply(p, z), f"z{step}")
            for name in (f"y{step - 1}", f"z{step - 1}", f"p{step}"):
                delete_folder(spark, f"{root}/{name}")
        else:
            raise ValueError(f"no inverse root after {max_steps} steps: Z Y is {off} from I")
        return self.combined(z, c**-0.5, 0.0)

    def applied(self, df: DataFrame, matrix: DataFrame, block_bytes: int = 64 << 20) -> DataFrame:
        """``df`` with ``vec`` replaced by vec times the matrix, whose blocks are read past vectors that stay in place."""
        place = F.struct("bi", "bj").cast("string").alias("place")
        blocks = write_blocks(matrix.select(place, "bi", "bj", "cells"), "place", "cells", block_bytes)
        others = [c for c in df.columns if c != "vec"]
        types = dict(df.dtypes)
        schema = ", ".join([f"`{c}` {types[c]}" for c in others] + ["vec array<double>"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for stretch in kernels.stretches(batches, block_bytes):
                x = kernels.list_matrix(stretch.column(len(others)), self.dim)
                out = np.zeros((len(x), self.dim))
                for block in blocks:
                    for r in range(block.num_rows):
                        bi, bj = block.column("bi")[r].as_py(), block.column("bj")[r].as_py()
                        cells = block.column("cells")[r].values.to_numpy().reshape(self.height(bi), self.height(bj))
                        i, j = bi * self.block, bj * self.block
                        out[:, j : j + self.height(bj)] += x[:, i : i + self.height(bi)] @ cells
                made = kernels.to_list_array(out, pa.float64())
                yield pa.RecordBatch.from_arrays([*stretch.columns[: len(others)], made], [*others, "vec"])

        return df.where(F.size("vec") == self.dim).select(*others, "vec").mapInArrow(run, schema)


def whiten_blocks(df: DataFrame, dim: int, eps: float, block: int) -> DataFrame:
    """``moments.whiten`` without a dim x dim matrix in any one process."""
    m = Blocked(dim, block)
    n = df.where(F.size("vec") == dim).count()
    root = m.inverse_root(m.combined(m.scatter(df), 1.0, eps))
    return m.applied(df, m.combined(root, (n + eps - 1) ** 0.5, 0.0))
