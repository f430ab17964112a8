"""Numpy helpers that run on Arrow batches inside Spark tasks.

Distances from a vector to every entry of a codebook cost |codebook| x d operations per
row. Higher-order SQL functions interpret each of them; on 200 000 x 64 values against 16
centres the Arrow form took 0.6 s and the interpreted form 6.7 s on eight cores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelseek.functions.vector import EPS


def list_rows(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (row numbers, matrix) once per vector length found in the batch."""
    lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        if len(rows) == len(lengths):
            yield rows, flat.reshape(len(rows), n)
        else:
            yield rows, flat[starts[rows][:, None] + np.arange(n)]


def list_matrix(col: pa.Array, width: int) -> np.ndarray:
    """The rows as a matrix; rows of another length, or NULL, are an error, never cut or joined."""
    lengths = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors must have length {width}, found {sorted(set(lengths[lengths != width]))[:5]}")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to stretches of about ``size`` bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield pa.concat_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)


def to_list_array(matrix: np.ndarray, arrow_type: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel(), arrow_type)
    )


def ragged_struct(counts: np.ndarray, **fields: pa.Array) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    values = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def chi2_block(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(book)))
    if len(book) > len(x):
        # The loop runs over the shorter side; the distance is symmetric.
        return np.ascontiguousarray(chi2_block(book, x).T)
    for j, b in enumerate(book):
        total, diff = x + b, x - b
        term = np.divide(diff * diff, total, out=np.zeros_like(total), where=total != 0)
        out[:, j] = term.sum(axis=1) / 2
    return out


def l2_block(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(book)))
    if len(book) > len(x):
        return np.ascontiguousarray(l2_block(book, x).T)
    for j, b in enumerate(book):
        diff = x - b
        out[:, j] = np.einsum("ij,ij->i", diff, diff)
    return out


BLOCKS = {"chi2": chi2_block, "l2sq": l2_block}


def minmax_rows(d: np.ndarray) -> np.ndarray:
    """Scale every row to [0, 1]; NaN where all its entries are equal."""
    low = d.min(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (d - low) / (d.max(axis=1, keepdims=True) - low)


def nearest(x: np.ndarray, cids: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closest centre of each row and its squared distance; ``cids`` ascend, so ties take the lowest."""
    d = l2_block(x, book)
    best = d.argmin(axis=1)
    return cids[best], d[np.arange(len(x)), best]


def snap(a: np.ndarray) -> np.ndarray:
    return np.where(np.abs(a) < EPS, 0.0, a)


def activate(a: np.ndarray, function: str) -> np.ndarray:
    """Activation of each row, with numbers next to zero set to zero before and after."""
    a = snap(a)
    if function == "soft":
        e = np.exp(a - a.max(axis=1, keepdims=True, initial=-np.inf))
        a = e / e.sum(axis=1, keepdims=True)
    elif function == "sigm":
        a = (1 + np.tanh(a / 2)) / 2
    elif function == "relu":
        a = np.maximum(a, 0)
    elif function not in ("linear", "SVM"):
        raise ValueError(f"unknown function {function!r}")
    return snap(a)


def map_vectors(
    df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], width: int, out: str = "vec", cell: str = "double"
) -> DataFrame:
    """Replace ``vec``, all of length ``width``, by the array ``fn`` makes of each batch.

    A separate plan node, so that column functions can be applied to the result: a Python
    function inlined into a lambda cannot run.
    """
    others = [c for c in df.columns if c != "vec"]
    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in others] + [f"{out} array<{cell}>"])
    arrow_cell = {"double": pa.float64(), "int": pa.int32()}[cell]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = to_list_array(fn(list_matrix(batch.column(len(others)), width)), arrow_cell)
            columns = [*batch.columns[: len(others)], made]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, out])

    return df.select(*others, "vec").mapInArrow(mapped, schema)
