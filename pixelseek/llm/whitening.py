"""Whitening of embeddings by the leading principal components.

Vectors whose entry is null, NaN or infinite, and null vectors, are dropped. Entries become whole numbers
``x = floor(scale * c)``; the fit list is each distinct x once, so copies of a vector weigh no more than one. Sums over
it are exact. The covariance is added up from centred vectors inside the tasks; one matrix per task is folded row by
row. Its leading eigenvectors come from a Householder tridiagonalisation, bisection by Sturm counts and inverse
iteration (``symmetric``); rows are then projected where they are read.

The driver holds one covariance matrix, of at most ``max_dim`` rows (134 MB); wider vectors raise ValueError. The model
that goes to the tasks is as many vectors as components are asked for.

Defined cases: repeated ids and null ids are rows as any other. The vectors' length is the commonest one above zero (of
equally common ones the longest). Rows of another length, and rows with an entry beyond 2^40 after scaling, stay out of
the fit list and get null results. A component without variance (an eigenvalue not above rounding, as with fewer
different vectors than components) gets null in every row. Fewer dimensions than components give as many components as
dimensions; no fitting row at all gives none. Deviations beyond 38 digits are null. Columns named like the new ones are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseek.llm import symmetric
from pixelseek.llm.common import stored

SCALE = 256
COMPONENTS = 4
MAX_DIM = 4096
MAX_ENTRY = 1 << 40


@dataclass(frozen=True)
class Whitening:
    """Fitted on n distinct vectors with per-dimension sums; values fall, vectors are columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace > 0 else None for e in self.values]

    @property
    def flat(self) -> np.ndarray:
        """Components without variance."""
        return ~(self.values > len(self.sums) * symmetric.EPS * self.trace)


def finite(vector: Column) -> Column:
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda v: F.floor(v * scale))


def _fits(vector: Column, dim: int, scale: int) -> Column:
    return (F.size(vector) == dim) & F.forall(vector, lambda v: F.abs(v) * scale < MAX_ENTRY)


def _vectors(rows: DataFrame, vec: str) -> DataFrame:
    return rows.select(F.col(f"`{vec}`").cast("array<double>").alias("v")).filter(finite(F.col("v")))


def fit_list(rows: DataFrame, vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(x) each distinct vector of whole numbers once, stored."""
    good = _vectors(rows, vec)
    sizes = good.groupBy(F.size("v").alias("dim")).count().filter("dim > 0")
    commonest = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    dim = commonest["dim"] if commonest else 0
    fitting = good.filter(_fits(F.col("v"), dim, scale)) if dim else good.limit(0)
    return stored(fitting.select(whole_numbers(F.col("v"), scale).alias("x")).distinct(), "vectors")


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["x"].to_numpy())


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, sums = 0, None
    for batch in batches:
        if len(batch):
            # A batch of 2^20 rows at most: sums of entries below 2^40 fit.
            part = _matrix(batch).sum(axis=0).astype(object)
            n, sums = n + len(batch), part if sums is None else sums + part
    if n:
        yield pd.DataFrame({"i": range(len(sums)), "n": n, "s": [str(s) for s in sums]})


def _centred_products(mean: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                c = _matrix(batch) - mean
                total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "row": list(total)})

    return run


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of equal i added up as they come."""
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch["i"], batch["row"]):
            rows[i] = rows[i] + row if i in rows else np.array(row)
    if rows:
        yield pd.DataFrame({"i": list(rows), "row": list(rows.values())})


def fit(listed: DataFrame, components: int = COMPONENTS, scale: int = SCALE, max_dim: int = MAX_DIM) -> Whitening:
    """The model of a (stored) fit list."""
    # Whole numbers beyond 64 bits add up exactly.
    parts = listed.mapInPandas(_totals, "i int, n long, s string")
    totals = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    if listed.isEmpty():
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, scale)
    dim = F.size(F.first("x"))
    d = listed.limit(1).agg(dim).first()[0]
    if d > max_dim:
        raise ValueError(f"vectors of {d} dimensions: a covariance of more than {max_dim} rows is not held in the driver")
    by_place = sorted(totals.collect())
    n, sums = by_place[0]["n"], [int(t["s"]) for t in by_place]
    mean = np.array([s / n for s in sums])
    products = listed.mapInPandas(_centred_products(mean), "i int, row array<double>")
    folded = products.repartition("i").mapInPandas(_folded, "i int, row array<double>")
    covariance = np.empty((d, d))
    for r in folded.toLocalIterator():
        covariance[r["i"]] = r["row"]
    covariance /= n
    values, vectors = symmetric.leading((covariance + covariance.T) / 2, components)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)), scale)


def _projected(model: Whitening):
    """x to (exact deviation as text, whitened components)."""
    mean, flat = model.mean, model.flat
    scaled = model.vectors / np.sqrt(np.where(flat, 1.0, model.values))
    sums = np.array(model.sums, dtype=object)
    most = max((abs(s) for s in model.sums), default=0)

    def run(xs: pd.Series) -> pd.DataFrame:
        known = xs.notna().to_numpy()
        deviation: list[str | None] = [None] * len(xs)
        whitened: list[list[float | None] | None] = [None] * len(xs)
        if known.any():
            x = np.stack(xs[known].to_numpy())
            bound = model.n * int(np.abs(x).max(initial=0)) + most
            if bound * bound * x.shape[1] < 1 << 63:
                off = model.n * x - sums.astype(np.int64)
            else:
                off = model.n * x.astype(object) - sums
            w = ((x - mean) @ scaled).astype(object)
            w[:, flat] = None
            for i, total, row in zip(np.flatnonzero(known), (off * off).sum(axis=1), w.tolist()):
                deviation[i], whitened[i] = str(total), row
        return pd.DataFrame({"deviation": deviation, "whitened": whitened})

    return F.pandas_udf(run, "deviation string, whitened array<double>")


def whiten(rows: DataFrame, model: Whitening, vec: str = "embedding") -> DataFrame:
    """``rows`` with finite vectors, with ``deviation`` (sum over dimensions of (n x - S)^2, exact) and ``whitened``."""
    names = [c for c in rows.columns if c not in ("deviation", "whitened")]
    kept = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{vec}`").cast("array<double>").alias("v")
    ).filter(finite(F.col("v")))
    if not model.n:
        told = kept.withColumn("p", F.lit(None).cast("struct<deviation:string,whitened:array<double>>"))
    else:
        x = F.when(_fits(F.col("v"), len(model.sums), model.scale), whole_numbers(F.col("v"), model.scale))
        told = kept.withColumn("p", _projected(model)(x))
    # A row without results gets null for each component.
    none = F.array_repeat(F.lit(None).cast("double"), len(model.values))
    return told.select(
        "row.*",
        F.col("p.deviation").try_cast("decimal(38,0)").alias("deviation"),
        F.coalesce("p.whitened", none).alias("whitened"),
    )


def identity_error(listed: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the fit list's whitened values minus the identity; null components
    are left out, and without any the result is None."""
    places = [i for i, flat in enumerate(model.flat) if not flat]
    if not places:
        return None
    w = listed.select(_projected(model)("x")["whitened"].alias("w"))
    w = w.select(*[F.get("w", F.lit(i)).alias(f"c{i}") for i in places])
    pairs = [(i, j) for i in places for j in places if i <= j]
    # covar_pop moves its centre along: products are of centred values.
    found = w.agg(*[F.covar_pop(f"c{i}", f"c{j}").alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, found))
