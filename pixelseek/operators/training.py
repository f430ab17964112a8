"""Training of a classifier head: mini-batches, gradients as one aggregation, weight updates."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelseek.functions import kernels
from pixelseek.functions.codebooks import delete_folder, local_table, use_checkpoint_folder
from pixelseek.functions.hashing import hash32
from pixelseek.operators.moments import class_weights

# Rows are numbered apart in hash ranges of about RANGE_ROWS rows.
RANGE_ROWS = 1 << 20
MIN_RANGES, MAX_RANGES = 1 << 10, 1 << 20


def minibatches(df: DataFrame, batch_size: int, seed: int = 0, key: str = "vec_id") -> DataFrame:
    """Add ``batch``: rows in seeded hash order, cut into runs of exactly ``batch_size``.

    Rows are numbered within ranges of the hash, and each range starts after the counts of the
    ranges before it, so no task sorts the whole table. The window over the counts holds one row
    per range.
    """
    rows, ranges = df.count(), MIN_RANGES
    while ranges < MAX_RANGES and rows > ranges * RANGE_ROWS:
        ranges *= 2
    keyed = df.withColumn("_hash", hash32(seed, F.col(key)))
    keyed = keyed.withColumn("_range", F.floor(F.col("_hash") / (2**32 // ranges)).cast("int"))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy("_hash", key)
    numbered = keyed.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_range")
    batch = F.floor((F.col("_start") + F.col("_at")) / batch_size).cast("int")
    return numbered.withColumn("batch", batch).drop("_hash", "_range", "_at", "_start")


@dataclass
class HeadParams:
    """Training parameters with their defaults. Rate and momentum are numbers or lists, one per epoch."""

    function: str = "soft"
    batch_size: int | None = 50
    epochs: int = 1
    alpha: float | list[float] = 1.0
    momentum: float | list[float] = 0.0
    adjust_rate: float = 0.0
    max_coef: float = 1.0
    balance: bool = False
    shuffle: bool = True
    svm_c: float = 1.0
    seed: int = 0

    @property
    def min_coef(self) -> float:
        return 1.0 / self.max_coef


def at_epoch(value: float | list[float], epoch: int) -> float:
    """A parameter's value in an epoch; the last one of a list holds on."""
    return value[min(epoch, len(value) - 1)] if isinstance(value, (list, tuple)) else value


@dataclass
class Head:
    """Weights (classes x inputs), biases, and the state of the update rule."""

    w: np.ndarray
    b: np.ndarray
    state: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    losses: list[float] = field(default_factory=list)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(out, inp, w), with inp = 0 for biases."""
        cells = np.hstack([self.b[:, None], self.w])
        out, inp = np.indices(cells.shape)
        return local_table(
            spark,
            {
                "out": pa.array((out + 1).ravel(), pa.int32()),
                "inp": pa.array(inp.ravel(), pa.int32()),
                "w": pa.array(cells.ravel(), pa.float64()),
            },
        )


def _error(a: np.ndarray, y: np.ndarray, function: str, coefs: np.ndarray) -> tuple[np.ndarray, float]:
    """Derivative by the weighted input of each output, and the summed loss."""
    if function == "SVM":
        signs = 2 * y - 1
        slack = np.maximum(1 - a * signs, 0)
        return kernels.snap(-2 * signs * slack * coefs), float((slack * slack).sum())
    diff = a - y
    loss = float((diff * diff).sum() / 2)
    d = kernels.snap(diff * coefs)
    if function == "soft":
        d = a * (d - (a * d).sum(axis=1, keepdims=True))
    elif function == "sigm":
        d = d * a * (1 - a)
    elif function == "relu":
        d = d * (a > 0)
    return d, loss


def gradient(batch: DataFrame, head: Head, classes: list[int], function: str, coefs: np.ndarray) -> DataFrame:
    """(out, i, g, loss, n): sums over the batch of the gradient per class and input, the bias at i = 0.

    Each task adds up its own rows; the shuffle carries classes x (inputs + 1) numbers per task.
    """
    order = np.array(classes)
    inputs = head.w.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros((len(order), inputs + 1)), 0.0, 0
        for rb in batches:
            x = kernels.list_matrix(rb.column(0), inputs)
            y = (rb.column(1).to_numpy(zero_copy_only=False)[:, None] == order[None, :]).astype(float)
            d, part = _error(kernels.activate(x @ head.w.T + head.b, function), y, function, coefs)
            total[:, 0] += d.sum(axis=0)
            total[:, 1:] += d.T @ x
            loss, n = loss + part, n + len(x)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(1, len(order) + 1), pa.int32()),
                kernels.to_list_array(total, pa.float64()),
                pa.array(np.full(len(order), loss)),
                pa.array(np.full(len(order), n), pa.int64()),
            ],
            names=["out", "line", "loss", "n"],
        )

    rows = batch.select("vec", "label").mapInArrow(sums, "out int, line array<double>, loss double, n bigint")
    cells = rows.select("out", "loss", "n", F.posexplode("line").alias("i", "g"))
    return cells.groupBy("out", "i").agg(
        F.sum("g").alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n")
    )


def _step(head: Head, batch: DataFrame, classes: list[int], coefs: np.ndarray, p: HeadParams, epoch: int) -> None:
    momentum = at_epoch(p.momentum, epoch)
    for name in ("w", "b"):
        value = getattr(head, name)
        previous, gain = head.state.setdefault(name, (np.zeros_like(value), np.ones_like(value)))
        if momentum:
            setattr(head, name, kernels.snap(value - momentum * previous))
    grad = np.zeros((len(classes), head.w.shape[1] + 1))
    n, loss = 0, 0.0
    for r in gradient(batch, head, classes, p.function, coefs).collect():
        grad[r["out"] - 1, r["i"]] = r["g"]
        n, loss = r["n"], r["loss"]
    if not n:
        return
    grads = {"w": grad[:, 1:] / n, "b": grad[:, 0] / n}
    if p.function == "SVM":
        grads["w"] = grads["w"] + head.w / p.svm_c
    head.losses.append(loss / n)
    for name in ("w", "b"):
        previous, gain = head.state[name]
        step = at_epoch(p.alpha, epoch) * kernels.snap(grads[name])
        if p.adjust_rate > 0:
            agree = previous * step > 0
            gain = np.where(agree, gain + p.adjust_rate, gain * (1 - p.adjust_rate))
            gain = np.clip(gain, p.min_coef, p.max_coef)
            step = step * gain
        head.state[name] = (step, gain)
        if momentum > 0:
            step = (1 - momentum) * step
        setattr(head, name, kernels.snap(getattr(head, name) - step))


def fit_head(
    df: DataFrame,
    weights: DataFrame,
    params: HeadParams | None = None,
    classes: list[int] | None = None,
) -> Head:
    """Train the last layer on (vec_id, vec, label); ``weights`` has (out, inp, w), inp = 0 for biases.

    One aggregation per step. With mini-batches the batched table is written once an epoch under
    the session's checkpoint folder, in files that each hold a range of batches in order, so that a
    step reads its batch only and a lost executor re-reads files; it is removed after the epoch.
    ``batch_size=None`` takes the whole table per step and needs no copy.
    """
    p = params or HeadParams()
    spark = df.sparkSession
    counted = class_weights(df.select("label")).collect()
    classes = sorted(classes or [r["label"] for r in counted])
    found = {r["label"]: r["weight"] for r in counted}
    coefs = np.array([found[c] if p.balance else 1.0 for c in classes])
    cells = weights.collect()
    inputs = max(r["inp"] for r in cells)
    head = Head(np.zeros((len(classes), inputs)), np.zeros(len(classes)))
    for r in cells:
        if r["inp"]:
            head.w[r["out"] - 1, r["inp"] - 1] = r["w"]
        else:
            head.b[r["out"] - 1] = r["w"]
    rows = df.select("vec_id", "vec", "label").where(F.size("vec") == inputs)
    for epoch in range(p.epochs):
        if p.batch_size is None:
            _step(head, rows, classes, coefs, p, epoch)
            continue
        folder = os.path.join(use_checkpoint_folder(spark), f"batches-{uuid.uuid4().hex}")
        order = p.seed + epoch if p.shuffle else p.seed
        batches = minibatches(rows, p.batch_size, order)
        batches.repartitionByRange("batch").sortWithinPartitions("batch").write.parquet(folder)
        stored = spark.read.schema("vec_id bigint, vec array<double>, label int, batch int").parquet(folder)
        last = stored.agg(F.max("batch")).first()[0]
        for b in range((last if last is not None else -1) + 1):
            _step(head, stored.where(F.col("batch") == b), classes, coefs, p, epoch)
        delete_folder(spark, folder)
    return head
