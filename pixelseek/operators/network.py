"""Layers on tables: seeded weights, dense layers and batch scoring of a layer list.

Weights are rows (layer, part, out, inp, dy, dx, w): part "k" for kernels, "w" for dense
weights, "b" for biases and "shift" / "scale" for coordinate-wise layers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseek.functions import kernels
from pixelseek.functions.codebooks import MAX_BYTES, fetch_rows
from pixelseek.functions.hashing import hash_unit
from pixelseek.functions.vector import ACTIVATIONS, affine, l2_normalize, snap
from pixelseek.operators import pixels as px

CELL_BYTES = 128


@dataclass(frozen=True)
class Shape:
    """Input and output of one layer: maps of (rows, columns), or a length when flat."""

    maps: int
    size: tuple[int, int]
    length: int


def shapes(layers: list[dict]) -> list[Shape]:
    """Output shape of every layer; raises on an unknown or misplaced layer."""
    out: list[Shape] = []
    for n, layer in enumerate(layers):
        kind = layer["type"]
        if (n == 0) != (kind == "i"):
            raise ValueError("the input layer comes first and only there")
        if kind == "i":
            maps, (h, w) = layer.get("outputmaps", 1), layer["mapsize"]
        else:
            maps, (h, w) = out[-1].maps, out[-1].size
        if kind in ("j", "t"):
            h, w = layer["mapsize"]
        elif kind == "s":
            th, tw = layer.get("stride", layer["scale"])
            h, w = math.ceil(h / th), math.ceil(w / tw)
        elif kind == "c":
            (kh, kw), (ph, pw) = layer["kernelsize"], layer.get("padding", (0, 0))
            maps, h, w = layer["outputmaps"], h + 2 * ph - kh + 1, w + 2 * pw - kw + 1
        elif kind == "f":
            maps, h, w = layer["length"], 1, 1
        elif kind not in ("i", "n"):
            raise ValueError(f"unknown layer type {kind!r}")
        out.append(Shape(maps, (h, w), maps * h * w))
    return out


def init_weights(spark: SparkSession, layers: list[dict], seed: int = 0) -> DataFrame:
    """Kernels and dense weights uniform in +-sqrt(6 / (fan in + fan out)), biases zero.

    Values come from a hash of (seed, layer, out, inp, dy, dx), so any cell can be computed alone.
    """
    parts = None
    for n, (layer, shape) in enumerate(zip(layers, shapes(layers))):
        if layer["type"] not in ("c", "f"):
            continue
        before = shapes(layers)[n - 1]
        conv = layer["type"] == "c"
        kh, kw = layer["kernelsize"] if conv else (1, 1)
        inputs = before.maps if conv else before.length
        span = math.sqrt(6 / ((inputs + shape.maps) * kh * kw))
        cells = spark.range(1, shape.maps + 1).select(F.col("id").cast("int").alias("out"))
        for name, last, first in (("inp", inputs, 1), ("dy", kh - 1, 0), ("dx", kw - 1, 0)):
            cells = cells.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(last))))
        drawn = (hash_unit(seed, F.lit(n), F.col("out"), F.col("inp"), F.col("dy"), F.col("dx")) - 0.5) * (2 * span)
        weights = cells.select(
            F.lit(n).alias("layer"), F.lit("k" if conv else "w").alias("part"), "out", "inp", "dy", "dx", drawn.alias("w")
        )
        zero = F.lit(0)
        biases = spark.range(1, shape.maps + 1).select(
            F.lit(n).alias("layer"),
            F.lit("b").alias("part"),
            F.col("id").cast("int").alias("out"),
            zero.alias("inp"),
            zero.alias("dy"),
            zero.alias("dx"),
            F.lit(0.0).alias("w"),
        )
        both = weights.unionByName(biases)
        parts = both if parts is None else parts.unionByName(both)
    if parts is None:
        raise ValueError("no layer has weights")
    return parts


def standardizer_weights(fitted: DataFrame, layer: int = 0) -> DataFrame:
    """Weight rows of a coordinate-wise layer from (i, shift, scale), as ``fit_standardizer`` gives them."""
    zero = F.lit(0)
    parts = F.array(
        F.struct(F.lit("shift").alias("part"), F.col("shift").alias("w")),
        F.struct(F.lit("scale").alias("part"), F.col("scale").alias("w")),
    )
    return fitted.select(F.lit(layer).alias("layer"), F.col("i").alias("out"), F.explode(parts).alias("p")).select(
        "layer", "p.part", "out", zero.alias("inp"), zero.alias("dy"), zero.alias("dx"), "p.w"
    )


def _dense_joined(vectors: DataFrame, weights: DataFrame, biases: DataFrame, keep: float) -> DataFrame:
    """For weights too large to ship: join cells on the input number and add up per output."""
    shape = weights.agg(F.max("inp"), F.max("out")).first()
    cells = vectors.where(F.size("vec") == shape[0]).select("vec_id", F.posexplode("vec").alias("p", "x"))
    # Outputs without a weight still have their bias: as outputs with a zero weight.
    empty = vectors.sparkSession.range(1, shape[1] + 1).select(
        F.col("id").cast("int").alias("out"), F.lit(1).alias("inp"), F.lit(0.0).alias("w")
    )
    every = weights.select("out", "inp", "w").unionByName(empty)
    met = cells.withColumn("inp", F.col("p") + 1).join(every, "inp")
    sums = met.groupBy("vec_id", "out").agg(F.sum(F.col("x") * F.col("w")).alias("a"))
    shift = F.coalesce("b", F.lit(0.0))
    rows = sums.join(biases.select("out", F.col("w").alias("b")), "out", "left").select(
        "vec_id", F.struct("out", ((F.col("a") + shift) * keep).alias("a")).alias("c")
    )
    lists = rows.groupBy("vec_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return lists.select("vec_id", F.transform("cs", lambda c: c["a"]).alias("vec"))


def dense(
    vectors: DataFrame,
    weights: DataFrame,
    biases: DataFrame,
    function: str = "relu",
    dropout: float = 0.0,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """(vec_id, vec) after a = x W' + b and the activation. ``weights`` has (out, inp, w), ``biases`` (out, w).

    At scoring time dropout scales inputs and biases by 1 - dropout.
    """
    keep = 1.0 - dropout
    cells = fetch_rows(weights.select("out", "inp", "w"), max_bytes // CELL_BYTES)
    if cells is not None:
        shift = {r["out"]: r["w"] for r in biases.select("out", "w").collect()}
        matrix = np.zeros((max(r["inp"] for r in cells), max(r["out"] for r in cells)))
        for r in cells:
            matrix[r["inp"] - 1, r["out"] - 1] = r["w"]
        b = np.array([shift.get(o + 1, 0.0) for o in range(matrix.shape[1])])

        def forward(x: np.ndarray) -> np.ndarray:
            return kernels.activate((x @ matrix + b) * keep, function)

        rows = vectors.select("vec_id", "vec").where(F.size("vec") == matrix.shape[0])
        return kernels.map_vectors(rows, forward, matrix.shape[0])
    active = snap(ACTIVATIONS[function](snap(F.col("vec"))))
    return _dense_joined(vectors, weights, biases, keep).select("vec_id", active.alias("vec"))


def _coordinates(rows: DataFrame, part: str) -> DataFrame:
    """Coordinate-wise parameters of one layer as a single array row."""
    cells = rows.where(F.col("part") == part)
    packed = cells.agg(F.array_sort(F.collect_list(F.struct("out", "w"))).alias("cs"))
    return packed.select(F.transform("cs", lambda c: c["w"]).alias("a"))


def _activate_pixels(pixels: DataFrame, function: str) -> DataFrame:
    """Activation of a map layer; "soft" runs over the whole image as one row."""
    v = F.col("v")
    if function == "relu":
        return pixels.withColumn("v", F.greatest(v, F.lit(0.0)))
    if function == "sigm":
        return pixels.withColumn("v", (F.tanh(v / 2) + 1) / 2)
    if function == "soft":
        top = pixels.groupBy("image_id").agg(F.max("v").alias("m"))
        raised = pixels.join(top, "image_id").withColumn("e", F.exp(F.col("v") - F.col("m")))
        total = raised.groupBy("image_id").agg(F.sum("e").alias("s"))
        return raised.join(total, "image_id").withColumn("v", F.col("e") / F.col("s")).drop("e", "m", "s")
    raise ValueError(f"unknown function {function!r}")


def _snap_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", F.element_at(snap(F.array("v")), 1))


def score(images: DataFrame, layers: list[dict], weights: DataFrame, last_hidden: bool = False) -> DataFrame:
    """(vec_id, vec): predictions of a layer list, or with ``last_hidden`` the activations before
    the last layer, which serve as image signature.

    ``images`` has (vec_id, vec). Map layers run on pixel tables, dense layers on vectors. A
    layer's weights are codebook-sized and go to the tasks; the images stay distributed.
    """
    plan = shapes(layers)
    stop = len(layers) - 1 if last_hidden else len(layers)
    flat: DataFrame | None = images.select("vec_id", "vec").where(F.size("vec") == plan[0].length)
    maps: DataFrame | None = None
    for n in range(stop):
        layer, rows = layers[n], weights.where(F.col("layer") == n)
        kind = layer["type"]
        if kind in ("i", "n", "f") and flat is None:
            flat, maps = px.to_vectors(maps), None
        elif kind not in ("i", "n", "f") and maps is None:
            h, w = plan[n - 1].size
            # One shuffle of whole images; every later grouping holds the image and needs no other.
            maps, flat = px.to_pixels(flat.repartition("vec_id"), w, h), None
        if kind == "i":
            vec = F.col("vec")
            if "norm" in layer:
                vec = l2_normalize(vec, layer["norm"])
            flat = flat.select("vec_id", vec.alias("vec"))
        if kind == "n" or (kind == "i" and ("mean" in layer or "maxdev" in layer)):
            shift, scale = (_coordinates(rows, p).scalar() for p in ("shift", "scale"))
            flat = flat.select("vec_id", F.col("vec"), shift.alias("_m"), scale.alias("_s"))
            flat = flat.select("vec_id", snap(affine(F.col("vec"), F.col("_m"), F.col("_s"))).alias("vec"))
        elif kind == "j":
            keys = ("shift", "scale", "mirror", "angle", "default")
            maps = px.augment(maps, layer["mapsize"], seed=layer.get("seed", 0), **{k: layer[k] for k in keys if k in layer})
        elif kind == "t":
            maps = px.max_trim(maps, layer["mapsize"])
        elif kind == "s":
            maps = px.pool(maps, layer["scale"], layer.get("stride"), layer.get("function", "mean"))
        elif kind == "c":
            taps = rows.where(F.col("part") == "k")
            shifts = rows.where(F.col("part") == "b").select("out", F.col("w").alias("b"))
            maps = px.convolve(maps, taps, layer["kernelsize"], shifts, layer.get("padding", (0, 0)))
            maps = _snap_pixels(_activate_pixels(_snap_pixels(maps), layer.get("function", "relu")))
        elif kind == "f":
            cells, shifts = rows.where(F.col("part") == "w"), rows.where(F.col("part") == "b")
            flat = dense(flat, cells, shifts, layer.get("function", "relu"), layer.get("dropout", 0.0))
    return flat if flat is not None else px.to_vectors(maps)
