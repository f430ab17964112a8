"""Operators on pixel tables (image_id, width, height, ch, x, y, v), with x and y from 1.

Each image's pixels are aggregated inside the task that holds them before any shuffle, so a
shuffle carries results (histogram bins, output pixels), not inputs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseek.functions import kernels
from pixelseek.functions.hashing import hash_unit
from pixelseek.operators.relational import join_side

# Grey levels of an 8-bit image, and the only number of sectors that is defined.
LEVELS, SECTORS = 256, 8
OUT_BLOCK = 32
IMAGE = ("image_id", "width", "height")


def with_sizes(pixels: DataFrame) -> DataFrame:
    """Add width and height, the largest x and y of each image, where the table lacks them."""
    sizes = pixels.groupBy("image_id").agg(F.max("x").alias("width"), F.max("y").alias("height"))
    return pixels.join(sizes, "image_id")


def histogram_bin(v: Column, bins: int | list[float]) -> Column:
    """1-based bin, NULL outside. A number means equal bins of round(256 / bins) levels."""
    if isinstance(bins, int):
        step = math.floor(LEVELS / bins + 0.5)
        return F.when((v >= 0) & (v < step * bins), F.floor(v / step) + 1).cast("int")
    edges = F.array(*[F.lit(float(b)) for b in bins])
    place = F.size(F.filter(edges, lambda e: e <= v))
    return F.when((place > 0) & (place < len(bins)), place)


def ring_column(rings: int) -> Column:
    """Output column of the nested rectangular ring of a pixel; the innermost ring is column 1.

    Every ring is floor((size - 1) / (2 rings)) wide on each side. Where that is 0 the axis does
    not shrink and does not limit the depth.
    """

    def depth(at: Column, size: Column) -> Column:
        width = F.floor((size - 1) / (2 * rings))
        edge = F.least(at - 1, size - at)
        return F.when(width > 0, F.floor(F.try_divide(edge, width))).otherwise(F.lit(rings))

    deep = F.least(depth(F.col("x"), F.col("width")), depth(F.col("y"), F.col("height")))
    return (rings - F.least(deep + 1, F.lit(rings)) + 1).cast("int")


def sector_number() -> Column:
    """Triangular sector 1-8 of a pixel, anticlockwise from east, each between a side's middle and a corner.

    Sectors are half-open, so every pixel is in exactly one; the centre is in sector 1.
    """
    cx, cy = F.floor((F.col("width") + 1) / 2 + 0.5), F.floor((F.col("height") + 1) / 2 + 0.5)
    right, up = F.col("x") - cx, cy - F.col("y")
    east, west = F.col("width") - cx, cx - 1
    north, south = cy - 1, F.col("height") - cy
    return (
        F.when((right == 0) & (up == 0), 1)
        .when((right > 0) & (up >= 0), F.when(up * east < right * north, 1).otherwise(2))
        .when((right <= 0) & (up > 0), F.when(-right * north < up * west, 3).otherwise(4))
        .when((right < 0) & (up <= 0), F.when(-up * west < -right * south, 5).otherwise(6))
        .otherwise(F.when(right * south < -up * east, 7).otherwise(8))
    )


def _histogram(pixels: DataFrame, column: Column, bins) -> DataFrame:
    placed = pixels.select(
        "image_id", column.alias("col"), "ch", histogram_bin(F.col("v"), bins).alias("bin")
    ).where(F.col("bin").isNotNull())
    counts = placed.groupBy("image_id", "col", "ch", "bin").agg(F.count(F.lit(1)).alias("n"))
    ring = F.sum("n").over(Window.partitionBy("image_id", "col"))
    return counts.withColumn("share", F.col("n") / ring)


def annular_histogram(pixels: DataFrame, bins: int | list[float], rings: int) -> DataFrame:
    """(image_id, col, ch, bin, n, share): non-zero histogram bins of every ring."""
    return _histogram(pixels, ring_column(rings), bins)


def segment_annular_histogram(
    pixels: DataFrame, bins: int | list[float], rings: int, sectors: int = SECTORS
) -> DataFrame:
    """The same for every ring of every sector; column = (sector - 1) x rings + ring column."""
    if sectors != SECTORS:
        raise ValueError(f"{sectors} sectors are not defined, only {SECTORS}")
    column = ((sector_number() - 1) * rings + ring_column(rings)).cast("int")
    return _histogram(pixels, column, bins)


def convolve(
    pixels: DataFrame,
    kernels: DataFrame,
    kernel_size: tuple[int, int],
    bias: DataFrame | None = None,
    padding: tuple[int, int] = (0, 0),
) -> DataFrame:
    """Cross-correlation summed over input maps, plus the bias of each output map.

    ``kernels`` has (out, inp, dy, dx, w), offsets from 0; ``kernel_size`` and ``padding`` are
    (rows, columns). Pixels outside the image count zero. ``bias`` has (out, b). A pixel meets
    each kernel position once, with the weights of up to OUT_BLOCK output maps side by side, so
    the number of maps does not multiply the rows.
    """
    (kh, kw), (ph, pw) = kernel_size, padding
    if not (0 <= ph < kh and 0 <= pw < kw):
        raise ValueError(f"padding {padding} must lie within 0 and the kernel size {kernel_size} less one")
    maps = kernels.agg(F.max("out")).first()[0]
    lanes = range(min(maps, OUT_BLOCK))
    place, lane = F.floor((F.col("out") - 1) / OUT_BLOCK).cast("int"), (F.col("out") - 1) % OUT_BLOCK
    taps = kernels.groupBy(F.col("inp").alias("ch"), place.alias("block"), "dy", "dx").agg(
        *[F.sum(F.when(lane == n, F.col("w"))).alias(f"w{n}") for n in lanes]
    )
    x = (F.col("x") - F.col("dx") + pw).cast("int")
    y = (F.col("y") - F.col("dy") + ph).cast("int")
    width = (F.col("width") + (2 * pw - kw + 1)).cast("int")
    height = (F.col("height") + (2 * ph - kh + 1)).cast("int")
    spread = join_side(pixels, taps, "ch").select(
        "image_id",
        width.alias("width"),
        height.alias("height"),
        "block",
        x.alias("x"),
        y.alias("y"),
        *[(F.col("v") * F.col(f"w{n}")).alias(f"t{n}") for n in lanes],
    )
    inside = spread.where(F.col("x").between(1, F.col("width")) & F.col("y").between(1, F.col("height")))
    sums = inside.groupBy(*IMAGE, "block", "x", "y").agg(*[F.sum(f"t{n}").alias(f"t{n}") for n in lanes])
    rows = sums.select(*IMAGE, "block", "x", "y", F.posexplode(F.array(*[f"t{n}" for n in lanes])).alias("lane", "v"))
    out = rows.where(F.col("v").isNotNull()).select(
        *IMAGE, (F.col("block") * OUT_BLOCK + F.col("lane") + 1).cast("int").alias("ch"), "x", "y", "v"
    )
    if bias is None:
        return out
    shifts = bias.select(F.col("out").alias("ch"), "b")
    return join_side(out, shifts, "ch").select(
        *IMAGE, "ch", "x", "y", (F.col("v") + F.col("b")).alias("v")
    )


def _windows(at: str, scale: int, stride: int) -> Column:
    """Numbers of the pooling windows that cover a position; none when windows leave gaps."""
    zero = F.col(at) - 1
    first = F.greatest(F.ceil((zero - scale + 1) / stride), F.lit(0)).cast("int")
    last = F.floor(zero / stride).cast("int")
    return F.explode(F.when(first <= last, F.sequence(first + 1, last + 1)))


def pool(
    pixels: DataFrame, scale: tuple[int, int], stride: tuple[int, int] | None = None, how: str = "max"
) -> DataFrame:
    """Max or mean of windows of ``scale`` every ``stride`` (rows, columns), cut at the border."""
    (sh, sw), (th, tw) = scale, stride or scale
    if how not in ("max", "mean"):
        raise ValueError(f"unknown pooling function {how!r}")
    merge = F.max("v") if how == "max" else F.avg("v")
    cells = pixels.withColumn("_x", _windows("x", sw, tw)).withColumn("_y", _windows("y", sh, th))
    return cells.groupBy(
        "image_id",
        F.ceil(F.col("width") / tw).cast("int").alias("width"),
        F.ceil(F.col("height") / th).cast("int").alias("height"),
        "ch",
        F.col("_x").alias("x"),
        F.col("_y").alias("y"),
    ).agg(merge.alias("v"))


def max_trim(pixels: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Crop (rows, columns) around the brightest pixel whose window fits in; the first one in reading order."""
    h, w = size
    top, left = (h - 1) // 2, (w - 1) // 2
    fits = F.col("y").between(top + 1, top + F.col("height") - h + 1) & F.col("x").between(
        left + 1, left + F.col("width") - w + 1
    )
    rank = F.struct("v", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))
    # A map's pixels come together once, with its window's centre: an image is a bounded group.
    rasters = pixels.groupBy("image_id", "ch").agg(
        F.max(F.when(fits, rank)).alias("c"), F.collect_list(F.struct("x", "y", "v")).alias("cells")
    )
    corner = rasters.where(F.col("c").isNotNull()).select(
        "image_id", "ch", (-F.col("c.nx") - left).alias("x0"), (-F.col("c.ny") - top).alias("y0"), "cells"
    )
    moved = F.transform(
        "cells",
        lambda c: F.struct(
            (c["x"] - F.col("x0") + 1).cast("int").alias("x"), (c["y"] - F.col("y0") + 1).cast("int").alias("y"), c["v"].alias("v")
        ),
    )
    within = F.filter(moved, lambda c: c["x"].between(1, w) & c["y"].between(1, h))
    cut = corner.select("image_id", F.lit(w).alias("width"), F.lit(h).alias("height"), "ch", F.inline(within))
    return cut.select(*IMAGE, "ch", "x", "y", "v")


WARP = ("shift_y", "shift_x", "scale_y", "scale_x", "mirror_y", "mirror_x", "angle")


def _resample_udf(size: tuple[int, int], default: float):
    """Output pixels of each raster; an output pixel none of whose neighbours is in the table is left out."""
    h, w = size
    oy, ox = np.mgrid[0:h, 0:w]

    def one(x, y, v, width, height, shift_y, shift_x, scale_y, scale_x, mirror_y, mirror_x, sin, cos):
        known, cells = np.zeros((height, width), dtype=bool), np.zeros((height, width))
        fits = (x >= 1) & (x <= width) & (y >= 1) & (y <= height) & ~np.isnan(v)
        np.add.at(cells, (y[fits] - 1, x[fits] - 1), v[fits])
        known[y[fits] - 1, x[fits] - 1] = True
        ty, tx = (oy - (h / 2 - 0.5)) * scale_y, (ox - (w / 2 - 0.5)) * scale_x
        py = ty * cos - tx * sin + (height / 2 - 0.5) + shift_y
        px = ty * sin + tx * cos + (width / 2 - 0.5) + shift_x
        py, px = (height - 1 - py if mirror_y else py), (width - 1 - px if mirror_x else px)
        fy, fx = np.floor(py), np.floor(px)
        inside = (fy >= 0) & (fy + 1 <= height - 1) & (fx >= 0) & (fx + 1 <= width - 1)
        out, told = np.full((h, w), default), ~inside
        at_y, at_x = fy[inside].astype(int), fx[inside].astype(int)
        low_y, low_x = fy[inside] + 1 - py[inside], fx[inside] + 1 - px[inside]
        total, any_known = np.zeros(len(at_y)), np.zeros(len(at_y), dtype=bool)
        for dy, share_y in ((0, low_y), (1, 1 - low_y)):
            for dx, share_x in ((0, low_x), (1, 1 - low_x)):
                total += share_y * share_x * cells[at_y + dy, at_x + dx]
                any_known |= known[at_y + dy, at_x + dx]
        out[inside], told[inside] = total, any_known
        return ox[told] + 1, oy[told] + 1, out[told]

    @F.arrow_udf("array<struct<x:int,y:int,v:double>>")
    def resampled(
        x: pa.Array, y: pa.Array, v: pa.Array, width: pa.Array, height: pa.Array, shift_y: pa.Array, shift_x: pa.Array,
        scale_y: pa.Array, scale_x: pa.Array, mirror_y: pa.Array, mirror_x: pa.Array, sin: pa.Array, cos: pa.Array,
    ) -> pa.Array:
        ends = np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)).astype(int)[:-1]
        lists = [np.split(a.flatten().to_numpy(zero_copy_only=False), ends) for a in (x, y, v)]
        scalars = [a.to_pylist() for a in (width, height, shift_y, shift_x, scale_y, scale_x, mirror_y, mirror_x, sin, cos)]
        nothing = np.empty(0, int), np.empty(0, int), np.empty(0)
        made = [nothing if None in row[3:] else one(*row) for row in zip(*lists, *scalars)]
        out_x, out_y, out_v = (np.concatenate(c) for c in zip(*made))
        return kernels.ragged_struct(
            np.array([len(m[0]) for m in made]),
            x=pa.array(out_x, pa.int32()),
            y=pa.array(out_y, pa.int32()),
            v=pa.array(out_v, pa.float64()),
        )

    return resampled


def _rasters(pixels: DataFrame) -> DataFrame:
    """One row per (image, map) with its pixels in a list: an image is a bounded group."""
    cell = F.struct("x", "y", F.col("v").cast("double").alias("v"))
    return pixels.groupBy(*IMAGE, "ch").agg(F.collect_list(cell).alias("cells"))


def _warped(rasters: DataFrame, size: tuple[int, int], default: float) -> DataFrame:
    h, w = size
    numbers = [F.col(c).cast("boolean" if c.startswith("mirror") else "double") for c in WARP[:-1]]
    out = _resample_udf(size, float(default))(
        "cells.x", "cells.y", "cells.v", "width", "height", *numbers, F.sin("angle"), F.cos("angle")
    )
    # The rows are made from a column of their own, not from the function's call.
    told = rasters.select("image_id", "ch", out.alias("_out"))
    pixels = told.select("image_id", "ch", F.explode("_out").alias("p")).select("image_id", "ch", "p.*")
    return pixels.select("image_id", F.lit(w).alias("width"), F.lit(h).alias("height"), "ch", "x", "y", "v")


def transform(pixels: DataFrame, maps: DataFrame, size: tuple[int, int], default: float = 0.0) -> DataFrame:
    """Resample every map to ``size`` (rows, columns) by bilinear interpolation.

    ``maps`` has one row per (image_id, width, height, ch) with shift_y, shift_x, scale_y,
    scale_x, mirror_y, mirror_x and angle. Points whose four neighbours are not all inside the
    image take ``default``. A map's pixels come together in one row, which finds all neighbours in itself.
    """
    return _warped(_rasters(pixels).join(maps.select(*IMAGE, "ch", *WARP), [*IMAGE, "ch"]), size, default)


def augment(
    pixels: DataFrame,
    size: tuple[int, int],
    shift: tuple[float, float] = (0, 0),
    scale: tuple[float, float] = (1, 1),
    mirror: tuple[bool, bool] = (False, False),
    angle: float = 0.0,
    default: float = 0.0,
    seed: int = 0,
    fixed: bool = False,
) -> DataFrame:
    """Random shift, scale, mirror and rotation of every map, drawn from a seeded hash of its id.

    Shifts are uniform in [-s, s], scales s^u with u in [-1, 1], mirrors have odds 1/2 and angles
    are uniform in [-pi a, pi a]. With ``fixed`` the arguments themselves are applied.
    """
    def draw(name: str) -> Column:
        return hash_unit(seed, F.col("image_id"), F.col("ch"), name) * 2 - 1

    cols: dict[str, Column] = {}
    for at, axis in enumerate("yx"):
        s, z, m = float(shift[at]), float(scale[at]), bool(mirror[at])
        cols[f"shift_{axis}"] = F.lit(s) if fixed or s == 0 else draw(f"shift_{axis}") * s
        cols[f"scale_{axis}"] = F.lit(z) if fixed or z == 1 else F.pow(F.lit(z), draw(f"scale_{axis}"))
        cols[f"mirror_{axis}"] = F.lit(m) if fixed or not m else draw(f"mirror_{axis}") > 0
    turn = math.pi * float(angle)
    cols["angle"] = F.lit(turn) if fixed or turn == 0 else draw("angle") * turn
    # Draws depend on image and map alone, so they are columns of the rasters: one scan, one shuffle, no join.
    return _warped(_rasters(pixels).withColumns(cols), size, default)


def to_vectors(pixels: DataFrame) -> DataFrame:
    """(vec_id, vec): pixel values of each image, maps in order, row by row."""
    cell = F.struct("ch", "y", "x", F.col("v").cast("double").alias("v"))
    rows = pixels.groupBy("image_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select(
        F.col("image_id").alias("vec_id"), F.transform("cells", lambda c: c["v"]).alias("vec")
    )


def to_pixels(vectors: DataFrame, width: int, height: int) -> DataFrame:
    """The reverse of ``to_vectors`` for maps of one size."""
    area = width * height
    cells = vectors.select(F.col("vec_id").alias("image_id"), F.posexplode("vec").alias("p", "v"))
    return cells.select(
        "image_id",
        F.lit(width).alias("width"),
        F.lit(height).alias("height"),
        (F.floor(F.col("p") / area) + 1).cast("int").alias("ch"),
        (F.col("p") % width + 1).cast("int").alias("x"),
        (F.floor((F.col("p") % area) / width) + 1).cast("int").alias("y"),
        "v",
    )
