"""Neighbourhood operators over tables of pixels.

pixels(image, x, y, channels...) are dealt to square tiles, each with the
pixels around it that a filter reads, and mirrored ones beyond the image's
border. Spark shuffles pixels once, by tile; a filter sees one tile, so memory
depends on the tile's size and not on the image's. Positions that an image lacks
count as zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.images import blend_weights

Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def image_sizes(pixels: DataFrame, key: str = "image") -> DataFrame:
    """key, width, height of each image."""
    return pixels.groupBy(key).agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))


def mirrored(at: Column, length: Column, halo: int, repeat_edge: bool) -> Column:
    """The places from -halo to length - 1 + halo at which the pixel shows, itself and its mirror images. Mirrors stand on the border pixel, or with repeat_edge behind it."""
    period = F.greatest(2 * length if repeat_edge else 2 * length - 2, F.lit(1))
    turns = F.sequence(-F.floor(F.lit(halo) / period) - 1, F.floor(F.lit(halo) / period) + 1)
    back = -at - 1 if repeat_edge else -at
    every = F.array_distinct(F.concat(F.transform(turns, lambda k: at + period * k), F.transform(turns, lambda k: back + period * k)))
    inside = F.filter(every, lambda p: (p >= -halo) & (p < length + halo))
    return F.when((at > halo) & (at < length - 1 - halo), F.array(at.cast("long"))).otherwise(inside)


def _places(at: Column, length: Column, halo: int, size: int, repeat_edge: bool) -> Column:
    """Each tile that reads a pixel, and where the pixel stands in the image for it."""

    def of(p: Column) -> Column:
        tiles = F.sequence(F.greatest(F.floor((p - halo) / size), F.lit(0)), F.least(F.floor((p + halo) / size), F.floor((length - 1) / size)))
        return F.transform(tiles, lambda t: F.struct(t.cast("int").alias("tile"), p.cast("int").alias("at")))

    return F.flatten(F.transform(mirrored(at, length, halo, repeat_edge), of))


def map_tiles(pixels: DataFrame, channels: tuple[str, ...], kernel: Kernel, outputs: tuple[str, ...], halo: int, size: int = 256, key: str = "image", repeat_edge: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """key, x, y and the outputs (double) of each pixel.

    kernel: channels by name, as arrays with `halo` more on each side, to
    outputs by name, with or without that halo. sizes(key, width, height) saves
    a pass over the pixels. Null channels count as zero.
    """
    dealt = pixels.select(key, "x", "y", *channels).join(sizes if sizes is not None else image_sizes(pixels, key), key)
    for axis, length in (("x", "width"), ("y", "height")):
        dealt = dealt.withColumn(f"__{axis}", F.explode(_places(F.col(axis), F.col(length), halo, size, repeat_edge)))
    dealt = dealt.select(key, "width", "height", *[F.col(f"__{a}.tile").alias(f"t{a}") for a in "xy"], *[F.col(f"__{a}.at").alias(f"p{a}") for a in "xy"], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c_{c}") for c in channels])
    schema = pixels.select(key).schema.add("x", "integer").add("y", "integer")
    for name in outputs:
        schema = schema.add(name, "double")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        left, top = (table[t][0].as_py() * size for t in ("tx", "ty"))
        w, h = (min(size, table[n][0].as_py() - a) for n, a in (("width", left), ("height", top)))
        row, column = np.asarray(table["py"]) - top + halo, np.asarray(table["px"]) - left + halo
        arrays = {}
        for c in channels:
            arrays[c] = np.zeros((h + 2 * halo, w + 2 * halo))
            arrays[c][row, column] = np.asarray(table[f"c_{c}"])
        made = kernel(arrays)
        flat = [np.ascontiguousarray(a if a.shape == (h, w) else a[halo : halo + h, halo : halo + w], float).ravel() for a in (made[n] for n in outputs)]
        y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
        keys = table[key].combine_chunks() if isinstance(table[key], pa.ChunkedArray) else table[key]
        return pa.table([keys.take(pa.array(np.zeros(h * w, np.int64))), pa.array(x + left, pa.int32()), pa.array(y + top, pa.int32()), *map(pa.array, flat)], names=[key, "x", "y", *outputs])

    return dealt.groupBy(key, "tx", "ty").applyInArrow(run, schema)


def tile_starts(length: Column, size: int, overlap: int) -> Column:
    """Where tiles start along a side: every size - overlap, and one that ends with the side."""
    last = F.greatest(length - size, F.lit(0))
    every = F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.element_at(every, -1) + size < length, F.concat(every, F.array(last))).otherwise(every)


def _holds(at: Column, size: int) -> Callable[[Column], Column]:
    return lambda start: (at >= start) & (at < start + size)


def overlap_add(pixels: DataFrame, channels: tuple[str, ...], kernel: Kernel, size: int = 512, overlap: int = 64, key: str = "image", sizes: DataFrame | None = None) -> DataFrame:
    """key, x, y, channels after the kernel on overlapping tiles, blended by half cosines over the overlaps and held within 0 to 255.

    The kernel sees arrays of size x size (smaller images are mirrored up to
    that) and may look at its tile as a whole: neighbouring tiles blend into
    each other without a seam. Tiles are added up by pixel with partial sums.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the tile")
    dealt = pixels.select(key, "x", "y", *channels).join(sizes if sizes is not None else image_sizes(pixels, key), key)
    for axis, length in (("x", "width"), ("y", "height")):
        dealt = dealt.withColumn(f"t{axis}", F.explode(F.filter(tile_starts(F.col(length), size, overlap), _holds(F.col(axis), size))))
    dealt = dealt.select(key, "width", "height", "tx", "ty", F.col("x").alias("px"), F.col("y").alias("py"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c_{c}") for c in channels])
    schema = pixels.select(key).schema.add("x", "integer").add("y", "integer").add("weight", "double")
    for name in channels:
        schema = schema.add(name, "double")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        left, top, width, height = (table[n][0].as_py() for n in ("tx", "ty", "width", "height"))
        w, h = min(size, width - left), min(size, height - top)
        arrays = {}
        for c in channels:
            a = np.zeros((h, w))
            a[np.asarray(table["py"]) - top, np.asarray(table["px"]) - left] = np.asarray(table[f"c_{c}"])
            arrays[c] = np.pad(a, ((0, size - h), (0, size - w)), "reflect") if (h, w) != (size, size) and (height > size or width > size) else a
        made = kernel(arrays)
        weight = np.outer(blend_weights(h, overlap, top == 0, top + size >= height), blend_weights(w, overlap, left == 0, left + size >= width))
        y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
        keys = table[key].combine_chunks()
        return pa.table([keys.take(pa.array(np.zeros(h * w, np.int64))), pa.array(x + left, pa.int32()), pa.array(y + top, pa.int32()), pa.array(weight.ravel()), *[pa.array((made[c][:h, :w] * weight).ravel()) for c in channels]], names=[key, "x", "y", "weight", *channels])

    added = dealt.groupBy(key, "tx", "ty").applyInArrow(run, schema).groupBy(key, "x", "y").agg(F.sum("weight").alias("weight"), *[F.sum(c).alias(c) for c in channels])
    return added.select(key, "x", "y", *[F.greatest(F.least(F.col(c) / F.greatest(F.col("weight"), F.lit(1e-5)), F.lit(255.0)), F.lit(0.0)).alias(c) for c in channels])


def guided_filter(pixels: DataFrame, guide: str, source: str, radius: int, eps: float, **options: object) -> DataFrame:
    """key, x, y, smooth: the source smoothed where the guide is flat, its edges kept."""
    from shutterlake.functions import kernels

    return map_tiles(pixels, tuple(dict.fromkeys((guide, source))), lambda a: {"smooth": kernels.guided(a[guide], a[source], radius, eps)}, ("smooth",), 2 * radius, repeat_edge=True, **options)


def masked_gaussian(pixels: DataFrame, source: str, mask: str, sigma: float, **options: object) -> DataFrame:
    """key, x, y, smooth: the blur of the source from the pixels that the mask shows."""
    from shutterlake.functions import kernels

    return map_tiles(pixels, (source, mask), lambda a: {"smooth": kernels.masked_blur(a[source], a[mask], sigma)}, ("smooth",), kernels.gaussian_radius(sigma), repeat_edge=True, **options)
