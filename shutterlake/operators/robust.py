"""Robust statistics by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.columns import rounded


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, weighted_median, deviation: the first value at which the weights reach half of their sum, and the mean weighted distance from it.

    Equal values are added up first, so the sort holds different values only.
    """
    cells = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys).orderBy(value)
    reach = cells.withColumns({"c": F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(Window.partitionBy(*keys))})
    medians = reach.where(F.col("c") >= F.col("all") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))
    spread = cells.join(medians, keys).groupBy(*keys, "weighted_median").agg((F.sum(F.abs(F.col(value) - F.col("weighted_median")) * F.col("w")) / F.sum("w")).alias("deviation"))
    return spread


def mad_std(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median, robust_std: 1.4826 times the median distance from the median."""
    medians = rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))
    far = rows.join(medians, keys).withColumn("far", F.abs(F.col(value) - F.col("median")))
    return far.groupBy(*keys, "median").agg((1.4826 * F.percentile("far", 0.5)).alias("robust_std"))


def harmonize(rows: DataFrame, keys: list[str], values: list[str], locked: Column, pull: float = 0.35) -> DataFrame:
    """values moved towards their group's median; groups of one and locked rows stay as they are. Null keys form a group."""
    middle = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.percentile(v, 0.5).alias(f"__{v}") for v in values])
    j = rows.join(middle.withColumnsRenamed({k: f"__k_{k}" for k in keys}), [rows[k].eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    blend = lambda v: F.when((F.col("__n") > 1) & ~locked, rounded(F.col(v) * (1 - pull) + F.col(f"__{v}") * pull, 1)).otherwise(F.col(v))
    return j.select(*[blend(c).alias(c) if c in values else F.col(c) for c in rows.columns])


def tile_focus(tiles: DataFrame, image: str, tile: str, value: str, share: float = 0.95) -> DataFrame:
    """image, focus_var: a percentile over the tiles of the variance within a tile."""
    variances = tiles.groupBy(image, tile).agg(F.var_pop(value).alias("v"))
    return variances.groupBy(image).agg(F.percentile("v", share).alias("focus_var"))
