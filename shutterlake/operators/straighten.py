"""Straighten angle of images from votes for straight lines.

Edge pixels vote for the lines they may lie on, by tilt and distance from the
corner; only tilts that would be corrected are voted for. Votes are a grouped
count with partial sums, so neither an image nor a line is one task. Lines are
peaks of the votes; long ones that agree give the angle.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, radians, sin

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import kernels
from shutterlake.operators.tiles import image_sizes, map_tiles


@dataclass(frozen=True)
class LineRules:
    """Which lines count, how well they must agree, and what is corrected. Tilts in degrees; lengths as shares of the image's side."""

    edge: float = 160.0
    most_tilt: float = 5.0
    step: float = 0.5
    least_votes: int = 80
    least_lines: int = 3
    vertical_total: float = 1.2
    horizontal_total: float = 1.5
    horizontal_length: float = 0.35
    most_spread: float = 0.8
    least_angle: float = 0.5
    most_angle: float = 3.0


def edge_pixels(pixels: DataFrame, channel: str, least: float, key: str = "image", size: int = 256) -> DataFrame:
    """key, x, y of pixels whose gradient, after a slight blur, is at least so long."""
    smooth = np.array([0.25, 0.5, 0.25])
    made = map_tiles(pixels, (channel,), lambda a: {"edge": kernels.edge_strength(kernels.along(kernels.along(a[channel], smooth, 0), smooth, 1))}, ("edge",), 2, size=size, key=key)
    return made.where(F.col("edge") >= least).select(key, "x", "y")


def line_votes(edges: DataFrame, rules: LineRules = LineRules(), key: str = "image") -> DataFrame:  # noqa: B008
    """key, upright, tilt (in steps), rho, votes. A line of tilt t leans counter-clockwise by t: upright ones move right on their way down, level ones rise to the right."""
    steps = round(rules.most_tilt / rules.step)
    turns = [(t, cos(radians(t * rules.step)), sin(radians(t * rules.step))) for t in range(-steps, steps + 1)]
    table = F.array(*[F.struct(F.lit(up).alias("upright"), F.lit(t).alias("tilt"), F.lit(c).alias("c"), F.lit(s).alias("s")) for up in (True, False) for t, c, s in turns])
    votes = edges.select(key, "x", "y", F.explode(table).alias("v"))
    across = F.when(F.col("v.upright"), F.col("x") * F.col("v.c") - F.col("y") * F.col("v.s")).otherwise(F.col("y") * F.col("v.c") + F.col("x") * F.col("v.s"))
    return votes.groupBy(key, "v.upright", "v.tilt", F.round(across).cast("int").alias("rho")).agg(F.count(F.lit(1)).alias("votes"))


def lines(votes: DataFrame, least_votes: int, key: str = "image") -> DataFrame:
    """Peaks: votes that no neighbour by tilt or distance exceeds; of equal neighbours the first by tilt and distance. The votes are the line's length."""
    strong = votes.where(F.col("votes") >= least_votes)
    spot = F.struct("votes", (-F.col("tilt")).alias("t"), (-F.col("rho")).alias("r"))
    around = F.array(*[F.struct(F.lit(dt).alias("dt"), F.lit(dr).alias("dr")) for dt in (-1, 0, 1) for dr in (-1, 0, 1)])
    told = strong.withColumn("spot", spot).withColumn("o", F.explode(around))
    best = told.groupBy(key, "upright", (F.col("tilt") + F.col("o.dt")).alias("tilt"), (F.col("rho") + F.col("o.dr")).alias("rho")).agg(F.max("spot").alias("best"))
    return strong.withColumn("spot", spot).join(best, [key, "upright", "tilt", "rho"]).where(F.col("spot") == F.col("best")).select(key, "upright", "tilt", "rho", "votes")


def agreed_tilt(found: DataFrame, sizes: DataFrame, rules: LineRules = LineRules(), key: str = "image") -> DataFrame:  # noqa: B008
    """lines(key, upright, tilt in degrees, length), sizes(key, width, height) -> key, upright, tilt where enough long lines agree: their median by length, if they spread little about it."""
    counted = found.join(sizes, key).where(F.col("upright") | (F.col("length") >= F.col("width") * rules.horizontal_length)).where(F.abs("tilt") <= rules.most_tilt)
    family = Window.partitionBy(key, "upright")
    total = F.sum("length").over(family)
    so_far = F.sum("length").over(family.orderBy("tilt").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = counted.withColumns({"total": total, "n": F.count(F.lit(1)).over(family), "so_far": so_far})
    rows = rows.withColumn("median", F.min(F.when(F.col("so_far") >= F.col("total") / 2, F.col("tilt"))).over(family))
    spread = F.sum(F.abs(F.col("tilt") - F.col("median")) * F.col("length")) / F.sum("length")
    side = F.when(F.col("upright"), F.col("height") * rules.vertical_total).otherwise(F.col("width") * rules.horizontal_total)
    agreed = rows.groupBy(key, "upright").agg(F.first("median").alias("tilt"), spread.alias("spread"), F.first("n").alias("n"), F.first("total").alias("total"), F.first(side).alias("least"))
    return agreed.where((F.col("n") >= rules.least_lines) & (F.col("total") >= F.col("least")) & (F.col("spread") <= rules.most_spread)).select(key, "upright", "tilt")


def correction(tilt: Column, rules: LineRules) -> Column:
    """The angle that undoes a tilt: nothing for a small or missing one, at most so much."""
    turned = F.round(F.greatest(F.least(-tilt, F.lit(rules.most_angle)), F.lit(-rules.most_angle)), 1)
    return F.when(F.abs(tilt) >= rules.least_angle, turned).otherwise(0.0)


def straighten_angles(pixels: DataFrame, channel: str = "grey", rules: LineRules = LineRules(), key: str = "image", size: int = 256) -> DataFrame:  # noqa: B008
    """pixels(key, x, y, channel from 0 to 255) -> key, angle, n_lines: the angle that straightens each image.

    Upright lines count before level ones, which perspective tilts. Images
    without enough lines get 0. Null pixels count as black.
    """
    sizes = image_sizes(pixels, key)
    found = lines(line_votes(edge_pixels(pixels, channel, rules.edge, key, size), rules, key), rules.least_votes, key)
    found = found.select(key, "upright", (F.col("tilt") * rules.step).alias("tilt"), F.col("votes").alias("length"))
    tilts = agreed_tilt(found, sizes, rules, key).groupBy(key).agg(F.max_by("tilt", "upright").alias("tilt"))
    n = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"))
    return sizes.join(tilts, key, "left").join(n, key, "left").select(key, correction(F.col("tilt"), rules).alias("angle"), F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"))
