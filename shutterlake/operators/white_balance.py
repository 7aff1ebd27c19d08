"""Automatic white balance of images as tables of pixels.

pixels(image, x, y, r, g, b from 0 to 255) with two marks that may be there:
`apart` (0 to 1, what is no candidate for grey, such as faces) and `skin` (a
sample of cheeks and foreheads). Images are proxies of 900 pixels a side at
most, so one image is a bounded group.

Pixels are shuffled twice: to tiles, whose filters give each pixel its local
contrast and edges, and to their image, where all order statistics are windows
over one partitioning. What is left is one row per image.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import kernels
from shutterlake.functions.columns import let
from shutterlake.functions.pixels import clip
from shutterlake.operators.tiles import map_tiles

#: Weights of light in linear RGB, and the matrix from linear RGB to XYZ with the white it is divided by.
LIGHT = (0.2126, 0.7152, 0.0722)
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
#: The matrix and the polynomial of the colour temperature, its step and its range.
TO_XYZ_TEMPERATURE = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
TEMPERATURE, TEMPERATURE_STEP, TEMPERATURES = (449.0, 3525.0, 6823.3, 5520.33), 50.0, (1800.0, 15000.0)
#: Natural hue of skin in degrees, and how much of a warm cast stays.
SKIN_LEAST, SKIN_MOST, SKIN_BEST = 34.0, 47.0, 41.0
WARM_STAYS, WARM_STAYS_DARK, DARK_SCENE, COOL_PART, TINT_PART = 0.06, 0.15, 0.18, 0.88, 0.94


@dataclass(frozen=True)
class Limits:
    """What counts as a sample, and how sure it makes."""

    least_pixels: int = 500
    grey_share: float = 0.005
    least_grey: int = 200
    least_kept: int = 50
    grey_spread: float = 0.06
    full_grey: float = 400.0
    edge_power: float = 6.0
    patch_share: float = 0.99
    least_patch: int = 20
    least_marked: int = 30
    least_skin: int = 20
    colourful: float = 15.0
    colourful_share: float = 0.25
    dominant_share: float = 0.35


def linear(c: Column) -> Column:
    """A channel from 0 to 255 in linear light."""
    x = c / 255
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))


def gamma(c: Column) -> Column:
    """Linear light, held within 0 to 1, as a channel from 0 to 255."""
    x = clip(c, 0.0, 1.0)
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, 1 / 2.4) * 1.055 - 0.055) * 255


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """a and b of CIELAB, from linear RGB."""
    x, y, z = ((r * m[0] + g * m[1] + b * m[2]) / w for m, w in zip(TO_XYZ, WHITE, strict=True))
    root = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16 / 116)
    return (root(x) - root(y)) * 500, (root(y) - root(z)) * 200


def evenly(gains: list[Column]) -> list[Column]:
    """Gains that keep the light of white."""
    light = F.greatest(sum((g * w for g, w in zip(gains[1:], LIGHT[1:], strict=True)), gains[0] * LIGHT[0]), F.lit(1e-6))
    return [g / light for g in gains]


def _contrast(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The blurred channels, their mean contrast, how alike it is, and the edges of a wider blur."""
    halo = 12
    near = [kernels.blur(arrays[c], 1.0) for c in "rgb"]
    contrast = np.stack([np.abs(kernels.laplacian(kernels.blur(np.log(n + 1e-4), 1.0))) for n in near])
    mean = contrast.mean(0)
    unlike = kernels.box(contrast.std(0) / (mean + 1e-4), 3)
    wide = [kernels.blur(arrays[c], 2.0) for c in "rgb"]
    by = halo - kernels.gaussian_radius(2.0)
    out = {f"near_{c}": kernels.inner(n, halo - kernels.gaussian_radius(1.0)) for c, n in zip("rgb", near, strict=True)}
    out |= {f"edge_{c}": kernels.inner(kernels.edge_strength(w), by - 1) for c, w in zip("rgb", wide, strict=True)}
    return out | {"mean": kernels.inner(mean, 3), "unlike": unlike, "wide": kernels.inner(np.max(wide, 0), by)}


_OUT = ("near_r", "near_g", "near_b", "edge_r", "edge_g", "edge_b", "mean", "unlike", "wide")


def _chroma(light: list[Column]) -> Column:
    """Logarithms of red and blue over green; null if the light is."""
    return F.array(F.log(light[0] / light[1]), F.log(light[2] / light[1]))


def _of_chroma(red: Column, blue: Column) -> list[Column]:
    """Light of these logarithms over green, with a mean of 1."""
    mean = (F.exp(red) + 1 + F.exp(blue)) / 3
    return [F.exp(red) / mean, 1 / mean, F.exp(blue) / mean]


def _estimates(pixels: DataFrame, key: str, limits: Limits, size: int) -> DataFrame:
    """Each pixel in linear light with the estimates of its image: grey (chroma, confidence and count), edge, patch, scene median."""
    lin = pixels.select(key, "x", "y", *[linear(F.col(c)).alias(c) for c in "rgb"], ((F.col("r") + F.col("g") + F.col("b")) / 3).alias("level"), F.coalesce("apart", F.lit(0.0)).alias("apart"), F.coalesce("skin", F.lit(False)).alias("skin"))
    made = map_tiles(lin.withColumns({"s": F.col("skin").cast("double")}), ("r", "g", "b", "apart", "level", "s"), lambda a: _contrast(a) | {c: a[c] for c in ("r", "g", "b", "apart", "level", "s")}, (*_OUT, "r", "g", "b", "apart", "level", "s"), halo=12, size=size, key=key)
    whole = Window.partitionBy(key)
    open_ = F.col("apart") < 0.3

    # Grey pixels: those whose contrast is most alike in all channels.
    near = [F.col(f"near_{c}") for c in "rgb"]
    textured = (F.least(*near) > 0.02) & (F.greatest(*near) < 0.95) & (F.col("mean") > 0.04) & open_
    rows = made.withColumns({"textured": textured, "light": (near[0] + near[1] + near[2]) / 3})
    rows = rows.withColumns({"n_textured": F.count_if("textured").over(whole), "rank": F.rank().over(whole.orderBy(F.col("textured").desc(), "unlike"))})
    wanted = F.least(F.greatest(F.lit(limits.least_grey), F.floor(F.col("n_textured") * limits.grey_share)), F.col("n_textured") - 1)
    grey = F.col("textured") & (F.col("n_textured") >= limits.least_pixels) & (F.col("rank") <= wanted + 1)
    rows = rows.withColumn("quarter", F.percentile(F.when(grey, F.col("light")), F.lit(0.25)).over(whole))
    rows = rows.withColumn("grey", F.when(grey & (F.col("light") > F.col("quarter")), F.col("light")))
    total = F.greatest(near[0] + near[1] + near[2], F.lit(1e-4))
    is_grey = F.col("grey").isNotNull()
    rows = rows.withColumns({f"ch_{c}": F.when(is_grey, n / total) for c, n in zip("rgb", near, strict=True)})
    rows = rows.withColumns({f"mid_{c}": F.percentile(f"ch_{c}", F.lit(0.5)).over(whole) for c in "rgb"})
    far = sum((F.abs(F.col(f"ch_{c}") - F.col(f"mid_{c}")) for c in "gb"), F.abs(F.col("ch_r") - F.col("mid_r")))
    rows = rows.withColumns({"n_grey": F.count("grey").over(whole), "spread": F.percentile(far, F.lit(0.5)).over(whole)})
    rows = rows.withColumns({f"grey_{c}": F.sum(F.col(f"ch_{c}") * F.col("grey")).over(whole) / F.sum("grey").over(whole) for c in "rgb"})

    # Edges: their power mean. The brightest patch: its median.
    edgy = open_ & (F.col("wide") < 0.95)
    power = limits.edge_power
    rows = rows.withColumns({f"edges_{c}": F.when(F.count_if(edgy).over(whole) >= limits.least_pixels, F.pow(F.avg(F.when(edgy, F.pow(F.col(f"edge_{c}"), power))).over(whole), 1 / power)) for c in "rgb"})
    bright = (F.col("r") + F.col("g") + F.col("b")) / 3
    lit = open_ & (F.greatest("r", "g", "b") < 0.97)
    rows = rows.withColumns({"n_lit": F.count_if(lit).over(whole), "top": F.percentile(F.when(lit, bright), F.lit(limits.patch_share)).over(whole)})
    patch = lit & (bright >= F.col("top")) & (F.col("n_lit") >= limits.least_pixels)
    rows = rows.withColumns({"n_patch": F.count_if(patch).over(whole), **{f"patch_{c}": F.percentile(F.when(patch, F.col(c)), F.lit(0.5)).over(whole) for c in "rgb"}})

    enough = F.col("n_grey") >= limits.least_kept
    confidence = F.when(enough, clip(1 - F.col("spread") / limits.grey_spread, 0.0, 1.0) * clip(F.col("n_grey") / limits.full_grey, 0.2, 1.0)).otherwise(0.0)
    grey_light, edge_light, patch_light = ([F.col(f"{n}_{c}") for c in "rgb"] for n in ("grey", "edges", "patch"))
    rows = rows.withColumns({
        "from_grey": F.when(confidence > 0.05, _chroma(grey_light)),
        "from_edges": F.when(F.least(*edge_light) > 1e-6, _chroma(edge_light)),
        "from_patch": F.when((F.col("n_patch") >= limits.least_patch) & (F.least(*patch_light) > 1e-6), _chroma(patch_light)),
        "n_grey": F.when(enough, F.col("n_grey")).otherwise(0),
    })
    rows = rows.withColumn("found", F.array_compact(F.array("from_grey", "from_edges", "from_patch")))
    n = F.size("found")
    middle = lambda i: let(F.array_sort(F.transform("found", lambda e: e[i])), lambda s: F.when(n == 3, F.get(s, F.lit(1))).when(n == 2, (F.get(s, F.lit(0)) + F.get(s, F.lit(1))) / 2).when(n == 1, F.get(s, F.lit(0))).otherwise(0.0))
    apart = F.array_max(F.flatten(F.transform("found", lambda a: F.transform("found", lambda b: F.hypot(a[0] - b[0], a[1] - b[1])))))
    sure = F.when(n >= 2, clip(F.exp(-apart / 0.25) * 0.55 + 0.45, 0.0, 1.0)).when(n == 1, 0.3).otherwise(0.0)
    return rows.withColumns({"chroma_r": middle(0), "chroma_b": middle(1), "sure": sure})


def analyze(pixels: DataFrame, key: str = "image", limits: Limits = Limits(), size: int = 256) -> DataFrame:  # noqa: B008
    """One row per image: key, gains (r, g, b), confidence, kelvin, cast, grey_pixels, skin_before, skin_after, skin_note, dominant.

    Three estimates of the light (grey pixels, edges, the brightest patch) agree
    more or less; a scene of one colour halves the trust in them. Skin in its
    natural range holds back what would move it out; skin out of range pulls the
    gains towards it. Warm casts stay in part. An image without enough pixels is
    left as it is. Missing marks (apart, skin) count as none.
    """
    for name, kind in (("apart", "double"), ("skin", "boolean")):
        if name not in pixels.columns:
            pixels = pixels.withColumn(name, F.lit(None).cast(kind))
    rows = _estimates(pixels, key, limits, size)
    whole = Window.partitionBy(key)

    # Columns of their own, not arrays: Spark writes arrays that are only indexed into each of their many uses.
    first = [1 / F.greatest(c, F.lit(1e-3)) for c in _of_chroma(F.col("chroma_r"), F.col("chroma_b"))]
    rows = rows.withColumns({f"first_{c}": g for c, g in zip("rgb", first, strict=True)})
    rows = rows.withColumns({f"even_{c}": clip(F.col(c) * g, 0.0, 1.0) for c, g in zip("rgb", evenly([F.col(f"first_{c}") for c in "rgb"]), strict=True)})
    a, b = lab(*[F.col(f"even_{c}") for c in "rgb"])
    rows = rows.withColumns({"lab_a": a, "lab_b": b})
    colourful = (F.hypot("lab_a", "lab_b") > limits.colourful) & (F.col("apart") < 0.3)
    hue = F.pmod(F.floor(F.pmod(F.degrees(F.atan2("lab_b", "lab_a")) + 360, F.lit(360.0)) / 30).cast("int"), F.lit(12))
    # Skin: what is neither its brightest tenth nor its darkest part.
    skin = F.col("s") > 0.5
    rows = rows.withColumns({"low": F.percentile(F.when(skin, F.col("level")), F.lit(0.15)).over(whole), "high": F.percentile(F.when(skin, F.col("level")), F.lit(0.90)).over(whole), "hue": F.when(colourful, hue)})
    sample = skin & F.col("level").between(F.col("low"), F.col("high"))
    one = [F.first(c).alias(c) for c in ("chroma_r", "chroma_b", "sure", "n_grey")]
    bins = [F.count_if(F.col("hue") == k).alias(f"h{k}") for k in range(12)]
    medians = [F.percentile(F.when(sample, F.col(c)), F.lit(0.5)).alias(f"skin_{c}") for c in "rgb"]
    image = rows.groupBy(key).agg(*one, *bins, *medians, F.count_if(sample).alias("n_skin"), F.count_if(skin).alias("n_marked"), F.count(F.lit(1)).alias("n"), (F.percentile("level", F.lit(0.5)) / 255).alias("scene"))

    count = [F.col(f"h{k}") for k in range(12)]
    dominant = (sum(count[1:], count[0]) / F.col("n") > limits.colourful_share) & (F.greatest(*[count[k] + count[k - 1] for k in range(12)]) / F.col("n") > limits.dominant_share)
    image = image.withColumn("dominant", dominant).withColumn("sure", F.col("sure") * F.when(F.col("dominant"), 0.5).otherwise(1.0))
    image = image.withColumns({f"light_{c}": x for c, x in zip("rgb", _of_chroma(F.col("chroma_r"), F.col("chroma_b")), strict=True)})
    full = evenly([1 / F.greatest(F.col(f"light_{c}"), F.lit(1e-3)) for c in "rgb"])
    image = image.withColumns({f"g_{c}": F.log(clip(g, 0.62, 1.6)) * F.col("sure") for c, g in zip("rgb", full, strict=True)})
    return _strength(_held_by_skin(image, limits), key)


def skin_hue(gains: list[Column]) -> Column:
    """Hue in degrees of the skin's median after gains, given as logarithms."""
    a, b = lab(*[clip(F.col(f"skin_{c}") * F.exp(g), 0.0, 1.0) for c, g in zip("rgb", gains, strict=True)])
    return F.degrees(F.atan2(b, a))


def _held_by_skin(image: DataFrame, limits: Limits) -> DataFrame:
    """Gains g (logarithms) after the veto of natural skin, and after the search for gains that make it natural."""
    natural = lambda hue: hue.between(SKIN_LEAST, SKIN_MOST)
    off = lambda hue: F.abs(hue - SKIN_BEST)
    g = [F.col(f"g_{c}") for c in "rgb"]
    has = (F.col("n_skin") >= limits.least_skin) & (F.col("n_marked") >= limits.least_marked)
    image = image.withColumns({"skin_before": F.when(has, skin_hue([F.lit(0.0)] * 3)), "hue": F.when(has, skin_hue(g))})
    # The parts of a correction that are tried, until one leaves natural skin about as it was.
    bound = off(F.col("skin_before")) + 3
    part = F.lit(0.0)
    for k in (0.15, 0.35, 0.6):
        part = F.when(off(skin_hue([x * k for x in g])) <= bound, k).otherwise(part)
    vetoed = F.coalesce(natural(F.col("skin_before")) & (off(F.col("hue")) > bound), F.lit(False))
    image = image.withColumn("vetoed", vetoed).withColumn("part", F.when(F.col("vetoed"), part).otherwise(1.0))
    image = image.withColumns({f"g_{c}": F.col(f"g_{c}") * F.col("part") for c in "rgb"}).withColumn("hue", F.when(has, skin_hue(g)))

    # 15 steps of temperature, 9 of tint, tried in this order where skin is out of range.
    steps = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(n)).alias("n")) for t in np.linspace(-0.35, 0.35, 15) for n in np.linspace(-0.2, 0.2, 9)])

    def scored(step: Column, place: Column) -> Column:
        moved = [g[0] - step["t"] / 2, g[1] + step["n"], g[2] + step["t"] / 2]
        far = (F.abs(moved[0] - g[0]) + F.abs(moved[1] - g[1]) + F.abs(moved[2] - g[2])) * 6

        def cost(now: Column) -> Column:
            out = F.when(natural(now), 0.0).otherwise(F.least(F.abs(now - SKIN_LEAST), F.abs(now - SKIN_MOST)))
            return out * 4 + off(now) * 0.15 + far

        return F.struct(let(skin_hue(moved), cost).alias("cost"), place.alias("place"), *[m.alias(c) for m, c in zip(moved, "rgb", strict=True)])

    image = image.withColumn("best", F.when(~natural(F.col("hue")), F.array_min(F.transform(steps, scored))))
    better = F.col("best.cost") < off(F.col("hue"))
    note = F.when(natural(F.col("hue")), "natural").when(F.col("hue").isNotNull(), "corrected")
    return image.withColumns({**{f"g_{c}": F.when(better, F.col(f"best.{c}")).otherwise(F.col(f"g_{c}")) for c in "rgb"}, "skin_note": F.when(F.col("vetoed"), F.concat(F.lit("veto, "), note)).otherwise(note)})


def _strength(image: DataFrame, key: str) -> DataFrame:
    """The part of the correction that is applied, and what it says of the light."""
    image = image.withColumns({f"g_{c}": F.exp(f"g_{c}") for c in "rgb"})
    image = image.withColumns({f"e_{c}": F.log(x) for c, x in zip("rgb", evenly([F.col(f"g_{c}") for c in "rgb"]), strict=True)})
    e = [F.col(f"e_{c}") for c in "rgb"]
    image = image.withColumns({"cooling": (e[2] - e[0]) / 2, "tint": (e[1] - (e[0] + e[2]) / 2) * TINT_PART})
    stays = F.when(F.col("scene") < DARK_SCENE, WARM_STAYS_DARK).otherwise(WARM_STAYS)
    image = image.withColumn("cooled", F.col("cooling") * F.when(F.col("cooling") > 0, 1 - stays).otherwise(COOL_PART))
    cooled, tint = F.col("cooled"), F.col("tint")
    image = image.withColumns({"g_r": F.exp(-cooled - tint / 3), "g_g": F.exp(tint * 2 / 3), "g_b": F.exp(cooled - tint / 3)})
    image = image.withColumns({f"gain_{c}": x for c, x in zip("rgb", evenly([F.col(f"g_{c}") for c in "rgb"]), strict=True)})
    r, g, b = (F.col(f"gain_{c}") for c in "rgb")
    warm = F.when(b > r * 1.06, "warm (yellow/orange)").when(r > b * 1.06, "cool (blue)")
    hue = F.when(g < (r + b) / 2 * 0.96, "green").when(g > (r + b) / 2 * 1.04, "magenta")
    cast = F.coalesce(F.concat(F.nullif(F.concat_ws(" + ", warm, hue), F.lit("")), F.lit(" cast")), F.lit("neutral"))
    light = [F.col(f"light_{c}") for c in "rgb"]
    x, y, z = (light[0] * m[0] + light[1] * m[1] + light[2] * m[2] for m in TO_XYZ_TEMPERATURE)
    image = image.withColumn("p", (x / (x + y + z) - 0.3320) / (F.lit(0.1858) - y / (x + y + z)))
    p = F.col("p")
    kelvin = ((p * TEMPERATURE[0] + TEMPERATURE[1]) * p + TEMPERATURE[2]) * p + TEMPERATURE[3]
    kelvin = clip(F.rint(kelvin / TEMPERATURE_STEP) * TEMPERATURE_STEP, *TEMPERATURES).cast("int")
    after = F.when(F.col("skin_before").isNotNull(), skin_hue([F.log(x) for x in (r, g, b)]))
    return image.select(key, F.array(*[F.round(x, 4) for x in (r, g, b)]).alias("gains"), F.round("sure", 2).alias("confidence"), F.when(F.col("sure") > 0.05, kelvin).alias("kelvin"), cast.alias("cast"), F.col("n_grey").cast("long").alias("grey_pixels"), F.round("skin_before", 1).alias("skin_before"), F.round(after, 1).alias("skin_after"), "skin_note", "dominant")


def effective_gains(gains: Column, strength: Column, enabled: Column) -> Column:
    """Gains at a strength in percent (0 to 150, missing: 100); null where there is nothing to do: not enabled, no three gains, or all within 0.004 of 1."""
    k = clip(F.coalesce(strength, F.lit(100.0)), 0.0, 150.0) / 100
    some = F.array(*evenly([F.exp(F.log(clip(F.get(gains, F.lit(i)), 0.3, 3.0)) * k) for i in range(3)]))
    ok = F.coalesce(enabled, F.lit(True)) & (F.size(gains) == 3)
    return F.when(ok, let(some, lambda s: F.when(F.exists(s, lambda v: F.abs(v - 1) > 0.004 + 1e-5), s)))


def balanced_in_light(channel: Column, gain: Column) -> Column:
    """A channel from 0 to 255 after a gain in linear light; what gets brighter than nine tenths rolls off. A null gain changes nothing."""
    x = linear(clip(channel, 0.0, 255.0)) * gain
    return F.when(gain.isNull(), channel).otherwise(gamma(F.when(x > 0.9, F.tanh((x - 0.9) / 0.1) * 0.1 + 0.9).otherwise(x)))
