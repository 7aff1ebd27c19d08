"""Colour operators over tables of pixels (r, g, b from 0 to 255), as Column expressions: Spark plans them, no image library is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of luma, and of the colour differences from it.
LUMA = (0.299, 0.587, 0.114)
CR_WEIGHT, CB_WEIGHT = 0.713, 0.564
#: The chroma of skin, the least share of skin pixels, and what stands for no skin.
SKIN_CR, SKIN_CB, SKIN_SHARE, NO_SKIN = (133, 173), (77, 127), 0.02, (145.0, 105.0)
#: The change of red, green and blue at full temperature or tint.
WARM_RED, WARM_BLUE, TINT_GREEN = 0.18, -0.24, -0.16
#: Share of the missing saturation that full vibrance adds, and how much skin is spared.
VIBRANCE, SPARED = 0.40, 0.70
#: Fixed values of the relighting: brightness aimed at, least and most gain and weight of subject and background;
#: a background is dark below this brightness, or below this part of a subject brighter than that.
SUBJECT_ZONE, GROUND_ZONE = (135.0, 1.0, 1.15, 0.18), (110.0, 0.98, 1.12, 0.15)
DARK_GROUND, DARK_RATIO, LIT_SUBJECT, LEAST_LIGHT = 58.0, 1.35, 45.0, 30.0
#: Fixed values of the subject light: luma at which its weight starts to turn, over which span, and the part that turns.
LIGHT_FROM, LIGHT_SPAN, LIGHT_PART = 0.40, 0.45, 0.65
#: Fixed values of the vignette: where it starts, over which span, and how dark it gets.
EDGE_FROM, EDGE_SPAN, EDGE_DEPTH = 0.55, 0.45, 0.18


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def smoothstep(x: Column, start: float, span: float) -> Column:
    """0 up to start, 1 from start + span, an S between them."""
    t = clip((x - start) / span, 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Cr and Cb, rounded and held within 0 to 255."""
    y = luma(r, g, b)
    return tuple(clip(F.round((c - y) * w + 128), 0.0, 255.0) for c, w in ((r, CR_WEIGHT), (b, CB_WEIGHT)))


def skin_chroma(pixels: DataFrame, key: str) -> DataFrame:
    """pixels(key, r, g, b) -> key, has_skin, coverage, cr, cb: the mean chroma of skin where it covers enough of the image. One aggregate with partial results."""
    cr, cb = chroma(F.col("r"), F.col("g"), F.col("b"))
    skin = F.col("cr").between(*SKIN_CR) & F.col("cb").between(*SKIN_CB)
    found = pixels.select(key, cr.alias("cr"), cb.alias("cb")).groupBy(key).agg((F.count_if(skin) / F.count(F.lit(1))).alias("share"), F.avg(F.when(skin, F.col("cr"))).alias("cr"), F.avg(F.when(skin, F.col("cb"))).alias("cb"))
    has = F.col("share") > SKIN_SHARE
    return found.select(key, has.alias("has_skin"), F.when(has, F.col("share")).otherwise(0.0).alias("coverage"), *[F.when(has, F.col(c)).otherwise(x).alias(c) for c, x in zip(("cr", "cb"), NO_SKIN, strict=True)])


def balanced(r: Column, g: Column, b: Column, temperature: Column, tint: Column) -> list[Column]:
    """Channels after temperature and tint, each from -100 to 100; amounts within 0.1 do nothing."""
    warm, green = (F.when(F.abs(x) > 0.1, x / 100).otherwise(0.0) for x in (temperature, tint))
    return [clip(c * (1 + amount * weight), 0.0, 255.0) for c, amount, weight in ((r, warm, WARM_RED), (g, green, TINT_GREEN), (b, warm, WARM_BLUE))]


def vibrant(saturation: Column, skin: Column, vibrance: Column, more: Column) -> Column:
    """Saturation (given from 0 to 1) from 0 to 255 after vibrance, which lifts what is pale and spares skin (0 to 1), and then plain saturation."""
    lifted = saturation + F.when(F.abs(vibrance) > 0.1, (1 - saturation) * (vibrance / 100 * VIBRANCE) * (1 - skin * SPARED)).otherwise(0.0)
    return clip(lifted * F.when(F.abs(more) > 0.1, (100 + more) / 100).otherwise(1.0) * 255, 0.0, 255.0)


def zone_gains(pixels: DataFrame, key: str) -> DataFrame:
    """pixels(key, r, g, b, mask) -> key, subject, ground (gains less one, weighted), both 0 where the background is dark: the subject stands out already."""
    y = luma(F.col("r"), F.col("g"), F.col("b"))
    part = lambda w: F.coalesce(F.sum(y * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0))
    light = pixels.groupBy(key).agg(part(F.col("mask")).alias("s"), part(1 - F.col("mask")).alias("g"))
    s, g = F.col("s"), F.col("g")
    dark = (g < DARK_GROUND) | (s / F.greatest(g, F.lit(1.0)) > DARK_RATIO) & (s > LIT_SUBJECT)
    gain = lambda x, z: F.when(dark, 0.0).otherwise((clip(z[0] / F.greatest(x, F.lit(LEAST_LIGHT)), z[1], z[2]) - 1) * z[3])
    return light.select(key, gain(s, SUBJECT_ZONE).alias("subject"), gain(g, GROUND_ZONE).alias("ground"))


def relit(pixels: DataFrame, key: str) -> DataFrame:
    """pixels with r, g, b after zone_gains of their image, blended by the mask. The gains are one row per image."""
    j = pixels.join(zone_gains(pixels, key), key)
    gain = 1 + F.col("mask") * F.col("subject") + (1 - F.col("mask")) * F.col("ground")
    return j.withColumns({c: clip(F.col(c) * gain, 0.0, 255.0) for c in "rgb"}).select(*pixels.columns)


def subject_light(y: Column, mask: Column, ev: Column) -> Column:
    """Gain of a pixel for ev stops on the subject: darkening acts most on what is bright, brightening spares it."""
    turned = LIGHT_PART * smoothstep(y / 255, LIGHT_FROM, LIGHT_SPAN)
    weight = F.when(ev > 0, 1 - turned).otherwise(1 - LIGHT_PART + turned)
    return F.when(F.abs(ev) > 0.01, 1 + clip(mask, 0.0, 1.0) * weight * (F.pow(F.lit(2.0), ev) - 1)).otherwise(1.0)


def vignette(distance: Column, strength: Column) -> Column:
    """Gain at a distance from the centre, as a share of the farthest corner's."""
    return 1 - smoothstep(distance, EDGE_FROM, EDGE_SPAN) * strength * EDGE_DEPTH
