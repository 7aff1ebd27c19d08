"""Rule trees over metric columns: quality, culling, scenes, prices, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def log_sharpness(variance: Column) -> Column:
    """0 to 100 on a log scale that ends at a Laplacian variance of 2500."""
    return _clip(F.log1p(variance) / F.log1p(F.lit(2500.0)) * 100, 0.0, 100.0)


def exposure_status(mean: Column, p10: Column, p50: Column, p90: Column, shadow: Column, highlight: Column) -> Column:
    under = (p50 < 85) | (mean < 85) | (shadow > 14) | (p90 < 155)
    over = (p50 > 155) | (mean > 160) | (highlight > 10) | (p10 > 105)
    return F.when(under, "UNDER_EXPOSED").when(over, "OVER_EXPOSED").otherwise("GOOD")


def exposure_score(status: Column, mean: Column, p50: Column, shadow: Column, highlight: Column) -> Column:
    dark = F.greatest(F.lit(10.0), 100 - (90 - mean) * 1.6 - shadow * 1.5)
    bright = F.greatest(F.lit(10.0), 100 - (mean - 150) * 1.6 - highlight * 1.8)
    good = F.greatest(F.lit(55.0), 100 - F.abs(p50 - 125) * 0.5 - shadow * 0.6 - highlight * 0.8)
    return _clip(F.when(status == "UNDER_EXPOSED", dark).when(status == "OVER_EXPOSED", bright).otherwise(good), 0.0, 100.0)


def overall_quality(sharpness: Column, exposure: Column, p5: Column, p95: Column, blurred: Column) -> Column:
    span = _clip((p95 - p5) / 210 * 100, 0.0, 100.0)
    return (sharpness * 0.45 + exposure * 0.40 + span * 0.15) * F.when(blurred, 0.6).otherwise(1.0)


def cull(m: dict[str, Column]) -> Column:
    """struct(label, confidence) of the first rule that fits. m: faces, face_sharp, face_hires (-1: unknown), brightness, sharpness,
    focus, mean, exposure, eyes, candid, group_id, is_best."""
    face = m["faces"] > 0
    hires_known = m["face_hires"] >= 0
    detail = F.greatest(m["sharpness"], m["focus"])
    subject = F.when(face, m["face_sharp"]).otherwise(detail)
    ok = F.when(face & hires_known, (m["face_hires"] >= 36) & (m["face_sharp"] >= 38)).when(face, m["face_sharp"] >= 48).otherwise(detail >= 42)
    bad = F.when(face & hires_known, (m["face_hires"] < 30) | (m["face_hires"] < 36) & (m["face_sharp"] < 38)).when(face, m["face_sharp"] < 38).otherwise(detail < 34)
    unsure = ~ok & ~bad
    lit = face & (m["brightness"] > 0)  # a brightness of zero counts as unknown
    under, over = m["exposure"] == "UNDER_EXPOSED", m["exposure"] == "OVER_EXPOSED"
    black = F.when(lit, (m["brightness"] < 18) & (m["mean"] < 30)).otherwise(under & (m["mean"] < 22))
    white = F.when(lit, (m["brightness"] > 250) & (m["mean"] > 235)).otherwise(over & (m["mean"] > 238))
    doubtful = F.when(lit, (m["brightness"] < 45) | (m["brightness"] > 238)).otherwise(under & (m["mean"] < 40) | over & (m["mean"] > 220))
    very = bad & ((subject < 30) | face & hires_known & (m["face_hires"] < 25))
    grouped = F.coalesce(m["group_id"], F.lit("")) != ""
    best = F.coalesce(m["is_best"], F.lit(False))
    rules = [
        (bad | black | white, "REJECT", F.when(very, 95.0).otherwise(88.0)),
        (grouped & ~best, "SIMILAR", F.lit(92.0)),
        (grouped & unsure, "REVIEW", F.lit(74.0)),
        (grouped, "BEST", F.lit(96.0)),
        (unsure, "REVIEW", F.lit(70.0)),
        (face & (m["eyes"] == "CLOSED") & ~m["candid"], "REVIEW", F.lit(72.0)),
        (doubtful, "REVIEW", F.lit(68.0)),
    ]
    found = reduce(lambda acc, r: acc.when(r[0], F.struct(F.lit(r[1]).alias("label"), r[2].alias("confidence"))), rules[1:], F.when(rules[0][0], F.struct(F.lit(rules[0][1]).alias("label"), rules[0][2].alias("confidence"))))
    return found.otherwise(F.struct(F.lit("BEST").alias("label"), F.when(ok & (m["exposure"] == "GOOD"), 95.0).otherwise(90.0).alias("confidence")))


def scene(mean: Column, red: Column, blue: Column, position: Column) -> Column:
    """position: index in the shoot over its length."""
    warmth = red - blue
    return (
        F.when(mean < 85, "Reception & Sangeet")
        .when(warmth > 25, "Mandap & Ceremony")
        .when((mean > 145) & (blue > 120), "Outdoor Portraits")
        .when((position < 0.25) & (warmth > 10), "Bride Makeup")
        .when(position < 0.25, "Groom Preparation")
        .when(position > 0.70, "Stage & Couple Portraits")
        .otherwise("Mandap & Ceremony")
    )


def export_choice(categories: tuple[str, ...], effective: Column, client: Column) -> Column:
    """CLIENT_SELECTED has precedence; null if the photo is not exported."""
    first = F.when(client, "CLIENT_SELECTED") if "CLIENT_SELECTED" in categories else F.when(F.lit(False), "")
    return first.when(effective.isin(*categories), effective)


def export_folder(choice: Column, is_edited: Column) -> Column:
    return F.when(choice == "CLIENT_SELECTED", "Customer-Selected").when(choice.isin("BEST", "SELECTED"), F.when(is_edited, "AI-Edited").otherwise("AI-Selected")).when(choice == "REJECT", "Rejected").otherwise("Review")


#: What a customer is told about a coupon.
COUPON_UNKNOWN = "Invalid or expired coupon code"
COUPON_EXPIRED = "This coupon has expired"
COUPON_USED_UP = "This coupon has reached its usage limit"
COUPON_OTHER_PLAN = "This coupon is not valid for the %s plan"
COUPON_INACTIVE = "This referral code is no longer active"
COUPON_FIRST_ONLY = "Coupon codes work only on the first purchase. Please continue without the coupon."
NO_SUCH_PLAN = "Invalid plan or billing cycle"


def coupon_error(now: Column, plan: Column, c: dict[str, Column]) -> Column:
    """The first error of a coupon, or null. c: code (null: no such coupon), active, valid_until (0: none), max_uses (0: any), used, plans (csv, empty: all), agent_id, agent_status."""
    checks = (
        (c["code"].isNull() | (c["active"] == 0), F.lit(COUPON_UNKNOWN)),
        ((c["valid_until"] > 0) & (c["valid_until"] < now), F.lit(COUPON_EXPIRED)),
        ((c["max_uses"] > 0) & (c["used"] >= c["max_uses"]), F.lit(COUPON_USED_UP)),
        ((c["plans"] != "") & ~F.array_contains(F.split(c["plans"], ","), plan), F.format_string(COUPON_OTHER_PLAN, plan)),
        (c["agent_id"].isNotNull() & ~c["agent_status"].eqNullSafe("ACTIVE"), F.lit(COUPON_INACTIVE)),
    )
    return F.coalesce(*[F.when(fails, text) for fails, text in checks])


def raw_preset() -> list[Column]:
    """The edits exposure, temperature, tint ... as a raw converter's preset: exposure as it is, temperature in kelvin, the others whole, towards zero; what is not set has the converter's default."""
    whole = lambda name, default: F.round(F.coalesce(F.col(name).cast("double"), F.lit(default)), 6).cast("int")
    kelvin = (5500 + F.coalesce(F.col("temperature").cast("double"), F.lit(0.0)) * 25).cast("int")
    plain = [whole(k, 0.0).alias(k) for k in ("tint", "contrast", "highlights", "shadows", "whites", "blacks", "vibrance", "saturation")]
    return [F.round(F.coalesce("exposure", F.lit(0.0)), 4).alias("exposure"), kelvin.alias("temperature"), *plain, whole("sharpness", 15.0).alias("sharpness"), whole("noise_reduction", 10.0).alias("smoothing")]
