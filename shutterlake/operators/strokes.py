"""Brush strokes on masks: the strokes that stand after undo and redo, and the mask they paint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.tiles import mirrored

#: The least radius in pixels, and the softness up to which a stroke's edge stays hard.
LEAST_RADIUS, HARD = 2, 0.05


def standing_strokes(log: DataFrame, key: str = "image") -> DataFrame:
    """log(key, seq, action) -> key, seq, place of the strokes that stand: `add` puts one on, `undo` takes the last one off, `redo` puts it back unless one was added since, `clear` takes all.

    Other and null actions do nothing, nor does undo or redo without a stroke.
    Only what follows the last clear is folded, one array of an image's numbers.
    """
    acts = log.where(F.col("action").isin("add", "undo", "redo", "clear")).select(key, "seq", "action")
    last = acts.where("action = 'clear'").groupBy(key).agg(F.max("seq").alias("__clear"))
    later = acts.join(last, key, "left").where(F.col("__clear").isNull() | (F.col("seq") > F.col("__clear")))
    arrays = later.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "action"))).alias("a"))
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("done"), none.alias("undone"))

    def moved(source: Column, target: Column) -> tuple[Column, Column]:
        some = F.size(source) > 0
        return F.when(some, F.slice(source, F.lit(1), F.greatest(F.size(source) - 1, F.lit(0)))).otherwise(source), F.when(some, F.array_append(target, F.element_at(source, -1))).otherwise(target)

    def step(state: Column, act: Column) -> Column:
        done, undone = state["done"], state["undone"]
        back, off = moved(done, undone)
        rest, on = moved(undone, done)
        stacks = {"add": (F.array_append(done, act["seq"]), none), "undo": (back, off), "redo": (on, rest)}
        chosen = F.when(F.lit(False), start)
        for action, (d, u) in stacks.items():
            chosen = chosen.when(act["action"] == action, F.struct(d.alias("done"), u.alias("undone")))
        return chosen.otherwise(state)

    folded = F.aggregate("a", start, step, lambda s: s["done"])
    return arrays.select(key, F.posexplode(folded).alias("place", "seq")).select(key, "seq", "place")


def covered_pixels(strokes: DataFrame, key: str = "image") -> DataFrame:
    """strokes(key, place, points array<struct<x, y>> as shares of the sides, radius as share of the shorter side, width, height, ...) -> key, place, x, y, r: the pixels within the radius of a stroke's path."""
    at = lambda v, n: F.floor(F.greatest(F.least(v * n, n - 1), F.lit(0)))
    r = F.greatest(F.lit(LEAST_RADIUS), F.floor(F.col("radius") * F.least("width", "height"))).cast("int")
    spots = F.transform("points", lambda p: F.struct(at(p["x"], F.col("width")).alias("x"), at(p["y"], F.col("height")).alias("y")))
    rows = strokes.select(key, "place", "width", "height", r.alias("r"), spots.alias("spots")).where(F.size("spots") > 0)
    parts = F.transform("spots", lambda p, i: F.struct(F.get("spots", F.greatest(i - 1, F.lit(0))).alias("a"), p.alias("b")))
    rows = rows.select(key, "place", "width", "height", "r", F.explode(parts).alias("part"))
    a, b = F.col("part.a"), F.col("part.b")
    for axis, length in (("y", "height"), ("x", "width")):
        low, high = F.least(a[axis], b[axis]) - F.col("r"), F.greatest(a[axis], b[axis]) + F.col("r")
        rows = rows.withColumn(axis, F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.col(length) - 1))))
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    along = F.greatest(F.least(F.coalesce(((F.col("x") - a["x"]) * dx + (F.col("y") - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    far = F.pow(F.col("x") - a["x"] - dx * along, 2) + F.pow(F.col("y") - a["y"] - dy * along, 2)
    return rows.where(far <= F.col("r") * F.col("r") + 1e-9).select(key, "place", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "r").distinct()


def _soften(cover: DataFrame, key: str) -> DataFrame:
    """cover(key, place, x, y, v, r, sigma, width, height) blurred along both sides; the canvas is mirrored at its borders."""
    for axis, length in (("x", "width"), ("y", "height")):
        weights = F.transform(F.sequence(-F.col("r"), F.col("r")), lambda d: F.struct(d.alias("d"), F.exp(-d * d / (F.col("sigma") * F.col("sigma") * 2)).alias("w")))
        spread = cover.withColumn("__w", weights).withColumn("__all", F.expr("aggregate(__w, 0D, (t, e) -> t + e.w)"))
        spread = spread.withColumn("__p", F.explode(mirrored(F.col(axis), F.col(length), F.col("r"), False))).withColumn("__e", F.explode("__w"))
        place = (F.col("__p") + F.col("__e.d")).cast("int")
        cover = spread.withColumn(axis, place).where((place >= 0) & (place < F.col(length))).groupBy(key, "place", "x", "y", "r", "sigma", "width", "height").agg(F.sum(F.col("v") * F.col("__e.w") / F.col("__all")).alias("v"))
    return cover


def painted_mask(strokes: DataFrame, key: str = "image", base: DataFrame | None = None) -> DataFrame:
    """key, x, y, mask of every pixel that a stroke touches, and of those of base(key, x, y, mask); elsewhere it is 1.

    strokes as in covered_pixels, with heal (boolean) and softness: in the order
    of place a healing stroke lifts the mask to its own value, an erasing one
    lowers it to the rest. A soft stroke is blurred by its softness times the radius.
    """
    named = strokes.select(key, "place", F.coalesce("heal", F.lit(True)).alias("heal"), F.coalesce("softness", F.lit(0.5)).alias("softness"), "width", "height")
    cover = covered_pixels(strokes, key).join(named, [key, "place"]).withColumn("v", F.lit(1.0))
    sigma = F.greatest(F.lit(1.0), F.col("r") * F.col("softness"))
    columns = [key, "place", "x", "y", "v"]
    soft = _soften(cover.where(F.col("softness") > HARD).withColumn("sigma", sigma).select(*columns, "r", "sigma", "width", "height"), key)
    values = cover.where(~(F.col("softness") > HARD)).select(*columns).unionByName(soft.select(*columns)).join(named.select(key, "place", "heal"), [key, "place"])
    told = values.groupBy(key, "x", "y").agg(F.array_sort(F.collect_list(F.struct("place", "heal", "v"))).alias("s"))
    first = F.lit(1.0)
    if base is not None:
        told = told.join(base.select(key, "x", "y", F.greatest(F.least(F.col("mask"), F.lit(1.0)), F.lit(0.0)).alias("__base")), [key, "x", "y"], "full")
        first = F.coalesce("__base", F.lit(1.0))
    strokes_of = F.coalesce("s", F.array().cast("array<struct<place: int, heal: boolean, v: double>>"))
    mask = F.aggregate(strokes_of, first, lambda m, s: F.when(s["heal"], F.greatest(m, s["v"])).otherwise(F.least(m, 1 - s["v"])))
    return told.select(key, "x", "y", F.greatest(F.least(mask, F.lit(1.0)), F.lit(0.0)).alias("mask"))


def composite(original: Column, healed: Column, mask: Column, opacity: Column) -> Column:
    """A channel between the original and the healed one, by mask and opacity in percent."""
    m = mask * F.greatest(F.least(opacity / 100, F.lit(1.0)), F.lit(0.0))
    return F.greatest(F.least(original * (1 - m) + healed * m, F.lit(255.0)), F.lit(0.0))
