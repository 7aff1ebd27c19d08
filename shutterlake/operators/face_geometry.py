"""Shapes of faces on pixels: ovals, protected features, eye bags, skin samples, the body below, and which face a pixel is nearest to.

All shapes are in the face's own frame: the origin between the eyes, one unit the
distance of the eyes, the first axis along them. Shapes become pixels row by row
of their own bounding box, so the work is that of what they cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of each part its anchor (a landmark, the mouth's middle or the origin), its offset from it and its half axes, in units of the face.
#: `mouth` as a half axis: half the mouth's width, and so much more.
FEATURES = {
    "left eye": ("left", (0.0, 0.0), (0.33, 0.19)),
    "right eye": ("right", (0.0, 0.0), (0.33, 0.19)),
    "left brow": ("left", (-0.05, -0.37), (0.42, 0.16)),
    "right brow": ("right", (0.05, -0.37), (0.42, 0.16)),
    "lips": ("mouth", (0.0, 0.03), (("mouth", 0.13), 0.27)),
    "nostrils": ("nose", (0.0, 0.13), (0.27, 0.11)),
}
EYE_BAGS = {"left bag": ("left", (0.0, 0.33), (0.30, 0.14)), "right bag": ("right", (0.0, 0.33), (0.30, 0.14))}
SAMPLES = {
    "left cheek": ("origin", (-0.58, 0.68), (0.15, 0.15)),
    "right cheek": ("origin", (0.58, 0.68), (0.15, 0.15)),
    "forehead": ("origin", (0.0, -0.62), (0.17, 0.17)),
    "chin": ("mouth", (0.0, 0.36), (0.10, 0.10)),
}
#: The oval's top, how far it goes below the mouth, the range of the mouth's height, the part of the box's width that is half the oval's
#: and its range, and how far the oval's centre may lie beside the eyes' middle.
TOP, CHIN, MOUTHS, WIDTH_PART, WIDTHS, ASIDE = -1.10, 0.62, (0.8, 1.5), 0.48, (0.95, 1.6), 0.45
#: How much the oval grows for the body, and half widths and heights of the neck's upper and lower end.
BODY_OVAL, NECK_TOP, NECK_END = 1.25, (1.25, 0.9), (2.6, 4.2)


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def face_frames(faces: DataFrame, key: str = "image") -> DataFrame:
    """faces(key, face, box struct<x, y, w, h>, left, right, nose, mouth_left, mouth_right struct<x, y>) with origin, mouth (its middle), iod (distance of the eyes, 1 at least), ux, uy, turn (degrees) and mouth_half."""
    dx, dy = F.col("right.x") - F.col("left.x"), F.col("right.y") - F.col("left.y")
    between = lambda a, b: F.struct(((F.col(f"{a}.x") + F.col(f"{b}.x")) / 2).alias("x"), ((F.col(f"{a}.y") + F.col(f"{b}.y")) / 2).alias("y"))
    framed = faces.withColumns({"iod": F.greatest(F.hypot(dx, dy), F.lit(1.0)), "origin": between("left", "right"), "mouth": between("mouth_left", "mouth_right")})
    wide = F.hypot(F.col("mouth_right.x") - F.col("mouth_left.x"), F.col("mouth_right.y") - F.col("mouth_left.y"))
    framed = framed.withColumns({"ux": dx / F.col("iod"), "uy": dy / F.col("iod"), "mouth_half": wide / F.col("iod") / 2})
    return framed.withColumn("turn", F.degrees(F.atan2("uy", "ux")))


def in_frame(x: Column, y: Column) -> tuple[Column, Column]:
    """A point of the image in the face's frame."""
    rx, ry = (x - F.col("origin.x")) / F.col("iod"), (y - F.col("origin.y")) / F.col("iod")
    return rx * F.col("ux") + ry * F.col("uy"), ry * F.col("ux") - rx * F.col("uy")


def _placed(anchor: str, u: Column, v: Column) -> tuple[Column, Column]:
    return F.col(f"{anchor}.x") + F.col("iod") * (u * F.col("ux") - v * F.col("uy")), F.col(f"{anchor}.y") + F.col("iod") * (u * F.col("uy") + v * F.col("ux"))


def part_ellipses(frames: DataFrame, parts: dict[str, tuple], margin: float = 0.0, least: int = 1, key: str = "image") -> DataFrame:
    """key, face, part, cx, cy, ax, ay (pixels), ux, uy of each part of each face."""
    rows = [F.struct(F.lit(part).alias("part"), F.lit(anchor).alias("anchor"), *[F.lit(float(x)).alias(n) for n, x in (("u", u), ("v", v))], *[F.struct(F.lit(float(isinstance(x, tuple))).alias("mouth"), F.lit(float(x[1] if isinstance(x, tuple) else x) + margin).alias("more")).alias(n) for n, x in zip(("ax", "ay"), axes, strict=True)]) for part, (anchor, (u, v), axes) in parts.items()]
    told = frames.withColumn("p", F.explode(F.array(*rows)))
    anchors = sorted({anchor for anchor, _, _ in parts.values()})
    point = F.lit(None)
    for anchor in anchors:
        point = F.when(F.col("p.anchor") == anchor, F.struct(F.col(f"{anchor}.x").alias("x"), F.col(f"{anchor}.y").alias("y"))).otherwise(point)
    told = told.withColumn("__at", point)
    cx, cy = _placed("__at", F.col("p.u"), F.col("p.v"))
    axes = [F.col(f"p.{a}.mouth") * F.col("mouth_half") + F.col(f"p.{a}.more") for a in ("ax", "ay")]
    return told.select(key, "face", "ux", "uy", _shape(F.col("p.part"), cx, cy, *axes, least).alias("s")).select(key, "face", "s.*", "ux", "uy")


def _shape(part: Column, cx: Column, cy: Column, ax: Column, ay: Column, least: int = 1) -> Column:
    whole = lambda c: F.rint(c).cast("int")
    return F.struct(part.alias("part"), whole(cx).alias("cx"), whole(cy).alias("cy"), *[F.greatest(whole(a * F.col("iod")), F.lit(least)).alias(n) for n, a in (("ax", ax), ("ay", ay))])


def face_ovals(frames: DataFrame, grow: float = 1.0, key: str = "image") -> DataFrame:
    """key, face, part `oval`, cx, cy, ax, ay, ux, uy: width and middle from the box, so turned faces are covered too."""
    bottom = _clip(in_frame(F.col("mouth.x"), F.col("mouth.y"))[1], *MOUTHS) + CHIN
    beside = _clip(in_frame(F.col("box.x") + F.col("box.w") / 2, F.col("box.y") + F.col("box.h") / 2)[0], -ASIDE, ASIDE)
    told = frames.withColumns({"__bottom": bottom, "__beside": beside})
    cx, cy = _placed("origin", F.col("__beside"), (F.col("__bottom") + TOP) / 2)
    shape = _shape(F.lit("oval"), cx, cy, _clip(F.col("box.w") * WIDTH_PART / F.col("iod"), *WIDTHS) * grow, (F.col("__bottom") - TOP) / 2 * grow)
    return told.select(key, "face", "ux", "uy", shape.alias("s")).select(key, "face", "s.*", "ux", "uy")


def _box_pixels(shapes: DataFrame, reach: Column, sizes: DataFrame, key: str) -> DataFrame:
    rows = shapes.withColumn("__r", reach).join(sizes, key)
    for axis, length in (("y", "height"), ("x", "width")):
        rows = rows.withColumns({"__low": F.greatest(F.col(f"c{axis}") - F.col("__r"), F.lit(0)), "__high": F.least(F.col(f"c{axis}") + F.col("__r"), F.col(length) - 1)})
        # An explode of its own for an empty range, which sequence would count downwards.
        rows = rows.withColumn(axis, F.explode(F.when(F.col("__low") <= F.col("__high"), F.sequence("__low", "__high")))).drop("__low", "__high")
    return rows


def ellipse_pixels(ellipses: DataFrame, sizes: DataFrame, key: str = "image") -> DataFrame:
    """key, face, part, x, y: the pixels inside ellipses. sizes(key, width, height); what lies outside the image is not there."""
    rows = _box_pixels(ellipses, F.greatest("ax", "ay"), sizes, key)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    along, across = dx * F.col("ux") + dy * F.col("uy"), dy * F.col("ux") - dx * F.col("uy")
    return rows.where(F.pow(along / F.col("ax"), 2) + F.pow(across / F.col("ay"), 2) <= 1 + 1e-9).select(key, "face", "part", "x", "y")


def body_pixels(frames: DataFrame, sizes: DataFrame, key: str = "image") -> DataFrame:
    """key, face, x, y of the region that can show a person's skin: the grown oval, and the neck and chest that widen below it."""
    oval = ellipse_pixels(face_ovals(frames, BODY_OVAL, key), sizes, key).select(key, "face", "x", "y")
    (top, high), (end, low) = NECK_TOP, NECK_END
    cx, cy = _placed("origin", F.lit(0.0), F.lit((high + low) / 2))
    neck = frames.withColumns({"cx": F.rint(cx).cast("int"), "cy": F.rint(cy).cast("int")})
    rows = _box_pixels(neck, F.ceil(F.col("iod") * ((low - high) / 2 + end)).cast("int"), sizes, key)
    u, v = in_frame(F.col("x"), F.col("y"))
    inside = v.between(high, low) & (F.abs(u) <= top + (v - high) / (low - high) * (end - top))
    return oval.unionByName(rows.where(inside).select(key, "face", "x", "y")).distinct()


def owners(pixels: DataFrame, frames: DataFrame, key: str = "image") -> DataFrame:
    """pixels with owner: the face whose eyes are nearest, in that face's own units; the first of equal ones, null on images without faces."""
    near = frames.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("face", F.col("origin.x").alias("ox"), F.col("origin.y").alias("oy"), "iod"))).alias("__faces"))
    far = F.transform("__faces", lambda f: F.struct((F.hypot(F.col("x") - f["ox"], F.col("y") - f["oy"]) / f["iod"]).alias("d"), f["face"].alias("face")))
    return pixels.join(near, key, "left").withColumn("owner", F.array_min(far)["face"]).drop("__faces")


def with_face_marks(pixels: DataFrame, frames: DataFrame, sizes: DataFrame, grow: float = 1.4, key: str = "image") -> DataFrame:
    """pixels with apart (1 within a grown face oval, else 0) and skin (within a sample of cheeks, forehead or chin), as the white balance reads them."""
    apart = ellipse_pixels(face_ovals(frames, grow, key), sizes, key).select(key, "x", "y", F.lit(True).alias("__a"), F.lit(False).alias("__s"))
    skin = ellipse_pixels(part_ellipses(frames, SAMPLES, least=2, key=key), sizes, key).select(key, "x", "y", F.lit(False).alias("__a"), F.lit(True).alias("__s"))
    marks = apart.unionByName(skin).groupBy(key, "x", "y").agg(F.max("__a").alias("__a"), F.max("__s").alias("__s"))
    marked = pixels.join(marks, [key, "x", "y"], "left")
    return marked.withColumns({"apart": F.coalesce(F.col("__a").cast("double"), F.lit(0.0)), "skin": F.coalesce("__s", F.lit(False))}).drop("__a", "__s")
