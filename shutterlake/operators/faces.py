"""Faces of photos: which count, how sharp they are, whether their eyes are open, and who is who in the next frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def face_metrics(faces: DataFrame) -> DataFrame:
    """faces(photo, at, area, sharpness, luma, eyes found, smile, large) -> one row per photo.

    Faces with a quarter of the largest area count; sharpness and luma are those
    of the sharpest of them, the first on ties. Each face should show two eyes:
    OPEN from half of them, PARTIAL below, and CLOSED without any unless a smile,
    a large face or a mean sharpness above 60 speaks for a candid shot. The
    window and the aggregate share one shuffle by photo.
    """
    largest = F.max("area").over(Window.partitionBy("photo"))
    marked = faces.withColumn("__important", F.col("area") >= 0.25 * largest)
    best = F.max_by(F.struct("sharpness", "luma"), F.when(F.col("__important"), F.struct(F.col("sharpness"), -F.col("at"), F.col("luma"))))
    ratio = F.sum(F.least(F.lit(2), F.col("eyes"))) / (2 * F.count(F.lit(1)))
    rows = marked.groupBy("photo").agg(F.count(F.lit(1)).alias("faces"), best.alias("b"), ratio.alias("ratio"), F.bool_or("smile").alias("smile"), F.bool_or("large").alias("large"), F.avg("sharpness").alias("mean"))
    candid = F.col("smile") | F.col("large") | (F.col("mean") > 60)
    eyes = F.when(F.col("ratio") >= 0.5, F.struct(F.lit("OPEN"), F.lit(0.92))).when(F.col("ratio") > 0, F.struct(F.lit("PARTIAL"), F.lit(0.80))).when(candid, F.struct(F.lit("OPEN"), F.lit(0.85))).otherwise(F.struct(F.lit("CLOSED"), F.lit(0.82)))
    return rows.withColumn("e", eyes).select("photo", "faces", F.round("b.sharpness", 1).alias("sharpness"), F.round("b.luma", 1).alias("luma"), F.col("e.col1").alias("eyes"), F.col("e.col2").alias("confidence"))


def genre(scene: Column, faces: Column, warmth: Column, skin: Column) -> Column:
    """The kind of shot: by its scene where that tells, else by the number of faces."""
    by_scene = (
        F.when(scene.isin("Bride Makeup", "Groom Preparation"), "Solo Portrait & Makeup")
        .when(scene == "Mandap & Ceremony", "Mandap & Sacred Pheras")
        .when(scene == "Reception & Sangeet", "Night Reception & Dance")
        .when(scene == "Outdoor Portraits", "Outdoor Sunlight & Garden")
    )
    by_faces = F.when((faces == 0) & (warmth > 28) & skin, "Mandap & Sacred Pheras").when(faces == 0, "Décor, Rituals & Macro Details").when(faces == 1, "Solo Portrait & Makeup").when(faces == 2, "Couple Portrait").otherwise("Family & Stage Group")
    return F.coalesce(by_scene, by_faces)


def match_faces(targets: DataFrame, donors: DataFrame, most: float = 0.12) -> DataFrame:
    """targets and donors(pair, at, x, y), centres as shares of the frame -> pair, target, donor.

    In the order of targets each takes the nearest free donor, the first on ties,
    if it is nearer than `most`. A frame's faces are few, so a pair is one row
    with two arrays, folded in the JVM.
    """
    group = lambda d, name: d.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("at", "x", "y"))).alias(name))
    both = group(targets, "t").join(group(donors, "d"), "pair")
    fold = """aggregate(t, array(struct(cast(null as long) as target, cast(null as long) as donor)), (done, a) ->
        concat(done, transform(filter(array(array_min(transform(filter(d, b -> not exists(done, m -> m.donor <=> b.at)),
          b -> struct(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as far, b.at as at)))), n -> n.far < {most}), n -> struct(cast(a.at as long) as target, cast(n.at as long) as donor))))"""
    return both.select("pair", F.explode(F.slice(F.expr(fold.format(most=most)), 2, 1_000_000)).alias("m")).select("pair", "m.*")
