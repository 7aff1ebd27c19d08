"""Colour operators over tables of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import columns as C
from shutterlake.functions import pixels as P
from shutterlake.plans.registry import _view, query
from shutterlake.sources.tables import table

_PIXELS = {
    "image": "l_orderkey",
    "pixel": "l_linenumber",
    "r": "cast(l_partkey % 256 as double)",
    "g": "cast((l_suppkey * 7 + l_linenumber) % 200 as double)",
    "b": "cast((l_orderkey * 3) % 180 as double)",
    "mask": "cast(l_linenumber % 3 as double) / 2",
    "temperature": "cast(l_partkey % 60 - 30 as double)",
    "tint": "cast(l_suppkey % 40 - 20 as double)",
    "ev": "cast(l_linenumber - 3 as double) / 2",
    "far": "cast(l_partkey % 100 as double) / 100",
}
_P = f"p AS (SELECT *, r * 0.299 + g * 0.587 + b * 0.114 AS y FROM ({_view(_PIXELS, 'lineitem')}))"
_STEP = "(t * t * (3.0 - 2.0 * t))"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {k}" for k, e in _PIXELS.items()])


@query(f"""WITH {_P}, c AS (SELECT image, least(greatest(round((r - y) * 0.713 + 128), 0), 255) AS cr, least(greatest(round((b - y) * 0.564 + 128), 0), 255) AS cb FROM p), s AS (SELECT *, cr BETWEEN 133 AND 173 AND cb BETWEEN 77 AND 127 AS skin FROM c),
a AS (SELECT image, count(*) FILTER (WHERE skin) / count(*) AS share, avg(cr) FILTER (WHERE skin) AS cr, avg(cb) FILTER (WHERE skin) AS cb FROM s GROUP BY image)
SELECT image, share > 0.02 AS has_skin, CASE WHEN share > 0.02 THEN round(share, 6) ELSE 0.0 END AS coverage, CASE WHEN share > 0.02 THEN round(cr, 6) ELSE 145.0 END AS cr, CASE WHEN share > 0.02 THEN round(cb, 6) ELSE 105.0 END AS cb FROM a""")
def skin_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an image is skin, and of which tone."""
    return P.skin_chroma(_pixels(spark, sf_dir), "image").select("image", "has_skin", *[F.round(c, 6).alias(c) for c in ("coverage", "cr", "cb")])


@query(f"""WITH {_P}, d AS (SELECT image, sum(floor(y * 16)) AS light, sum(floor(least(greatest(r * (1 + CASE WHEN abs(temperature) > 0.1 THEN temperature / 100 ELSE 0 END * 0.18), 0), 255) * 100 + 0.001)) AS r,
sum(floor(least(greatest(g * (1 - CASE WHEN abs(tint) > 0.1 THEN tint / 100 ELSE 0 END * 0.16), 0), 255) * 100 + 0.001)) AS g, sum(floor(least(greatest(b * (1 - CASE WHEN abs(temperature) > 0.1 THEN temperature / 100 ELSE 0 END * 0.24), 0), 255) * 100 + 0.001)) AS b FROM p GROUP BY image)
SELECT image, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b FROM d""")
def temperature_tint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the channels, in hundredths, after temperature and tint."""
    p = _pixels(spark, sf_dir)
    channels = P.balanced(*[F.col(c) for c in ("r", "g", "b", "temperature", "tint")])
    return p.select("image", *[F.floor(x * 100 + 0.001).alias(c) for c, x in zip("rgb", channels, strict=True)]).groupBy("image").agg(*[F.sum(c).cast("long").alias(c) for c in "rgb"])


@query(f"""WITH {_P}, s AS (SELECT image, pixel, mask, temperature, tint, coalesce((greatest(r, g, b) - least(r, g, b)) / nullif(greatest(r, g, b), 0), 0) AS s FROM p)
SELECT image, sum(floor(least(greatest((s + CASE WHEN abs(temperature) > 0.1 THEN (1 - s) * (temperature / 100 * 0.40) * (1 - mask * 0.70) ELSE 0 END) * CASE WHEN abs(tint) > 0.1 THEN (100 + tint) / 100 ELSE 1 END * 255, 0), 255) * 100 + 0.001))::BIGINT AS saturation FROM s GROUP BY image""")
def vibrance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of saturation, in hundredths, after vibrance that spares skin."""
    saturation = C.saturation_share(F.col("r"), F.col("g"), F.col("b"))
    rows = _pixels(spark, sf_dir).select("image", P.vibrant(saturation, F.col("mask"), F.col("temperature"), F.col("tint")).alias("s"))
    return rows.groupBy("image").agg(F.sum(F.floor(F.col("s") * 100 + 0.001)).cast("long").alias("saturation"))


@query(f"""WITH {_P}, l AS (SELECT image, coalesce(sum(y * mask) / nullif(sum(mask), 0), 0) AS s, coalesce(sum(y * (1 - mask)) / nullif(sum(1 - mask), 0), 0) AS g FROM p GROUP BY image),
z AS (SELECT image, CASE WHEN g < 58 OR (s / greatest(g, 1) > 1.35 AND s > 45) THEN 0 ELSE (least(greatest(135 / greatest(s, 30), 1), 1.15) - 1) * 0.18 END AS ds, CASE WHEN g < 58 OR (s / greatest(g, 1) > 1.35 AND s > 45) THEN 0 ELSE (least(greatest(110 / greatest(g, 30), 0.98), 1.12) - 1) * 0.15 END AS dg FROM l)
SELECT image, sum(floor(least(r * (1 + mask * ds + (1 - mask) * dg), 255) * 100 + 0.001))::BIGINT AS r, sum(floor(least(g * (1 + mask * ds + (1 - mask) * dg), 255) * 100 + 0.001))::BIGINT AS g FROM p JOIN z USING (image) GROUP BY image""")
def zone_relight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of red and green, in hundredths, of images whose subject and background were relit."""
    return P.relit(_pixels(spark, sf_dir), "image").groupBy("image").agg(*[F.sum(F.floor(F.col(c) * 100 + 0.001)).cast("long").alias(c) for c in "rg"])


@query(f"""WITH {_P}, t AS (SELECT *, least(greatest((y / 255 - 0.40) / 0.45, 0), 1) AS t, least(greatest((far - 0.55) / 0.45, 0), 1) AS e FROM p)
SELECT image, round(avg(CASE WHEN abs(ev) > 0.01 THEN 1 + mask * CASE WHEN ev > 0 THEN 1 - 0.65 * {_STEP} ELSE 0.35 + 0.65 * {_STEP} END * (2.0 ** ev - 1) ELSE 1 END), 6) AS light, round(avg(1 - e * e * (3.0 - 2.0 * e) * mask * 0.18), 6) AS edge FROM t GROUP BY image""")
def light_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean gains of the subject light and of the vignette."""
    y = P.luma(F.col("r"), F.col("g"), F.col("b"))
    return _pixels(spark, sf_dir).groupBy("image").agg(F.round(F.avg(P.subject_light(y, F.col("mask"), F.col("ev"))), 6).alias("light"), F.round(F.avg(P.vignette(F.col("far"), F.col("mask"))), 6).alias("edge"))
