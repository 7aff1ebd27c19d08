"""Whole culls: quality, bursts and decisions in one flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shutterlake.operators import culling
from shutterlake.plans.registry import query
from shutterlake.plans.vision import _BURSTS, _LOOSE, _STATUS, burst_items, vectors

_STATS = {
    "variance": "cast(vec_id * 91 % 2600 as double)",
    "mean": "cast(vec_id * 7 % 180 + 50 as double)",
    "p5": "cast(vec_id % 40 as double)",
    "p10": "cast(vec_id % 70 + 40 as double)",
    "p50": "cast(vec_id % 90 + 70 as double)",
    "p90": "cast(vec_id % 80 + 140 as double)",
    "p95": "cast(vec_id % 90 + 150 as double)",
    "shadow": "cast(vec_id % 16 as double)",
    "highlight": "cast(vec_id % 12 as double)",
    "faces": "vec_id % 6",
    "face_sharp": "cast(vec_id * 29 % 70 as double)",
    "face_hires": "case when vec_id % 4 = 0 then -1.0 else cast(vec_id * 31 % 60 as double) end",
    "brightness": "cast(vec_id * 13 % 260 as double)",
    "candid": "vec_id % 5 = 0",
    "eyes": "case vec_id % 3 when 0 then 'OPEN' when 1 then 'CLOSED' else 'PARTIAL' end",
}
_SHARP = "round(least(greatest(ln(1 + variance) / ln(2501.0) * 100, 0), 100), 3)"


def _cull_sql(mean: str) -> str:
    return f"""{_BURSTS}, st AS (SELECT vec_id AS id, bits, {', '.join(f'{e} AS {k}' for k, e in _STATS.items())} FROM e), q0 AS (SELECT *, {_STATUS} AS exposure, {_SHARP} AS sharp, variance < 120 AS blurred FROM st),
x AS (SELECT *, least(greatest(CASE exposure WHEN 'UNDER_EXPOSED' THEN greatest(10, 100 - (90 - mean) * 1.6 - shadow * 1.5) WHEN 'OVER_EXPOSED' THEN greatest(10, 100 - (mean - 150) * 1.6 - highlight * 1.8) ELSE greatest(55, 100 - abs(p50 - 125) * 0.5 - shadow * 0.6 - highlight * 0.8) END, 0), 100) AS escore FROM q0),
q AS (SELECT *, round((sharp * 0.45 + escore * 0.40 + least(greatest((p95 - p5) / 210 * 100, 0), 100) * 0.15) * CASE WHEN blurred THEN 0.6 ELSE 1 END, 3) AS quality FROM x),
r AS (SELECT s.project, s.anchor, q.*, quality * 0.40 + sharp * 0.35 + CASE eyes WHEN 'OPEN' THEN 25 WHEN 'CLOSED' THEN -40 ELSE 0 END - CASE WHEN blurred THEN 50 ELSE 0 END AS score FROM s JOIN q USING (id)),
b AS (SELECT *, id = first_value(id) OVER (PARTITION BY project, anchor ORDER BY score DESC, id) AS first, count(*) OVER (PARTITION BY project, anchor) AS size FROM r),
g AS (SELECT * REPLACE ({mean} AS mean), CASE WHEN size > 1 THEN 'Group ' || anchor END AS group_id, CASE WHEN size > 1 THEN first END AS is_best, faces > 0 AS face FROM b),
f AS (SELECT *, CASE WHEN face AND face_hires >= 0 THEN face_hires >= 36 AND face_sharp >= 38 WHEN face THEN face_sharp >= 48 ELSE sharp >= 42 END AS ok,
  CASE WHEN face AND face_hires >= 0 THEN face_hires < 30 OR (face_hires < 36 AND face_sharp < 38) WHEN face THEN face_sharp < 38 ELSE sharp < 34 END AS bad, CASE WHEN face THEN face_sharp ELSE sharp END AS subject, face AND brightness > 0 AS lit FROM g),
t AS (SELECT *, CASE WHEN lit THEN brightness < 18 AND mean < 30 ELSE exposure = 'UNDER_EXPOSED' AND mean < 22 END AS black, CASE WHEN lit THEN brightness > 250 AND mean > 235 ELSE exposure = 'OVER_EXPOSED' AND mean > 238 END AS white,
  CASE WHEN lit THEN brightness < 45 OR brightness > 238 ELSE (exposure = 'UNDER_EXPOSED' AND mean < 40) OR (exposure = 'OVER_EXPOSED' AND mean > 220) END AS doubtful FROM f),
d AS (SELECT *, CASE WHEN bad OR black OR white THEN CASE WHEN bad AND (subject < 30 OR (face AND face_hires >= 0 AND face_hires < 25)) THEN 'REJECT 95' ELSE 'REJECT 88' END WHEN group_id IS NOT NULL AND NOT is_best THEN 'SIMILAR 92' WHEN group_id IS NOT NULL AND NOT ok THEN 'REVIEW 74' WHEN group_id IS NOT NULL THEN 'BEST 96'
  WHEN NOT ok THEN 'REVIEW 70' WHEN face AND eyes = 'CLOSED' AND NOT candid THEN 'REVIEW 72' WHEN doubtful THEN 'REVIEW 68' WHEN exposure = 'GOOD' THEN 'BEST 95' ELSE 'BEST 90' END AS v FROM t)
SELECT project, id, group_id, is_best, split_part(v, ' ', 1) AS label, split_part(v, ' ', 2)::DOUBLE AS confidence FROM d"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).selectExpr("vec_id as id", "bits as dhash", *[f"{e} as {k}" for k, e in _STATS.items()])


@query(_cull_sql("mean"))
def cull_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every photo of every shoot with its burst and the decision on it."""
    return culling.cull_project(burst_items(spark, sf_dir), _stats(spark, sf_dir), _LOOSE)


@query(_cull_sql("128.0"))
def recluster_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts and decisions anew from what was stored."""
    return culling.recluster(burst_items(spark, sf_dir), culling.photo_quality(_stats(spark, sf_dir)), _LOOSE)
