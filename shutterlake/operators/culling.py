"""Culling of whole shoots: quality of each photo, bursts with their winners, then the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import rules, sequences

#: Mean brightness of photos that are decided anew from stored metrics, which do not hold it.
STORED_MEAN = 128.0


def photo_quality(stats: DataFrame) -> DataFrame:
    """stats(id, variance, mean, p5 ... p95, shadow, highlight, ...) with sharpness, blurred, exposure and quality. A photo without stats counts as sharp as nothing: null stats give null quality, which loses every comparison."""
    c = F.col
    rows = stats.withColumns({"sharpness": F.round(rules.log_sharpness(c("variance")), 3), "blurred": c("variance") < 120, "exposure": rules.exposure_status(c("mean"), c("p10"), c("p50"), c("p90"), c("shadow"), c("highlight"))})
    score = rules.exposure_score(c("exposure"), c("mean"), c("p50"), c("shadow"), c("highlight"))
    return rows.withColumn("quality", F.round(rules.overall_quality(c("sharpness"), score, c("p5"), c("p95"), c("blurred")), 3))


def decide(items: DataFrame, measured: DataFrame, burst_rules: sequences.BurstRules, mean: Column) -> DataFrame:
    """Bursts, winners and decisions: project, id, group_id (null: alone), is_best, label, confidence.

    items: as burst_segments takes them; measured(id, quality, sharpness,
    blurred, exposure, faces, face_sharp, face_hires, brightness, eyes, candid,
    dhash, ...). A group is named by its first photo.
    """
    grouped = F.col("size") > 1
    named = {"group_id": F.when(grouped, F.concat(F.lit("Group "), "anchor")), "is_best": F.when(grouped, F.col("id") == F.col("best.id"))}
    rows = sequences.with_winner(sequences.burst_segments(items, burst_rules), measured).withColumns(named)
    names = ("faces", "face_sharp", "face_hires", "brightness", "sharpness", "exposure", "eyes", "candid", "group_id", "is_best")
    verdict = rules.cull({k: F.col(k) for k in names} | {"mean": mean, "focus": F.lit(-1.0)})
    return rows.select("project", "id", "group_id", "is_best", verdict.alias("d")).select("project", "id", "group_id", "is_best", "d.label", "d.confidence")


def cull_project(items: DataFrame, stats: DataFrame, burst_rules: sequences.BurstRules = sequences.BurstRules()) -> DataFrame:  # noqa: B008
    """The three passes over new photos."""
    return decide(items, photo_quality(stats), burst_rules, F.col("mean"))


def recluster(items: DataFrame, stored: DataFrame, burst_rules: sequences.BurstRules = sequences.BurstRules()) -> DataFrame:  # noqa: B008
    """Bursts and decisions anew from stored metrics, without pixels: the mean brightness is not stored and counts as STORED_MEAN."""
    return decide(items, stored, burst_rules, F.lit(STORED_MEAN))
