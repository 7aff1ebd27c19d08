"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Scratch


def contract(stars: DataFrame) -> DataFrame:
    """stars(a, b), where each a has few b -> edges with the same components, about one for each a.

    All b of one a belong together, so (a, least b) and, once for all a that
    agree, (b, least b) say the same. Equal edges meet on the map side.
    """
    near = stars.where(F.col("a") != F.col("b")).groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("all"))
    least = F.get("all", F.lit(0))
    own = near.select("a", least.alias("b"))
    rest = near.where(F.size("all") > 1).select(F.explode(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))).alias("a"), least.alias("b")).distinct()
    return own.unionByName(rest)


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> node, label: the smallest node of the component. Loops and null ends are ignored.

    Each round takes the least label of the neighbours (a sum that starts on the
    map side, so a node with very many edges is no hot spot) and then jumps to
    the label's label. Rounds are written to the shared folder; the driver sees
    one count per round.
    """
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b")
    both = scratch.write(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        nearest = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(nearest, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        lower = scratch.write(lower, "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = scratch.write(lower.join(jump, "label", "left").select("node", "old", F.coalesce("next", "label").alias("label")), "labels")
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        scratch.drop(labels, lower)
        labels = new
        if not changed:
            scratch.drop(both)
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
