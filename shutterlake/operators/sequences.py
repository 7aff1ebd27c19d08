"""Operators over ordered rows: burst segmentation, greedy suppression, fixed-window limits.

They are folds over sorted arrays, in the JVM. Rows are first cut at places
where a fold starts anew whatever its state, so that an array holds one such
run, of a few numbers a row, and not a whole project.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.columns import cosine, hamming, iou, let, zncc


@dataclass(frozen=True)
class BurstRules:
    """Thresholds of the match between neighbours; a burst has `longest` photos at most."""

    longest: int = 13
    quick_gap: float = 4.0
    slow_gap: float = 8.0
    quick_any: float = 0.62
    quick_previous: float = 0.60
    quick_colour: float = 0.88
    quick_zncc: float = 0.45
    slow_previous: float = 0.74
    slow_colour: float = 0.90
    slow_zncc: float = 0.60


def gap(previous: Column, current: Column) -> Column:
    """Seconds between two photos; by their numbers where a time is missing."""
    step = current["seq"] - previous["seq"]
    timed = current["ts"].isNotNull() & previous["ts"].isNotNull()
    return F.when(timed, current["ts"] - previous["ts"]).when((step > 0) & (step <= 1), 2.0).when(step <= 2, 5.0).otherwise(999.0)


def burst_match(anchor: Column, previous: Column, current: Column, rules: BurstRules) -> Column:
    same = (anchor["stem"] == current["stem"]) & (F.length(anchor["stem"]) >= 3)

    def scores(a: Column) -> Column:
        both = F.struct(cosine(a["hist"], current["hist"]).alias("colour"), zncc(a["feature"], current["feature"]).alias("near"))
        return let(both, lambda x: F.struct(x["colour"].alias("colour"), x["near"].alias("near"), (x["colour"] * 0.35 + x["near"] * 0.45 + (1 - hamming(a["dhash"], current["dhash"]) / 64) * 0.20).alias("score")))

    def by_look(x: Column) -> Column:
        p, a, g = x["p"], x["a"], x["g"]
        quick = ((F.greatest(p["score"], a["score"]) >= rules.quick_any) | (p["score"] >= rules.quick_previous)) & (p["colour"] >= rules.quick_colour) & (F.greatest(p["near"], a["near"]) >= rules.quick_zncc)
        slow = (p["score"] >= rules.slow_previous) & (p["colour"] >= rules.slow_colour) & (p["near"] >= rules.slow_zncc)
        return F.when(g <= rules.quick_gap, quick).otherwise(slow)

    g = gap(previous, current)
    crowd = (anchor["faces"] == 0) & (current["faces"] >= 4) | (current["faces"] == 0) & (anchor["faces"] >= 4)
    look = let(F.struct(scores(previous).alias("p"), scores(anchor).alias("a"), g.alias("g")), by_look)
    return F.when(same, True).when(g > rules.slow_gap, False).when(crowd, False).otherwise(look)


_ITEM = ("id", "ts", "seq", "filename", "stem", "faces", "dhash", "hist", "feature")
#: Photos that follow each other are worked on in parts of this many seconds, or of this many numbers where times are missing.
PART_SECONDS, PART_NUMBERS = 600, 512


def burst_segments(items: DataFrame, rules: BurstRules = BurstRules()) -> DataFrame:  # noqa: B008
    """items(project, id, ts, seq, filename, stem, faces, dhash, hist, feature) -> project, id, anchor.

    anchor: the id of the burst's first photo, its own for a photo alone. Photos
    are ordered by time (missing: 0), number and name. A project falls into parts
    of its time, so none is one task; each part takes the last photos of those
    before along. Each photo is matched with the dozen before as anchors, and
    the fold over a run of photos sees only the bits of these matches.
    """
    most = rules.longest - 1
    order = [F.coalesce("ts", F.lit(0.0)), F.coalesce("seq", F.lit(0)), "filename", "id"]
    # Parts lie in the order of their photos: at time 0 by number, and all that is later in those ten minutes behind.
    at, nil = F.coalesce("ts", F.lit(0.0)), F.lit(0).cast("long")
    number = F.when(at == 0, F.floor(F.coalesce("seq", F.lit(0)) / PART_NUMBERS)).otherwise(nil)
    part = F.struct(F.floor(F.nanvl(at, F.lit(float("inf"))) / PART_SECONDS).alias("time"), (at > 0).alias("later"), number.alias("number"))
    photo = F.struct(*_ITEM)
    placed = items.select("project", part.alias("__part"), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]).alias("__order"), photo.alias("__photo"))

    # What a part starts after: the last photos of the parts before it.
    ends = Window.partitionBy("project", "__part").orderBy(F.col("__order").desc())
    tails = placed.withColumn("__r", F.row_number().over(ends)).where(F.col("__r") <= most).groupBy("project", "__part").agg(F.transform(F.array_sort(F.collect_list(F.struct("__order", "__photo"))), lambda x: x["__photo"]).alias("tail"))
    # A part has a photo at least, so as many parts as photos are wanted are enough.
    earlier = F.collect_list("tail").over(Window.partitionBy("project").orderBy("__part").rowsBetween(-most, -1))
    starts = tails.select("project", "__part", _last(F.flatten(earlier), most).alias("__start"))

    w = Window.partitionBy("project", "__part").orderBy("__order")
    local = F.collect_list("__photo").over(w.rowsBetween(-most, -1))
    # Rows of one id are told apart by their place, else what was found for one would go to another.
    rows = placed.withColumns({"__local": local, "__place": F.row_number().over(w)}).join(starts, ["project", "__part"])
    rows = rows.select("project", "__part", F.struct("__order", "__place").alias("__order"), "__photo", _last(F.concat("__start", "__local"), most).alias("__before"))
    previous = F.element_at(F.col("__before"), -1)
    rows = rows.withColumn("__gap", F.when(F.size("__before") > 0, gap(previous, F.col("__photo"))))
    named = F.exists("__before", lambda p: p["stem"] == F.col("__photo")["stem"])
    cut = F.coalesce((F.col("__gap") > rules.slow_gap) & ~F.coalesce(named, F.lit(False)), F.lit(True))

    # Bit k - 1: whether the photo joins a burst that started k photos before.
    def bit(anchor: Column, i: Column) -> Column:
        joins = F.coalesce(burst_match(anchor, previous, F.col("__photo"), rules), F.lit(False))
        return F.when(joins, F.call_function("shiftleft", F.lit(1), (F.size("__before") - 1 - i).cast("int"))).otherwise(0)

    bits = F.aggregate(F.transform("__before", bit), F.lit(0), lambda s, x: s.bitwiseOR(x))
    flat = rows.select("project", "__part", "__order", F.col("__photo.id").alias("id"), F.when(cut, 0).otherwise(bits).alias("__bits"), cut.cast("int").alias("__cut"))

    # Runs go on over parts without a cut: their name is that of the last cut.
    flat = flat.withColumn("__n", F.sum("__cut").over(w))
    cuts = flat.groupBy("project", "__part").agg(F.max("__n").alias("n"))
    named_by = F.last(F.when(F.col("n") > 0, F.struct("__part", "n")), ignorenulls=True).over(Window.partitionBy("project").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carried = cuts.select("project", "__part", named_by.alias("__carried"))
    run = F.when(F.col("__n") > 0, F.struct(F.col("__part"), F.col("__n").alias("n"))).otherwise(F.col("__carried"))
    runs = flat.join(carried, ["project", "__part"]).withColumn("__run", run)
    arrays = runs.groupBy("project", "__run").agg(F.array_sort(F.collect_list(F.struct("__order", "id", F.col("__bits").alias("bits")))).alias("a"))
    # A photo that joins no burst, wherever one starts, starts one whatever the state: arrays are folded between such photos.
    alone = F.filter(F.transform("a", lambda x, i: F.when(x["bits"] == 0, i)), lambda i: i.isNotNull())
    arrays = arrays.withColumn("alone", alone)
    pieces = F.transform("alone", lambda i, k: F.slice(F.col("a"), i + 1, F.coalesce(F.get(F.col("alone"), k + 1), F.size("a")) - i))
    arrays = arrays.select("project", F.explode(pieces).alias("a"))
    start = F.struct(F.array().cast("array<struct<id:bigint,n:int>>").alias("out"), F.lit(0).alias("n"))

    def fold(state: Column, item: Column) -> Column:
        joins = (state["n"] > 0) & (state["n"] < rules.longest) & (F.call_function("shiftright", item["bits"], state["n"] - 1).bitwiseAND(F.lit(1)) == 1)
        return let(F.when(joins, state["n"] + 1).otherwise(1), lambda n: F.struct(F.array_append(state["out"], F.struct(item["id"].cast("long").alias("id"), n.alias("n"))).alias("out"), n.alias("n")))

    folded = F.aggregate("a", start, fold, lambda s: s["out"])
    marked = arrays.select("project", folded.alias("f"))
    anchored = F.transform("f", lambda x, i: F.struct(x["id"].alias("id"), F.get(F.col("f"), i - x["n"] + 1)["id"].alias("anchor")))
    return marked.select("project", F.inline(anchored))


def _last(photos: Column, most: int) -> Column:
    return F.when(F.size(photos) > most, F.slice(photos, F.greatest(F.size(photos) - most + 1, F.lit(1)), F.lit(most))).otherwise(photos)


def with_winner(segments: DataFrame, metrics: DataFrame) -> DataFrame:
    """segments(project, id, anchor), metrics(id, quality, sharpness, eyes, blurred, dhash, ...) -> both, with the burst's `best`, struct(id, dhash), and its `size`; ties go to the smallest id. A window holds one burst."""
    score = F.col("quality") * 0.40 + F.col("sharpness") * 0.35 + F.when(F.col("eyes") == "OPEN", 25.0).when(F.col("eyes") == "CLOSED", -40.0).otherwise(0.0) - F.when(F.col("blurred"), 50.0).otherwise(0.0)
    burst = Window.partitionBy("project", "anchor")
    first = F.first(F.struct("id", "dhash")).over(burst.orderBy(score.desc_nulls_last(), "id"))
    return segments.join(metrics, "id").withColumns({"best": first, "size": F.count(F.lit(1)).over(burst)})


def burst_winners(segments: DataFrame, metrics: DataFrame) -> DataFrame:
    """segments and metrics as with_winner takes them -> project, anchor, id, is_best, similarity for bursts of two or more."""
    near = F.greatest(F.lit(50.0), 100 - hamming(F.col("best.dhash"), F.col("dhash")) / 64 * 100)
    return with_winner(segments, metrics).where("size > 1").select("project", "anchor", "id", (F.col("id") == F.col("best.id")).alias("is_best"), F.round(near, 1).alias("similarity"))


def suppress(boxes: DataFrame, key: str, most_overlap: float = 0.35) -> DataFrame:
    """boxes(key, id, score, x, y, w, h) -> key, id kept: by falling score, a box stays if it overlaps no kept one by most_overlap. Boxes of one image are one array."""
    arrays = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "x", "y", "w", "h"))).alias("a"))
    kept = F.aggregate("a", F.slice("a", 1, 0), lambda s, b: F.when(F.exists(s, lambda k: iou(k, b) >= most_overlap), s).otherwise(F.array_append(s, b)))
    return arrays.select(key, F.explode(F.transform(kept, lambda b: b["id"])).alias("id"))


def fixed_window(hits: DataFrame, bucket: str, ts: str, most: int, seconds: int) -> DataFrame:
    """hits(bucket, id, ts in seconds) -> bucket, id, window_start, hits, allowed.

    A window opens with the first hit after the last one ended. A pause of
    `seconds` always ends a window, so the runs between pauses are folded each
    on their own. The fold is over the different times of a run and keeps only
    the times at which windows open, at least `seconds` apart; hits are placed
    in their windows by a running last value.
    """
    w = Window.partitionBy(bucket).orderBy("t", "id")
    pause = F.when(F.col("t") - F.lag("t").over(w) >= seconds, 1).otherwise(0)
    runs = hits.select(bucket, F.col("id").cast("long").alias("id"), F.col(ts).cast("long").alias("t")).withColumn("p", pause).withColumn("run", F.sum("p").over(w)).drop("p")
    times = runs.groupBy(bucket, "run").agg(F.array_sort(F.collect_set("t")).alias("a"))
    start = F.array(F.get("a", F.lit(0)))
    opens = F.aggregate("a", start, lambda s, t: F.when(t - F.element_at(s, -1) >= seconds, F.array_append(s, t)).otherwise(s))
    opened = times.select(bucket, "run", F.explode(opens).alias("t")).withColumn("opens", F.col("t"))
    placed = runs.join(opened, [bucket, "run", "t"], "left")
    since = F.last("opens", ignorenulls=True).over(Window.partitionBy(bucket, "run").orderBy("t", "id")).alias("window_start")
    rows = placed.select(bucket, "id", "t", "run", since)
    n = F.row_number().over(Window.partitionBy(bucket, "run", "window_start").orderBy("t", "id"))
    return rows.select(bucket, "id", "window_start", n.alias("hits"), (n <= most).alias("allowed"))
