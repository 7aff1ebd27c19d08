"""Mask strokes against two stacks and a canvas."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from shutterlake.functions import kernels
from shutterlake.operators import strokes

STROKE = "image int, place int, points array<struct<x: double, y: double>>, radius double, heal boolean, softness double, width int, height int"


def test_stacks_of_random_logs(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for image in range(40):
        done, undone = [], []
        for seq in range(rng.choice([0, 1, 5, 40])):
            action = rng.choice(["add", "add", "undo", "undo", "redo", "redo", "clear", "other", None] if image % 2 else ["add", "undo", "redo"])
            rows.append((image, seq, action))
            if action == "add":
                done.append(seq)
                undone = []
            elif action == "undo" and done:
                undone.append(done.pop())
            elif action == "redo" and undone:
                done.append(undone.pop())
            elif action == "clear":
                done, undone = [], []
        want |= {(image, p): s for p, s in enumerate(done)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "image int, seq long, action string")
    assert {(r.image, r.place): r.seq for r in strokes.standing_strokes(df).collect()} == want and len(want) > 50
    assert strokes.standing_strokes(df.limit(0)).count() == 0


def canvas(df, shape):
    out = np.ones(shape)
    for r in df.collect():
        out[r.y, r.x] = r.mask
    return out


def test_erasing_undo_and_redo(spark):
    """An eraser on a mask that heals everywhere: its centre is protected, healed again after undo, protected after redo."""
    log = [(1, 0, "add"), (1, 1, "undo"), (1, 2, "redo")]
    for n, centre in ((1, 0.0), (2, 1.0), (3, 0.0)):
        standing = strokes.standing_strokes(spark.createDataFrame(log[:n], "image int, seq long, action string"))
        drawn = standing.select("image", "place", F.array(F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))).alias("points"), F.lit(0.05).alias("radius"), F.lit(False).alias("heal"), F.lit(0.0).alias("softness"), F.lit(200).alias("width"), F.lit(200).alias("height"))
        a = canvas(strokes.painted_mask(drawn), (200, 200))
        assert a[100, 100] == centre and a[0, 0] == 1 and a[100, 111] == 1 and a[100, 110] == centre


def by_canvas(rows, shape, base):
    h, w = shape
    y, x = np.mgrid[0:h, 0:w].astype(float)
    mask = base.copy()
    for _, _, points, radius, heal, softness, *_ in rows:
        r = max(2, int(radius * min(w, h)))
        drawn = np.zeros(shape)
        spots = [(np.floor(np.clip(px * w, 0, w - 1)), np.floor(np.clip(py * h, 0, h - 1))) for px, py in points]
        for (ax, ay), (bx, by) in zip([spots[0], *spots], spots, strict=False):
            dx, dy = bx - ax, by - ay
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy or 1), 0, 1)
            drawn[(x - ax - dx * t) ** 2 + (y - ay - dy * t) ** 2 <= r * r + 1e-9] = 1
        if softness > 0.05:
            d = np.arange(-r, r + 1)
            weights = np.exp(-(d**2) / (2 * max(1.0, r * softness) ** 2))
            weights /= weights.sum()
            drawn = kernels.along(kernels.along(np.pad(drawn, r, "reflect"), weights, 0), weights, 1)
        mask = np.maximum(mask, drawn) if heal else np.minimum(mask, 1 - drawn)
    return mask


def test_masks_of_hard_and_soft_strokes(spark):
    """Soft edges reach over the border, strokes act in order, a base mask lies below."""
    rows = [
        (1, 0, [(0.1, 0.1), (0.6, 0.4)], 0.08, False, 0.5, 50, 40),
        (1, 1, [(0.3, 0.3)], 0.2, True, 0.0, 50, 40),
        (1, 2, [(0.95, 0.9), (1.2, 0.5), (0.5, 0.5)], 0.06, False, 0.9, 50, 40),
        (1, 3, [(0.0, 0.0)], 0.0, True, 0.3, 50, 40),
    ]
    df = spark.createDataFrame(rows, STROKE)
    assert np.allclose(canvas(strokes.painted_mask(df), (40, 50)), by_canvas(rows, (40, 50), np.ones((40, 50))))
    base = np.random.default_rng(1).random((40, 50))
    table = spark.createDataFrame([(1, x, y, float(base[y, x])) for y in range(40) for x in range(50)], "image int, x int, y int, mask double")
    assert np.allclose(canvas(strokes.painted_mask(df, base=table), (40, 50)), by_canvas(rows, (40, 50), base))
    assert strokes.painted_mask(df.limit(0)).count() == 0


def test_composite(spark):
    df = spark.createDataFrame([(100.0, 200.0, 0.5, 100.0), (100.0, 200.0, 1.0, 0.0), (100.0, 200.0, 1.0, 250.0)], "o double, h double, m double, p double")
    assert [r[0] for r in df.select(strokes.composite(F.col("o"), F.col("h"), F.col("m"), F.col("p"))).collect()] == [150.0, 100.0, 200.0]
