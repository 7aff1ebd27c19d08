"""Shapes of faces against whole-image grids."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.operators import face_geometry as G

SPOT = "struct<x: double, y: double>"
FACE = f"image int, face int, box struct<x: double, y: double, w: double, h: double>, left {SPOT}, right {SPOT}, nose {SPOT}, mouth_left {SPOT}, mouth_right {SPOT}"
ROWS = [
    (1, 0, (20.0, 15.0, 40.0, 50.0), (30.0, 30.0), (50.0, 30.0), (40.0, 42.0), (32.0, 52.0), (48.0, 52.0)),
    (1, 1, (75.0, 5.0, 20.0, 24.0), (80.0, 14.0), (90.0, 18.0), (83.0, 22.0), (78.0, 24.0), (87.0, 28.0)),  # leans to the right
    (2, 5, (-5.0, -5.0, 20.0, 20.0), (0.0, 2.0), (8.0, 2.0), (4.0, 6.0), (1.0, 9.0), (7.0, 9.0)),  # cut by the border
]


@pytest.fixture(scope="module")
def frames(spark):
    return G.face_frames(spark.createDataFrame(ROWS, FACE)).cache()


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([(1, 100, 80), (2, 40, 30), (3, 10, 10)], "image int, width int, height int")


def test_frames_turn_with_the_eyes(frames):
    got = {(r.image, r.face): r for r in frames.collect()}
    assert got[1, 0].iod == 20 and got[1, 0].turn == 0 and tuple(got[1, 0].origin) == (40.0, 30.0)
    assert got[1, 1].turn == pytest.approx(np.degrees(np.arctan2(4, 10))) and got[1, 1].mouth_half == pytest.approx(np.hypot(9, 4) / np.hypot(10, 4) / 2)


def grid(image):
    w, h = {1: (100, 80), 2: (40, 30)}[image]
    return np.mgrid[0:h, 0:w][::-1].astype(float)


def test_ellipses_cover_what_the_formula_says(frames, sizes):
    shapes = G.part_ellipses(frames, G.FEATURES | G.EYE_BAGS).unionByName(G.face_ovals(frames, 1.4)).unionByName(G.part_ellipses(frames, G.SAMPLES, least=2))
    got = {}
    for r in G.ellipse_pixels(shapes, sizes).collect():
        got.setdefault((r.image, r.face, r.part), set()).add((r.x, r.y))
    seen = 0
    for s in shapes.collect():
        x, y = grid(s.image)
        along, across = (x - s.cx) * s.ux + (y - s.cy) * s.uy, (y - s.cy) * s.ux - (x - s.cx) * s.uy
        inside = (along / s.ax) ** 2 + (across / s.ay) ** 2 <= 1 + 1e-9
        assert got.get((s.image, s.face, s.part), set()) == {(int(a), int(b)) for a, b in zip(x[inside], y[inside], strict=True)}
        seen += inside.any()
    assert seen > 30
    eye = next(s for s in shapes.collect() if (s.image, s.face, s.part) == (1, 0, "left eye"))
    assert (eye.cx, eye.cy, eye.ax, eye.ay) == (30, 30, 7, 4)


def test_body_reaches_below_the_face(frames, sizes):
    got = {(r.face, r.x, r.y) for r in G.body_pixels(frames.where("image = 1"), sizes).collect()}
    assert (0, 40, 30) in got and (0, 40, 79) in got and (0, 5, 79) in got and (0, 5, 40) not in got
    assert len({g for g in got if g[0] == 0}) == len([g for g in got if g[0] == 0])


def test_pixels_belong_to_the_nearest_face(spark, frames):
    pixels = spark.createDataFrame([(i, x, y) for i in (1, 3) for x in range(0, 100, 7) for y in range(0, 80, 7)], "image int, x int, y int")
    far = lambda r, x, y: np.hypot(x - (r[3][0] + r[4][0]) / 2, y - (r[3][1] + r[4][1]) / 2) / max(np.hypot(r[4][0] - r[3][0], r[4][1] - r[3][1]), 1)
    for r in G.owners(pixels, frames).collect():
        want = min((far(f, r.x, r.y), f[1]) for f in ROWS if f[0] == 1)[1] if r.image == 1 else None
        assert r.owner == want


def test_marks_for_the_white_balance(spark, frames, sizes):
    pixels = spark.createDataFrame([(1, x, y) for x in range(100) for y in range(80)] + [(3, 0, 0)], "image int, x int, y int")
    marked = G.with_face_marks(pixels, frames, sizes)
    assert marked.count() == 8001
    got = marked.groupBy("image").agg(F.sum("apart").alias("apart"), F.count_if("skin").alias("skin")).collect()
    found = {r.image: (r.apart, r.skin) for r in got}
    assert found[3] == (0.0, 0) and found[1][0] > 1000 and 60 < found[1][1] < found[1][0]


def test_no_faces(frames, sizes):
    assert G.ellipse_pixels(G.part_ellipses(frames.limit(0), G.FEATURES), sizes).count() == 0
    assert G.body_pixels(frames.limit(0), sizes).count() == 0
