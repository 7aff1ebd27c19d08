"""Tiles, filters and white balance against whole-image arrays and scenes of known light."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import kernels
from shutterlake.functions.images import blend_weights
from shutterlake.operators import straighten, tiles
from shutterlake.operators import white_balance as wb


def table_of(spark, image, **channels):
    first = next(iter(channels.values()))
    y, x = np.mgrid[0 : first.shape[0], 0 : first.shape[1]]
    return spark.createDataFrame(pd.DataFrame({"image": image, "x": x.ravel(), "y": y.ravel(), **{k: v.ravel().astype(float) for k, v in channels.items()}}))


def array_of(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("x", "y", column).collect():
        assert np.isnan(out[r.y, r.x])
        out[r.y, r.x] = r[column]
    return out


@pytest.mark.parametrize("repeat_edge,mode", [(False, "reflect"), (True, "symmetric")])
@pytest.mark.parametrize("shape", [(37, 50), (3, 40), (1, 9), (16, 16)])
def test_tiles_bring_their_surroundings(spark, shape, repeat_edge, mode):
    """Also where the halo is wider than the image."""
    a = np.random.default_rng(1).random(shape)
    got = tiles.map_tiles(table_of(spark, "i", v=a), ("v",), lambda t: {"s": kernels.box(t["v"], 5)}, ("s",), 5, size=16, repeat_edge=repeat_edge)
    want = kernels.box(np.pad(a, 5, mode), 5)
    assert np.allclose(array_of(got, "s", shape), want)


def test_filters_equal_their_definitions():
    a = np.random.default_rng(2).random((30, 40))
    w = kernels.gaussian_weights(1.0)
    assert len(w) == 9 and kernels.gaussian_radius(2.0) == 8 and abs(w.sum() - 1) < 1e-12
    assert kernels.box(a, 2)[3, 4] == pytest.approx(a[3:8, 4:9].mean())
    assert kernels.laplacian(a)[0, 0] == pytest.approx(a[0, 1] + a[2, 1] + a[1, 0] + a[1, 2] - 4 * a[1, 1])
    flat = kernels.guided(np.full((30, 30), 5.0), a[:30, :30], 3, 1e-2)
    assert np.allclose(flat, kernels.box(kernels.box(a[:30, :30], 3), 3))  # a flat guide keeps no edge
    step = np.where(np.arange(40) < 20, 0.0, 100.0) * np.ones((40, 1))
    assert np.abs(kernels.guided(step, step, 3, 1e-2) - step[6:-6, 6:-6]).max() < 0.1  # a strong edge stays
    mask = np.zeros((30, 40))
    mask[10:20, 10:20] = 1
    assert np.allclose(kernels.masked_blur(np.full((30, 40), 7.0), mask, 1.0)[8:14, 8:14], 7.0)


def test_filters_across_tiles_equal_whole_images(spark):
    rng = np.random.default_rng(3)
    a, m = rng.random((45, 33)) * 255, (rng.random((45, 33)) > 0.5).astype(float)
    df = table_of(spark, "i", v=a, m=m)
    pad = np.pad(a, 8, "symmetric")
    assert np.allclose(array_of(tiles.guided_filter(df, "v", "v", 4, 50.0, size=16), "smooth", a.shape), kernels.guided(pad, pad, 4, 50.0))
    r = kernels.gaussian_radius(1.2)
    assert np.allclose(array_of(tiles.masked_gaussian(df, "v", "m", 1.2, size=16), "smooth", a.shape), kernels.masked_blur(np.pad(a, r, "symmetric"), np.pad(m, r, "symmetric"), 1.2))


def test_overlapping_tiles_give_back_the_image(spark):
    y, x = np.mgrid[0:600, 0:800]
    a = (x * 0.3 + y * 0.2) % 256 // 1
    got = array_of(tiles.overlap_add(table_of(spark, "i", v=a), ("v",), lambda t: t, 256, 32), "v", a.shape)
    assert np.abs(got - a).max() < 1e-6
    small = array_of(tiles.overlap_add(table_of(spark, "i", v=a[:20, :300]), ("v",), lambda t: {"v": t["v"] + (t["v"].shape == (256, 256))}, 256, 32), "v", (20, 300))
    assert np.abs(small - np.minimum(a[:20, :300] + 1, 255)).max() < 1e-6  # low images are mirrored up to the tile


def test_overlapping_tiles_hold_odd_tables(spark):
    """Nulls count as zero, several images stay apart, results are held within 0 to 255, an empty table gives none."""
    df = spark.createDataFrame([("a", 0, 0, 300.0), ("a", 1, 0, None), ("b", 0, 0, -5.0)], "image string, x int, y int, v double")
    got = sorted(tuple(r) for r in tiles.overlap_add(df, ("v",), lambda t: t, 8, 2).collect())
    assert got == [("a", 0, 0, 255.0), ("a", 1, 0, 0.0), ("b", 0, 0, 0.0)]
    assert tiles.overlap_add(df.limit(0), ("v",), lambda t: t, 8, 2).count() == 0
    assert tiles.map_tiles(df.limit(0), ("v",), lambda t: t, ("v",), 1).count() == 0
    with pytest.raises(ValueError):
        tiles.overlap_add(df, ("v",), lambda t: t, 8, 8)


def test_blend_weights():
    assert np.allclose(blend_weights(8, 4), [0, 0.1464466, 0.5, 0.8535534, 0.8535534, 0.5, 0.1464466, 0], atol=1e-6)
    assert blend_weights(8, 4, first=True)[:4].tolist() == [1, 1, 1, 1] and blend_weights(5, 0).tolist() == [1] * 5


# --- white balance ---------------------------------------------------------------

CASTS = {"none": (1.0, 1.0, 1.0), "green": (0.88, 1.0, 0.86), "blue": (0.78, 0.9, 1.0), "tungsten": (1.0, 0.72, 0.42)}
PATCHES = [(0.45,) * 3, (0.2,) * 3, (0.7,) * 3, (0.5, 0.25, 0.15), (0.15, 0.3, 0.5), (0.2, 0.45, 0.2), (0.55, 0.5, 0.15), (0.35,) * 3, (0.6,) * 3, (0.4, 0.2, 0.35), (0.3,) * 3, (0.12,) * 3]


def to_levels(x):
    return np.floor(np.where(x <= 0.0031308, x * 12.92, 1.055 * np.power(x, 1 / 2.4) - 0.055) * 255)


@pytest.fixture(scope="module")
def scenes(spark):
    """A chart of grey and coloured patches with shading, under each light."""
    rng = np.random.default_rng(3)
    chart = np.array([PATCHES[(y // 75 * 4 + x // 112) % 12] for y in range(300) for x in range(448)]).reshape(300, 448, 3)
    chart = np.minimum(chart * np.clip(1 + 0.25 * rng.standard_normal((300, 448, 1)), 0.4, 1.6), 1)
    frames = []
    for name, cast in CASTS.items():
        u = chart * np.array(cast)
        u = to_levels(u / u.max())
        frames.append(table_of(spark, name, r=u[..., 0], g=u[..., 1], b=u[..., 2]))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    return {r.image: r for r in wb.analyze(df).collect()}


def residual(scenes, name):
    g = np.array(scenes[name].gains) * np.array(CASTS[name])
    return g / g[1]


def test_neutral_scene_is_left_alone(scenes):
    g = np.array(scenes["none"].gains)
    assert np.abs(g / g[1] - 1).max() < 0.06 and scenes["none"].cast == "neutral"


def test_green_and_blue_casts_are_removed(scenes):
    r, b = residual(scenes, "green"), residual(scenes, "blue")
    assert abs(r[0] - 1) < 0.06 and abs(r[2] - 1) < 0.06
    assert abs(b[0] - 1) < 0.07 and abs(b[2] - 1) < 0.07


def test_tungsten_stays_in_part(scenes):
    r = residual(scenes, "tungsten")
    assert 1.02 < r[0] < 1.30 and r[2] > 0.70
    assert "warm" in scenes["tungsten"].cast and scenes["tungsten"].kelvin < 5000


def test_scene_of_one_colour_is_trusted_less(spark):
    rng = np.random.default_rng(4)
    shade = 0.6 + 0.3 * rng.random((60, 60))
    df = table_of(spark, "wall", r=to_levels(shade * 0.15), g=to_levels(shade * 0.25), b=to_levels(shade * 0.8))
    wall = df.unionByName(df.withColumns({"image": F.lit("grey"), "r": F.col("b"), "g": F.col("b")}))
    found = {r.image: r for r in wb.analyze(wall).collect()}
    assert not found["grey"].dominant and found["grey"].cast == "neutral"
    assert found["wall"].grey_pixels >= 0 and found["wall"].confidence <= 1


def test_small_and_empty_images_are_left_as_they_are(spark):
    df = spark.createDataFrame([("a", x, y, 200.0, 100.0, 50.0) for x in range(5) for y in range(5)], "image string, x int, y int, r double, g double, b double")
    (row,) = wb.analyze(df).collect()
    assert row.gains == [1.0, 1.0, 1.0] and row.confidence == 0 and row.kelvin is None and row.skin_note is None
    assert wb.analyze(df.limit(0)).count() == 0


def test_skin_holds_a_correction_back(spark):
    """Natural skin before a blue wall: the gains that the wall asks for would turn it."""
    rng = np.random.default_rng(5)
    shade = 0.5 + 0.4 * rng.random((80, 80))
    rgb = np.stack([shade * 0.25, shade * 0.4, shade * 0.9], -1)
    rgb[20:50, 20:50] = (np.array([0.42, 0.22, 0.14]) * (0.9 + 0.2 * rng.random((30, 30, 1))))
    df = table_of(spark, "i", r=to_levels(rgb[..., 0]), g=to_levels(rgb[..., 1]), b=to_levels(rgb[..., 2]))
    marked = df.withColumn("skin", F.col("x").between(20, 49) & F.col("y").between(20, 49)).withColumn("apart", F.col("skin").cast("double"))
    (plain,), (held,) = wb.analyze(df).collect(), wb.analyze(marked).collect()
    assert plain.skin_before is None and held.skin_before is not None and held.skin_note is not None
    assert abs(held.skin_after - 41) < 12


def test_effective_gains(spark):
    rows = [([1.2, 1.0, 0.8], 0.0, True), ([1.2, 1.0, 0.8], 100.0, True), ([1.2, 1.0, 0.8], 100.0, False), (None, 100.0, True), ([1.0, 1.0], 100.0, True), ([1.2, 1.0, 0.8], None, None), ([1.002, 1.0, 1.001], 100.0, True)]
    df = spark.createDataFrame(rows, "g array<double>, s double, e boolean")
    got = [r[0] for r in df.select(wb.effective_gains(F.col("g"), F.col("s"), F.col("e"))).collect()]
    assert [g is None for g in got] == [True, False, True, True, True, False, True]
    assert got[1][0] > got[1][2] and got[1] == got[5]


def test_gains_keep_neutral_and_range(spark):
    df = spark.createDataFrame([(128.0, 1.0), (250.0, 1.5), (250.0, 0.7), (0.0, 3.0), (40.0, None)], "c double, g double")
    got = [r[0] for r in df.select(wb.balanced_in_light(F.col("c"), F.col("g"))).collect()]
    assert abs(got[0] - 128) < 0.6 and 250 < got[1] <= 255 and got[2] < 250 and got[3] == 0 and got[4] == 40


# --- straighten angle -------------------------------------------------------------


def stripes(tilt, level=False, height=260, width=320):
    """Wide stripes that lean counter-clockwise by a tilt in degrees, with a little noise."""
    y, x = np.mgrid[0:height, 0:width].astype(float)
    s = np.tan(np.radians(tilt))
    across = y + x * s if level else x - y * s
    return np.where(np.floor(across / 40) % 2 == 0, 200.0, 40.0) + np.random.default_rng(1).random((height, width)) * 5


def test_straighten_angle_of_known_tilts(spark):
    cases = {"up 2": (stripes(2.0), -2.0), "up -1.5": (stripes(-1.5), 1.5), "up 0": (stripes(0.0), 0.0), "up 4.5": (stripes(4.5), -3.0), "level 2": (stripes(2.0, True), -2.0), "level -1": (stripes(-1.0, True), 1.0), "steep": (stripes(20.0), 0.0), "noise": (np.random.default_rng(2).random((260, 320)) * 255, 0.0), "flat": (np.full((260, 320), 90.0), 0.0)}
    df = None
    for name, (a, _) in cases.items():
        own = table_of(spark, name, grey=a)
        df = own if df is None else df.unionByName(own)
    got = {r.image: r for r in straighten.straighten_angles(df, rules=straighten.LineRules(least_votes=200)).collect()}
    assert {k: r.angle for k, r in got.items()} == {k: want for k, (_, want) in cases.items()}
    assert got["flat"].n_lines == 0 and got["up 2"].n_lines >= 5


def test_lines_must_agree(spark):
    sizes = spark.createDataFrame([(i, 100, 100) for i in range(7)], "image int, width int, height int")
    rows = [(0, True, t, 60.0) for t in (1.0, 1.0, 2.0)]  # the median by length
    rows += [(1, True, t, 60.0) for t in (-4.0, 0.0, 4.0)]  # no agreement
    rows += [(2, True, t, 60.0) for t in (1.0, 1.0)]  # too few
    rows += [(3, True, 1.0, 30.0)] * 3  # too short in all
    rows += [(4, False, -1.0, 60.0)] * 3 + [(4, False, 4.0, 30.0)] * 9  # short level lines do not count
    rows += [(5, True, 7.0, 60.0)] * 3  # too steep to be a tilt
    found = spark.createDataFrame(rows, "image int, upright boolean, tilt double, length double")
    assert {r.image: (r.upright, r.tilt) for r in straighten.agreed_tilt(found, sizes).collect()} == {0: (True, 1.0), 4: (False, -1.0)}
    got = [r[0] for r in spark.createDataFrame([(0.4,), (0.5,), (-2.0,), (4.0,), (None,)], "t double").select(straighten.correction(F.col("t"), straighten.LineRules())).collect()]
    assert got == [0.0, -0.5, 2.0, -3.0, 0.0]
