"""Neighbourhood and colour operators over images that Spark makes of the embeddings: 120 vectors are the rows of an image of 21 colour pixels a row."""

from __future__ import annotations

from math import cos, radians, sin

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import columns as C
from shutterlake.functions import kernels
from shutterlake.operators import face_geometry, straighten, strokes, tiles
from shutterlake.operators import white_balance as wb
from shutterlake.plans.registry import query
from shutterlake.sources.tables import table

ROWS, COLUMNS = 120, 21
#: Faces whose shapes one task works on.
FACES_A_TASK = 5_000
#: How vectors become images, in expressions that Spark and DuckDB read alike; each image has a cast, one corner that is no grey, and every other one a patch of skin.
_IMAGE = {
    "image": "cast(floor(vec_id / 120) as bigint)",
    "x": "cast(x as int)",
    "y": "cast(vec_id % 120 as int)",
    "r": "floor(greatest(least(128 + 250 * cast(r as double) + 40 * cast(g as double), 255), 0) * (1 - floor(vec_id / 120) % 4 * 0.1))",
    "g": "floor(greatest(least(128 + 250 * cast(r as double), 255), 0) * (1 - floor(vec_id / 120) % 3 * 0.08))",
    "b": "floor(greatest(least(128 + 250 * cast(r as double) + 40 * cast(b as double), 255), 0) * (0.7 + floor(vec_id / 120) % 5 * 0.075))",
    "apart": "case when x >= 18 and vec_id % 120 < 12 then 1.0 else 0.0 end",
    "skin": "x between 3 and 8 and vec_id % 120 between 4 and 14 and floor(vec_id / 120) % 2 = 0",
}


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, x, y, r, g, b, apart, skin: a table of pixels."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    cells = vectors.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(COLUMNS - 1))).alias("x"))
    cells = cells.select("vec_id", "x", *[F.get("embedding", F.col("x") * 3 + k).alias(c) for k, c in enumerate("rgb")])
    return cells.selectExpr(*[f"{e} as {k}" for k, e in _IMAGE.items()])


_PIXELS = f"""cells AS (SELECT vec_id, x, embedding[3 * x + 1] AS r, embedding[3 * x + 2] AS g, embedding[3 * x + 3] AS b FROM (SELECT *, unnest(range({COLUMNS})) AS x FROM embeddings)),
px AS (SELECT {", ".join(f"{e} AS {k}" for k, e in _IMAGE.items())} FROM cells), sz AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY image)"""


def _pad(name: str, source: str, columns: str, halo: int, edge: int) -> str:
    """A CTE of pixels and their mirror images, at px, py. edge: 1 if mirrors stand behind the border pixel."""
    at = lambda c, n: f"unnest(list_distinct(list_filter([{c}, -{c} - {edge}, 2 * {n} - 2 + {edge} - {c}], lambda p: p >= -{halo} AND p < {n} + {halo})))"
    return f"{name}x AS (SELECT image, y, w, h, {columns}, {at('x', 'w')} AS px FROM {source} JOIN sz USING (image)), {name} AS (SELECT image, w, h, px, {columns}, {at('y', 'h')} AS py FROM {name}x)"


def _conv(name: str, source: str, columns: tuple[str, ...], weights: np.ndarray) -> str:
    """CTEs that weigh neighbours along x, then along y; places that lack one go."""
    n, r = len(weights), len(weights) // 2
    values = ", ".join(f"({d}, {float(w)!r})" for d, w in zip(range(-r, r + 1), weights, strict=True))
    sums = ", ".join(f"sum({c} * wt) AS {c}" for c in columns)
    return f"""{name}k(d, wt) AS (VALUES {values}), {name}h AS (SELECT image, px - d AS px, py, {sums} FROM {source}, {name}k GROUP BY ALL HAVING count(*) = {n}),
{name} AS (SELECT image, px, py - d AS py, {sums} FROM {name}h, {name}k GROUP BY ALL HAVING count(*) = {n})"""


_BOX3 = np.full(3, 1 / 3)
_RGB = ("r", "g", "b")


# --- filters --------------------------------------------------------------------


@query(f"""WITH {_PIXELS}, y AS (SELECT image, x, y, r * 0.299 + g * 0.587 + b * 0.114 AS v, r AS s FROM px), {_pad("pad", "y", "v, s", 8, 1)}, q AS (SELECT image, px, py, v, s, v * v AS vv, v * s AS vs FROM pad),
{_conv("m", "q", ("v", "s", "vv", "vs"), np.full(9, 1 / 9))}, l AS (SELECT image, px, py, (vs - v * s) / (vv - v * v + 40.0) AS a, s - (vs - v * s) / (vv - v * v + 40.0) * v AS c FROM m), {_conv("n", "l", ("a", "c"), np.full(9, 1 / 9))}
SELECT y.image, y.x, y.y, round(a * v + c, 4) AS smooth FROM y JOIN n ON n.image = y.image AND px = x AND py = y.y""")
def guided_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red smoothed where luma is flat, its edges kept."""
    p = images(spark, sf_dir).select("image", "x", "y", (F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114).alias("v"), "r")
    return tiles.guided_filter(p, "v", "r", 4, 40.0, size=16).select("image", "x", "y", F.round("smooth", 4).alias("smooth"))


@query(f"""WITH {_PIXELS}, y AS (SELECT image, x, y, g, CASE WHEN r > b THEN 1.0 ELSE 0.25 * (1 - apart) END AS m FROM px), {_pad("pad", "y", "g, m", kernels.gaussian_radius(1.5), 1)}, q AS (SELECT image, px, py, g * m AS gm, m FROM pad),
{_conv("n", "q", ("gm", "m"), kernels.gaussian_weights(1.5))} SELECT y.image, x, y.y, round(gm / greatest(n.m, 1e-4), 4) AS smooth FROM y JOIN n ON n.image = y.image AND px = x AND py = y.y""")
def masked_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Green blurred from what a mask shows."""
    p = images(spark, sf_dir).select("image", "x", "y", "g", F.when(F.col("r") > F.col("b"), 1.0).otherwise(0.25 * (1 - F.col("apart"))).alias("m"))
    return tiles.masked_gaussian(p, "g", "m", 1.5, size=16).select("image", "x", "y", F.round("smooth", 4).alias("smooth"))


_TILE, _OVERLAP = 16, 6
_STARTS = "list_distinct(list_concat(range(0, greatest({n} - 16, 1), 10), [greatest({n} - 16, 0)]))"
_RAMP = "pow(sin(pi() / 2 * least(least(CASE WHEN {t} = 0 THEN 6 ELSE {p} - {t} END, CASE WHEN {t} + 16 >= {n} THEN 6 ELSE {t} + least(16, {n}) - 1 - {p} END) / 6.0, 1)), 2)"


@query(f"""WITH {_PIXELS}, tx AS (SELECT px.*, w, h, unnest({_STARTS.format(n="w")}) AS tx FROM px JOIN sz USING (image)), t AS (SELECT *, unnest({_STARTS.format(n="h")}) AS ty FROM tx WHERE x BETWEEN tx AND tx + 15),
d AS (SELECT *, {_RAMP.format(t="tx", p="x", n="w")} * {_RAMP.format(t="ty", p="y", n="h")} AS wt, avg(r) OVER (PARTITION BY image, tx, ty) AS m FROM t WHERE y BETWEEN ty AND ty + 15)
SELECT image, x, y, floor(greatest(least(sum((128 + r - m) * wt) / greatest(sum(wt), 1e-5), 255), 0) * 1000 + 0.01)::BIGINT AS r FROM d GROUP BY ALL""")
def blended_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red, in thousandths, as its difference from the mean of its tile; overlapping tiles blend without a seam."""
    return tiles.overlap_add(images(spark, sf_dir), ("r",), lambda a: {"r": 128 + a["r"] - a["r"].mean()}, _TILE, _OVERLAP).select("image", "x", "y", F.floor(F.col("r") * 1000 + 0.01).cast("long").alias("r"))


# --- straighten angle -----------------------------------------------------------

#: Stripes of a slope of their own lie over each image, so that there are lines to find.
_STRIPES = "case when pmod(x * 50 + y * (image % 5 - 2), 500) < 250 then r / 64 else 190 + r / 64 end"
_RULES = straighten.LineRules(edge=300.5, least_votes=100)
_TURNS = ", ".join(f"({up}, {t}, {cos(radians(t * 0.5))!r}::DOUBLE, {sin(radians(t * 0.5))!r}::DOUBLE)" for up in (True, False) for t in range(-10, 11))


@query(f"""WITH {_PIXELS}, y AS (SELECT image, x, y, {_STRIPES.replace("pmod(x * 50 + y * (image % 5 - 2), 500)", "(x * 50 + y * (image % 5 - 2) + 35000) % 500")} AS v FROM px), {_pad("pad", "y", "v", 2, 0)}, {_conv("s", "pad", ("v",), np.array([0.25, 0.5, 0.25]))}, sobel(dx, dy, wx, wy) AS (VALUES {", ".join(f"({dx}, {dy}, {dx * (2 - abs(dy))}, {dy * (2 - abs(dx))})" for dx in (-1, 0, 1) for dy in (-1, 0, 1))}),
e AS (SELECT image, px - dx AS x, py - dy AS y FROM s, sobel GROUP BY ALL HAVING count(*) = 9 AND sqrt(pow(sum(v * wx), 2) + pow(sum(v * wy), 2)) >= 300.5), turns(up, tilt, c, s) AS (VALUES {_TURNS}),
v AS (SELECT image, up, tilt, round(CASE WHEN up THEN x * c - y * s ELSE y * c + x * s END)::INT AS rho, count(*) AS votes FROM e, turns GROUP BY ALL HAVING count(*) >= 100),
l AS (SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.image = a.image AND b.up = a.up AND abs(b.tilt - a.tilt) <= 1 AND abs(b.rho - a.rho) <= 1 AND (b.votes, -b.tilt, -b.rho) > (a.votes, -a.tilt, -a.rho))),
f AS (SELECT image, up, tilt * 0.5 AS tilt, votes AS len, w, h, sum(votes) OVER (PARTITION BY image, up) AS total, count(*) OVER (PARTITION BY image, up) AS n, sum(votes) OVER (PARTITION BY image, up ORDER BY tilt) AS so_far FROM l JOIN sz USING (image) WHERE up OR votes >= 0.35 * w),
m AS (SELECT *, min(CASE WHEN so_far >= total / 2 THEN tilt END) OVER (PARTITION BY image, up) AS med FROM f), a AS (SELECT image, up, any_value(med) AS tilt FROM m GROUP BY image, up HAVING any_value(n) >= 3 AND any_value(total) >= any_value(CASE WHEN up THEN 1.2 * h ELSE 1.5 * w END) AND sum(abs(tilt - med) * len) / sum(len) <= 0.8),
b AS (SELECT image, arg_max(tilt, up) AS tilt FROM a GROUP BY image), n AS (SELECT image, count(*) AS n_lines FROM l GROUP BY image)
SELECT image, CASE WHEN abs(tilt) >= 0.5 THEN round(greatest(least(-tilt, 3.0), -3.0), 1) ELSE 0.0 END::DOUBLE AS angle, coalesce(n_lines, 0) AS n_lines FROM sz LEFT JOIN b USING (image) LEFT JOIN n USING (image)""")
def straighten_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle that straightens each image, and how many lines it has."""
    p = images(spark, sf_dir).select("image", "x", "y", F.expr(_STRIPES).alias("grey"))
    return straighten.straighten_angles(p, rules=_RULES, size=32)


# --- white balance --------------------------------------------------------------


def _lin(c: str) -> str:
    return f"CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92 ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END"


def _clip(x: str, low: float, high: float) -> str:
    return f"greatest(least({x}, {high}), {low})"


def _lab(r: str, g: str, b: str) -> tuple[str, str]:
    xyz = [f"(({r}) * {m[0]} + ({g}) * {m[1]} + ({b}) * {m[2]}) / {w}" for m, w in zip(wb.TO_XYZ, wb.WHITE, strict=True)]
    x, y, z = (f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE ({t}) * 7.787 + 16.0 / 116 END" for t in xyz)
    return f"(({x}) - ({y})) * 500", f"(({y}) - ({z})) * 200"


def _hue(gains: tuple[str, str, str]) -> str:
    a, b = _lab(*[_clip(f"skin_{c} * exp({g})", 0.0, 1.0) for c, g in zip("rgb", gains, strict=True)])
    return f"CASE WHEN skin_r IS NOT NULL THEN degrees(atan2({b}, {a})) END"


def _light(r: str, g: str, b: str) -> str:
    return f"greatest({r} * 0.2126 + {g} * 0.7152 + {b} * 0.0722, 1e-6)"


_KEPT = ("a0", "a1", "a2")
_SOBEL = ", ".join(f"({dx}, {dy}, {dx * (2 - abs(dy))}, {dy * (2 - abs(dx))})" for dx in (-1, 0, 1) for dy in (-1, 0, 1))
_GRID = ", ".join(f"({i}, {float(t)!r}, {float(n)!r})" for i, (t, n) in enumerate((t, n) for t in np.linspace(-0.35, 0.35, 15) for n in np.linspace(-0.2, 0.2, 9)))
_EVEN_A, _EVEN_B = _lab(*[_clip(f"{c} * i_{c} / {_light('i_r', 'i_g', 'i_b')}", 0.0, 1.0) for c in "rgb"])
_X, _Y, _Z = (f"(l_r * {m[0]} + l_g * {m[1]} + l_b * {m[2]})" for m in wb.TO_XYZ_TEMPERATURE)

WHITE_BALANCE = f"""WITH {_PIXELS}, lin AS (SELECT image, x, y, {", ".join(f"{_lin(c)} AS {c}" for c in _RGB)}, (r + g + b) / 3 AS level, apart, skin FROM px),
{_pad("pad", "lin", "r, g, b", 12, 0)}, {_conv("n", "pad", _RGB, kernels.gaussian_weights(1.0))}, lg AS (SELECT image, px, py, ln(r + 1e-4) AS r, ln(g + 1e-4) AS g, ln(b + 1e-4) AS b FROM n), {_conv("s", "lg", _RGB, kernels.gaussian_weights(1.0))},
cross5(dx, dy, wt) AS (VALUES (0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)),
c AS (SELECT image, px - dx AS px, py - dy AS py, abs(sum(r * wt)) AS r, abs(sum(g * wt)) AS g, abs(sum(b * wt)) AS b FROM s, cross5 GROUP BY ALL HAVING count(*) = 5),
u AS (SELECT image, px, py, (r + g + b) / 3 AS mean, sqrt((pow(r - (r + g + b) / 3, 2) + pow(g - (r + g + b) / 3, 2) + pow(b - (r + g + b) / 3, 2)) / 3) / ((r + g + b) / 3 + 1e-4) AS unlike FROM c), {_conv("v", "u", ("unlike",), np.full(7, 1 / 7))},
{_conv("o", "pad", _RGB, kernels.gaussian_weights(2.0))}, sobel(dx, dy, wx, wy) AS (VALUES {_SOBEL}),
e AS (SELECT image, px - dx AS px, py - dy AS py, {", ".join(f"sqrt(pow(sum({c} * wx), 2) + pow(sum({c} * wy), 2)) AS e_{c}" for c in "rgb")} FROM o, sobel GROUP BY ALL HAVING count(*) = 9),
f AS (SELECT lin.*, n.r AS n_r, n.g AS n_g, n.b AS n_b, (n.r + n.g + n.b) / 3 AS light, mean, v.unlike, e_r, e_g, e_b, greatest(o.r, o.g, o.b) AS wide, apart < 0.3 AND least(n.r, n.g, n.b) > 0.02 AND greatest(n.r, n.g, n.b) < 0.95 AND mean > 0.04 AS textured
  FROM lin JOIN n ON n.image = lin.image AND n.px = x AND n.py = y JOIN u ON u.image = lin.image AND u.px = x AND u.py = y JOIN v ON v.image = lin.image AND v.px = x AND v.py = y JOIN e ON e.image = lin.image AND e.px = x AND e.py = y JOIN o ON o.image = lin.image AND o.px = x AND o.py = y),
g1 AS (SELECT *, count(*) FILTER (WHERE textured) OVER (PARTITION BY image) AS nt, rank() OVER (PARTITION BY image ORDER BY textured DESC, unlike) AS rk FROM f),
g2 AS (SELECT *, quantile_cont(light, 0.25) OVER (PARTITION BY image) AS q FROM g1 WHERE textured AND nt >= 500 AND rk <= least(greatest(200, floor(nt * 0.005)), nt - 1) + 1),
g3 AS (SELECT image, light, n_r / greatest(n_r + n_g + n_b, 1e-4) AS r, n_g / greatest(n_r + n_g + n_b, 1e-4) AS g, n_b / greatest(n_r + n_g + n_b, 1e-4) AS b FROM g2 WHERE light > q),
g4 AS (SELECT *, median(r) OVER w AS mr, median(g) OVER w AS mg, median(b) OVER w AS mb FROM g3 WINDOW w AS (PARTITION BY image)),
grey AS (SELECT image, count(*) AS ng, greatest(least(1 - median(abs(r - mr) + abs(g - mg) + abs(b - mb)) / 0.06, 1), 0) * greatest(least(count(*) / 400.0, 1), 0.2) AS conf, sum(r * light) / sum(light) AS r, sum(g * light) / sum(light) AS g, sum(b * light) / sum(light) AS b FROM g4 GROUP BY image HAVING count(*) >= 50),
edge AS (SELECT image, {", ".join(f"pow(avg(pow(e_{c}, 6)), 1.0 / 6) AS {c}" for c in "rgb")} FROM f WHERE wide < 0.95 AND apart < 0.3 GROUP BY image HAVING count(*) >= 500),
b1 AS (SELECT *, quantile_cont((r + g + b) / 3, 0.99) OVER (PARTITION BY image) AS q, count(*) OVER (PARTITION BY image) AS k FROM lin WHERE apart < 0.3 AND greatest(r, g, b) < 0.97),
patch AS (SELECT image, median(r) AS r, median(g) AS g, median(b) AS b FROM b1 WHERE (r + g + b) / 3 >= q AND k >= 500 GROUP BY image HAVING count(*) >= 20),
est AS (SELECT image, ln(r / g) AS cr, ln(b / g) AS cb FROM grey WHERE conf > 0.05 UNION ALL SELECT image, ln(r / g), ln(b / g) FROM edge WHERE least(r, g, b) > 1e-6 UNION ALL SELECT image, ln(r / g), ln(b / g) FROM patch WHERE least(r, g, b) > 1e-6),
far AS (SELECT a.image, max(sqrt(pow(a.cr - b.cr, 2) + pow(a.cb - b.cb, 2))) AS far FROM est a JOIN est b USING (image) GROUP BY a.image),
k1 AS (SELECT image, median(cr) AS cr, median(cb) AS cb, count(*) AS n FROM est GROUP BY image),
k2 AS (SELECT sz.image, coalesce(cr, 0) AS cr, coalesce(cb, 0) AS cb, CASE WHEN n >= 2 THEN {_clip("exp(-far / 0.25) * 0.55 + 0.45", 0.0, 1.0)} WHEN n = 1 THEN 0.3 ELSE 0.0 END AS sure, coalesce(ng, 0) AS ng FROM sz LEFT JOIN k1 USING (image) LEFT JOIN far USING (image) LEFT JOIN grey USING (image)),
k3 AS (SELECT *, exp(cr) / ((exp(cr) + 1 + exp(cb)) / 3) AS l_r, 1 / ((exp(cr) + 1 + exp(cb)) / 3) AS l_g, exp(cb) / ((exp(cr) + 1 + exp(cb)) / 3) AS l_b FROM k2),
k4 AS (SELECT *, 1 / greatest(l_r, 1e-3) AS i_r, 1 / greatest(l_g, 1e-3) AS i_g, 1 / greatest(l_b, 1e-3) AS i_b FROM k3),
d1 AS (SELECT image, apart, {_EVEN_A} AS la, {_EVEN_B} AS lb FROM lin JOIN k4 USING (image)),
d2 AS (SELECT image, sqrt(la * la + lb * lb) > 15 AND apart < 0.3 AS colourful, CASE WHEN sqrt(la * la + lb * lb) > 15 AND apart < 0.3 THEN floor(fmod(degrees(atan2(lb, la)) + 360, 360) / 30)::INT END AS bin FROM d1),
d3 AS (SELECT image, count(*) FILTER (WHERE colourful) / count(*) AS share, {", ".join(f"count(*) FILTER (WHERE bin = {k}) AS h{k}" for k in range(12))}, count(*) AS n FROM d2 GROUP BY image),
d4 AS (SELECT image, share > 0.25 AND greatest({", ".join(f"h{k} + h{(k - 1) % 12}" for k in range(12))}) / n > 0.35 AS dominant FROM d3),
s1 AS (SELECT *, quantile_cont(level, 0.15) OVER (PARTITION BY image) AS lo, quantile_cont(level, 0.90) OVER (PARTITION BY image) AS hi, count(*) OVER (PARTITION BY image) AS k FROM lin WHERE skin),
s2 AS (SELECT image, median(r) AS skin_r, median(g) AS skin_g, median(b) AS skin_b FROM s1 WHERE level BETWEEN lo AND hi AND k >= 30 GROUP BY image HAVING count(*) >= 20),
sc AS (SELECT image, median(level) / 255 AS scene FROM lin GROUP BY image),
w0 AS (SELECT k4.*, dominant, sure * CASE WHEN dominant THEN 0.5 ELSE 1 END AS conf, skin_r, skin_g, skin_b, scene FROM k4 JOIN d4 USING (image) JOIN sc USING (image) LEFT JOIN s2 USING (image)),
w1 AS (SELECT *, {", ".join(f"ln({_clip(f'i_{c} / {_light("i_r", "i_g", "i_b")}', 0.62, 1.6)}) * conf AS a{k}" for k, c in enumerate("rgb"))} FROM w0),
w2 AS (SELECT *, {_hue(("0", "0", "0"))} AS hb, {_hue(_KEPT)} AS ha FROM w1),
w3 AS (SELECT *, coalesce(hb BETWEEN 34 AND 47 AND abs(ha - 41) > abs(hb - 41) + 3, false) AS veto, CASE {" ".join(f"WHEN abs({_hue(tuple(f'a{i} * {k}' for i in range(3)))} - 41) <= abs(hb - 41) + 3 THEN {k}" for k in (0.6, 0.35, 0.15))} ELSE 0 END AS part FROM w2),
w4 AS (SELECT * REPLACE ({", ".join(f"a{i} * CASE WHEN veto THEN part ELSE 1 END AS a{i}" for i in range(3))}) FROM w3), w5 AS (SELECT *, {_hue(_KEPT)} AS hue FROM w4),
grid(place, t, n) AS (VALUES {_GRID}), m1 AS (SELECT image, place, hue, a0 - t / 2 AS m0, a1 + n AS m1, a2 + t / 2 AS m2, abs(a0 - t / 2 - a0) + abs(a1 + n - a1) + abs(a2 + t / 2 - a2) AS far, skin_r, skin_g, skin_b FROM w5, grid WHERE NOT hue BETWEEN 34 AND 47),
m2 AS (SELECT *, {_hue(("m0", "m1", "m2"))} AS now FROM m1), m3 AS (SELECT *, CASE WHEN now BETWEEN 34 AND 47 THEN 0 ELSE least(abs(now - 34), abs(now - 47)) END * 4 + abs(now - 41) * 0.15 + far * 6 AS cost FROM m2),
best AS (SELECT image, m0, m1, m2 FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY cost, place) AS i FROM m3 WHERE cost < abs(hue - 41)) WHERE i = 1),
x1 AS (SELECT w5.*, exp(coalesce(m0, a0)) AS g0, exp(coalesce(m1, a1)) AS g1, exp(coalesce(m2, a2)) AS g2 FROM w5 LEFT JOIN best USING (image)),
x2 AS (SELECT *, (ln(g2) - ln(g0)) / 2 AS cooling, (ln(g1 / {_light("g0", "g1", "g2")}) - (ln(g0 / {_light("g0", "g1", "g2")}) + ln(g2 / {_light("g0", "g1", "g2")})) / 2) * 0.94 AS tint FROM x1),
x3 AS (SELECT *, cooling * CASE WHEN cooling > 0 THEN 1 - CASE WHEN scene < 0.18 THEN 0.15 ELSE 0.06 END ELSE 0.88 END AS cooled FROM x2), x4 AS (SELECT *, exp(-cooled - tint / 3) AS y0, exp(tint * 2 / 3) AS y1, exp(cooled - tint / 3) AS y2 FROM x3),
x5 AS (SELECT *, {", ".join(f"y{i} / {_light('y0', 'y1', 'y2')} AS z{i}" for i in range(3))}, ({_X} / ({_X} + {_Y} + {_Z}) - 0.3320) / (0.1858 - {_Y} / ({_X} + {_Y} + {_Z})) AS q FROM x4)"""


@query(
    WHITE_BALANCE
    + f"""SELECT image, round(z0, 4) AS red, round(z1, 4) AS green, round(z2, 4) AS blue, round(conf, 2) AS confidence, CASE WHEN conf > 0.05 THEN {_clip("round_even((((q * 449 + 3525) * q + 6823.3) * q + 5520.33) / 50, 0) * 50", 1800.0, 15000.0)}::INT END AS kelvin,
coalesce(nullif(concat_ws(' + ', CASE WHEN z2 > z0 * 1.06 THEN 'warm (yellow/orange)' WHEN z0 > z2 * 1.06 THEN 'cool (blue)' END, CASE WHEN z1 < (z0 + z2) / 2 * 0.96 THEN 'green' WHEN z1 > (z0 + z2) / 2 * 1.04 THEN 'magenta' END), '') || ' cast', 'neutral') AS "cast",
ng AS grey_pixels, round(hb, 1) AS skin_before, round({_hue(("ln(z0)", "ln(z1)", "ln(z2)"))}, 1) AS skin_after, CASE WHEN veto THEN 'veto, ' ELSE '' END || CASE WHEN hue BETWEEN 34 AND 47 THEN 'natural' WHEN hue IS NOT NULL THEN 'corrected' END AS skin_note, dominant FROM x5"""
)
def white_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automatic white balance of each image."""
    found = wb.analyze(images(spark, sf_dir), size=16)
    return found.select("image", *[F.col("gains")[k].alias(c) for k, c in enumerate(("red", "green", "blue"))], *found.columns[2:])


@query(
    f"""WITH {_PIXELS}, v AS (SELECT *, CASE image % 7 WHEN 0 THEN NULL WHEN 1 THEN [1.0, 1.002, 0.999] ELSE [0.8 + image % 5 * 0.1, 1.0, 1.3 - image % 6 * 0.1] END AS gains, image % 4 * 50.0 AS strength FROM px),
l AS (SELECT *, {", ".join(f"exp(ln({_clip(f'gains[{k + 1}]', 0.3, 3.0)}) * {_clip('strength', 0.0, 150.0)} / 100) AS g{k}" for k in range(3))} FROM v), e AS (SELECT *, {", ".join(f"g{k} / {_light('g0', 'g1', 'g2')} AS e{k}" for k in range(3))} FROM l),
a AS (SELECT *, gains IS NOT NULL AND greatest(abs(e0 - 1), abs(e1 - 1), abs(e2 - 1)) > 0.00401 AS act FROM e), m AS (SELECT *, {", ".join(f"({_lin(c)}) * e{k} AS t{k}" for k, c in enumerate("rgb"))} FROM a),
n AS (SELECT *, {", ".join(f"{_clip(f'CASE WHEN t{k} > 0.9 THEN tanh((t{k} - 0.9) / 0.1) * 0.1 + 0.9 ELSE t{k} END', 0.0, 1.0)} AS u{k}" for k in range(3))} FROM m)
SELECT image, {", ".join(f"sum(floor(CASE WHEN act THEN CASE WHEN u{k} <= 0.0031308 THEN u{k} * 12.92 ELSE pow(u{k}, 1 / 2.4) * 1.055 - 0.055 END * 255 ELSE {c} END * 100 + 0.001))::BIGINT AS {c}" for k, c in enumerate("rgb"))} FROM n GROUP BY image"""
)
def white_balance_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the channels, in hundredths, after gains in linear light at a strength."""
    p = images(spark, sf_dir).withColumn("gains", F.expr("case image % 7 when 0 then null when 1 then array(1.0D, 1.002D, 0.999D) else array(0.8D + image % 5 * 0.1D, 1.0D, 1.3D - image % 6 * 0.1D) end"))
    p = p.withColumn("gains", wb.effective_gains(F.col("gains"), F.col("image") % 4 * 50.0, F.lit(True)))
    made = [wb.balanced_in_light(F.col(c), F.get("gains", F.lit(k))).alias(c) for k, c in enumerate("rgb")]
    return p.select("image", *made).groupBy("image").agg(*[F.sum(F.floor(F.col(c) * 100 + 0.001)).cast("long").alias(c) for c in "rgb"])


# --- mask strokes ---------------------------------------------------------------

#: Events as the log of an editor: who acts on which image, and each added stroke's path and size.
_LOG = {
    "image": "user_id % 400",
    "seq": "event_id",
    "action": "case event_id % 7 when 3 then 'undo' when 5 then 'redo' when 6 then case when event_id % 31 = 0 then 'clear' else 'undo' end else 'add' end",
    "x0": "event_id % 10 / 10.0D",
    "y0": "event_id % 9 / 9.0D",
    "x1": "event_id % 8 / 8.0D",
    "radius": "0.03D + event_id % 5 * 0.02D",
    "heal": "event_id % 3 = 0",
}
_LOG_SQL = ", ".join(f"{e.replace('.0D', '.0').replace('3D', '3').replace('2D', '2')} AS {k}" for k, e in _LOG.items())
_STANDING = f"""RECURSIVE log AS (SELECT {_LOG_SQL} FROM events), live AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY seq) AS i FROM log a WHERE seq > coalesce((SELECT max(seq) FROM log b WHERE b.image = a.image AND b.action = 'clear'), -1)),
fold AS (SELECT image, 0::BIGINT AS i, []::BIGINT[] AS done, []::BIGINT[] AS undone FROM (SELECT DISTINCT image FROM live)
UNION ALL SELECT f.image, l.i, CASE l.action WHEN 'add' THEN list_append(done, l.seq) WHEN 'undo' THEN done[:len(done) - 1] WHEN 'redo' THEN CASE WHEN len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END ELSE done END,
CASE l.action WHEN 'add' THEN [] WHEN 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[-1]) ELSE undone END WHEN 'redo' THEN undone[:len(undone) - 1] ELSE undone END FROM fold f JOIN live l ON l.image = f.image AND l.i = f.i + 1),
ended AS (SELECT image, arg_max(done, i) AS done FROM fold GROUP BY image), standing AS (SELECT image, unnest(done) AS seq, unnest(range(len(done)))::INT AS place FROM ended)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "user_id").selectExpr(*[f"{e} as {k}" for k, e in _LOG.items()])


@query(f"WITH {_STANDING} SELECT image, seq, place FROM standing")
def standing_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strokes of each image that stand after undo and redo."""
    return strokes.standing_strokes(_log(spark, sf_dir))


@query(f"""WITH {_STANDING}, s AS (SELECT st.image, place, heal, greatest(2, floor(radius * 40)) AS r, floor(least(x0 * 60, 59)) AS ax, floor(least(y0 * 40, 39)) AS ay, floor(least(x1 * 60, 59)) AS bx FROM standing st JOIN log USING (image, seq)),
g AS (SELECT *, unnest(range(60)) AS x FROM (SELECT *, unnest(range(40)) AS y FROM s)), c AS (SELECT DISTINCT image, place, heal, x, y FROM g WHERE pow(x - greatest(least(ax, bx), least(greatest(ax, bx), x)), 2) + pow(y - ay, 2) <= r * r),
m AS (SELECT image, x, y, arg_max(heal, place) AS heal FROM c GROUP BY ALL) SELECT image, count(*) AS touched, sum(CASE WHEN heal THEN 1 ELSE 0 END)::DOUBLE AS mask FROM m GROUP BY image""")
def stroke_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pixels of each mask hard strokes touch, and the sum of the mask there."""
    log = _log(spark, sf_dir)
    spot = lambda x: F.struct(F.col(x).alias("x"), F.col("y0").alias("y"))
    painted = strokes.standing_strokes(log).join(log.drop("action"), ["image", "seq"]).select("image", "place", F.array(spot("x0"), spot("x1")).alias("points"), "radius", "heal", F.lit(0.0).alias("softness"), F.lit(60).alias("width"), F.lit(40).alias("height"))
    return strokes.painted_mask(painted).groupBy("image").agg(F.count(F.lit(1)).alias("touched"), F.sum("mask").alias("mask"))


# --- faces ----------------------------------------------------------------------

#: Customers as faces, four on an image of 120 x 90 pixels: eyes apart by 6 to 14 pixels and tilted, the other landmarks below them.
_FACE = {
    "image": "cast(floor(c_custkey / 4) as bigint)",
    "face": "c_custkey",
    "lx": "5.0 + c_custkey * 7 % 100",
    "ly": "10.0 + c_custkey * 11 % 60",
    "d": "6.0 + c_custkey % 9",
    "t": "c_custkey % 5 - 2.0",
}
_FACE_SQL = f"""c0 AS (SELECT {", ".join(f"{e.replace('5.0 +', '5.0::DOUBLE +').replace('10.0 +', '10.0::DOUBLE +').replace('6.0 +', '6.0::DOUBLE +').replace('- 2.0', '- 2.0::DOUBLE')} AS {k}" for k, e in _FACE.items())} FROM customer),
c1 AS (SELECT *, lx + d AS rx, ly + t AS ry, lx + d / 2 - t AS nx, ly + d / 2 AS ny, lx + d * 0.1 - t AS mlx, ly + d AS mly, lx + d * 0.9 - t AS mrx, ly + d + t AS mry, lx - d * 0.7 AS bx, ly - d AS by_, d * 2.3 AS bw, d * 3.1 AS bh FROM c0),
c2 AS (SELECT *, greatest(sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)), 1.0) AS iod, (lx + rx) / 2 AS ox, (ly + ry) / 2 AS oy, (mlx + mrx) / 2 AS mx, (mly + mry) / 2 AS my, sqrt(pow(mrx - mlx, 2) + pow(mry - mly, 2)) AS mw FROM c1),
fr AS (SELECT *, (rx - lx) / iod AS ux, (ry - ly) / iod AS uy, mw / iod / 2 AS mh FROM c2)"""
_PARTS = {**face_geometry.FEATURES, **face_geometry.EYE_BAGS, **face_geometry.SAMPLES}
_ANCHOR = {"left": ("lx", "ly"), "right": ("rx", "ry"), "nose": ("nx", "ny"), "mouth": ("mx", "my"), "origin": ("ox", "oy")}


def _part_sql(part: str, anchor: str, offset: tuple[float, float], axes: tuple) -> str:
    (x, y), (u, v) = _ANCHOR[anchor], offset
    ax, ay = (f"(mh + {a[1]})" if isinstance(a, tuple) else f"{a}" for a in axes)
    least = 2 if part in face_geometry.SAMPLES else 1
    whole = lambda e: f"round_even(({e})::DOUBLE, 0)"
    return f"SELECT image, face, ux, uy, '{part}' AS part, {whole(f'{x} + iod * ({u} * ux - {v} * uy)')} AS cx, {whole(f'{y} + iod * ({u} * uy + {v} * ux)')} AS cy, greatest({whole(f'{ax} * iod')}, {least}) AS ax, greatest({whole(f'{ay} * iod')}, {least}) AS ay FROM fr"


_OVAL_SQL = """SELECT image, face, ux, uy, 'oval' AS part, round_even(ox + iod * (cu * ux - cv * uy), 0) AS cx, round_even(oy + iod * (cu * uy + cv * ux), 0) AS cy, greatest(round_even(least(greatest(bw * 0.48 / iod, 0.95), 1.6) * iod, 0), 1) AS ax, greatest(round_even((b + 1.10) / 2 * iod, 0), 1) AS ay
FROM (SELECT *, (b - 1.10) / 2 AS cv, least(greatest(((bx + bw / 2 - ox) * ux + (by_ + bh / 2 - oy) * uy) / iod, -0.45), 0.45) AS cu FROM (SELECT *, least(greatest(((my - oy) * ux - (mx - ox) * uy) / iod, 0.8), 1.5) + 0.62 AS b FROM fr))"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey").selectExpr(*[f"cast({e} as {'bigint' if k in ('image', 'face') else 'double'}) as {k}" for k, e in _FACE.items()])
    at = lambda x, y: f"struct({x} as x, {y} as y)"
    marks = {"left": at("lx", "ly"), "right": at("lx + d", "ly + t"), "nose": at("lx + d / 2 - t", "ly + d / 2"), "mouth_left": at("lx + d * 0.1D - t", "ly + d"), "mouth_right": at("lx + d * 0.9D - t", "ly + d + t"), "box": "struct(lx - d * 0.7D as x, ly - d as y, d * 2.3D as w, d * 3.1D as h)"}
    return face_geometry.face_frames(c.selectExpr("image", "face", *[f"{e} as {k}" for k, e in marks.items()]))


def _spread(frames: DataFrame) -> DataFrame:
    """Frames by image in so many parts that a task's work stays the same however many faces there are."""
    return frames.repartition(C.parts(frames, FACES_A_TASK), "image")


def _sizes(frames: DataFrame) -> DataFrame:
    return frames.select("image").distinct().withColumns({"width": F.lit(120), "height": F.lit(90)})


@query(f"""WITH {_FACE_SQL}, e AS ({" UNION ALL ".join(_part_sql(p, *s) for p, s in _PARTS.items())} UNION ALL {_OVAL_SQL}),
y AS (SELECT *, unnest(range(greatest(cy - greatest(ax, ay), 0)::INT, least(cy + greatest(ax, ay), 89)::INT + 1)) AS y FROM e), p AS (SELECT *, unnest(range(greatest(cx - greatest(ax, ay), 0)::INT, least(cx + greatest(ax, ay), 119)::INT + 1)) AS x FROM y)
SELECT part, face, count(*) AS pixels, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys FROM p WHERE pow(((x - cx) * ux + (y - cy) * uy) / ax, 2) + pow(((y - cy) * ux - (x - cx) * uy) / ay, 2) <= 1 + 1e-9 GROUP BY part, face""")
def face_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pixels each part of each face covers, and where."""
    frames = _spread(_frames(spark, sf_dir))
    shapes = face_geometry.part_ellipses(frames, {**face_geometry.FEATURES, **face_geometry.EYE_BAGS}).unionByName(face_geometry.part_ellipses(frames, face_geometry.SAMPLES, least=2)).unionByName(face_geometry.face_ovals(frames))
    inside = face_geometry.ellipse_pixels(shapes, _sizes(frames))
    by_image = inside.groupBy("image", "part", "face").agg(F.count(F.lit(1)).alias("pixels"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))
    return by_image.repartition(C.parts(frames, FACES_A_TASK), "face").groupBy("part", "face").agg(*[F.sum(c).cast("long").alias(c) for c in ("pixels", "xs", "ys")])


@query(f"""WITH {_FACE_SQL}, px AS (SELECT image, x, y FROM (SELECT DISTINCT image FROM fr), (SELECT unnest(range(0, 120, 5)) AS x), (SELECT unnest(range(0, 90, 5)) AS y)),
o AS (SELECT px.*, face, row_number() OVER (PARTITION BY px.image, x, y ORDER BY sqrt(pow(x - ox, 2) + pow(y - oy, 2)) / iod, face) AS i FROM px JOIN fr USING (image)) SELECT face AS owner, count(*) AS pixels, sum(x + y)::BIGINT AS places FROM o WHERE i = 1 GROUP BY face""")
def face_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pixels of a grid over each image are nearest to each face."""
    frames = _spread(_frames(spark, sf_dir))
    grid = _sizes(frames).select("image", F.explode(F.sequence(F.lit(0), F.lit(119), F.lit(5))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(89), F.lit(5))))
    by_image = face_geometry.owners(grid, frames).groupBy("image", "owner").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("x") + F.col("y")).alias("places"))
    return by_image.repartition(C.parts(frames, FACES_A_TASK), "owner").groupBy("owner").agg(*[F.sum(c).cast("long").alias(c) for c in ("pixels", "places")])
