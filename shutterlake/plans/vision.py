"""Vectors, bursts, rule trees and robust statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import columns as C
from shutterlake.operators import robust, rules, selection, sequences
from shutterlake.plans.registry import query
from shutterlake.sources.tables import table

_BITS = "list_reduce(list_prepend(0::UBIGINT, list_transform(v, lambda x: (x > 0)::UBIGINT)), lambda s, b: (s << 1) | b)"
_VECTORS = f"SELECT *, {_BITS} AS bits, list_transform(m, lambda x: x / n) AS f FROM (SELECT *, sqrt(list_inner_product(m, m)) AS n FROM (SELECT *, list_transform(v, lambda x: x - list_avg(v)) AS m FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v")).withColumns({"f": C.centred(F.col("v")), "bits": C.sign_hash(F.col("v"))})


@query(f"WITH e AS ({_VECTORS}) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(greatest(0, list_inner_product(a.f, b.f)), 6) AS zncc, bit_count(xor(a.bits, b.bits))::INTEGER AS hamming FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its successor."""
    a, b = vectors(spark, sf_dir).alias("a"), vectors(spark, sf_dir).alias("b")
    j = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return j.select(F.col("a.vec_id"), F.round(C.cosine(F.col("a.v"), F.col("b.v")), 6).alias("cosine"), F.round(C.zncc(F.col("a.f"), F.col("b.f")), 6).alias("zncc"), C.hamming(F.col("a.bits"), F.col("b.bits")).alias("hamming"))


#: The test vectors are random: neighbours resemble each other far less than the frames of a burst.
_LOOSE = sequences.BurstRules(quick_any=0.15, quick_previous=0.14, quick_colour=-0.2, quick_zncc=0.0, slow_previous=0.12, slow_colour=0.0, slow_zncc=0.0)
_ITEMS = {
    "project": "label",
    "id": "vec_id",
    "ts": "case when vec_id % 17 = 0 then null else cast(vec_id as double) * 0.35 end",
    "seq": "cast(floor(vec_id / 4) as bigint)",
    "filename": "case when vec_id % 9 < 2 then 'cover.jpg' else concat('I', cast(vec_id as string), '.jpg') end",
    "faces": "vec_id % 6",
}


def burst_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).selectExpr(*[f"{e} as {k}" for k, e in _ITEMS.items()], "bits as dhash", "v as hist", "f as feature")
    return rows.withColumn("stem", C.stem(F.col("filename")))


def _gap(p: str) -> str:
    return f"CASE WHEN i.ts IS NOT NULL AND {p}.ts IS NOT NULL THEN i.ts - {p}.ts WHEN i.seq - {p}.seq > 0 AND i.seq - {p}.seq <= 1 THEN 2.0 WHEN i.seq - {p}.seq <= 2 THEN 5.0 ELSE 999.0 END"


def _score(p: str) -> str:
    return f"(list_cosine_similarity({p}.v, i.v) * 0.35 + greatest(0, list_inner_product({p}.f, i.f)) * 0.45 + (1 - bit_count(xor({p}.bits, i.bits)) / 64) * 0.20)"


_MATCH = f"""CASE WHEN a.stem = i.stem AND length(a.stem) >= 3 THEN true WHEN {_gap('p')} > 8.0 THEN false WHEN (a.faces = 0 AND i.faces >= 4) OR (i.faces = 0 AND a.faces >= 4) THEN false
WHEN {_gap('p')} <= 4.0 THEN (greatest({_score('p')}, {_score('a')}) >= 0.15 OR {_score('p')} >= 0.14) AND list_cosine_similarity(p.v, i.v) >= -0.2
ELSE {_score('p')} >= 0.12 AND list_cosine_similarity(p.v, i.v) >= 0.0 END"""
_BURSTS = f"""WITH RECURSIVE e AS ({_VECTORS}), i0 AS (SELECT {', '.join(f'{x} AS {k}' for k, x in _ITEMS.items())}, v, f, bits FROM e),
i AS MATERIALIZED (SELECT *, lower(regexp_replace(filename, '\\.[^.]*$', '')) AS stem, row_number() OVER (PARTITION BY project ORDER BY coalesce(ts, 0), coalesce(seq, 0), filename, id) AS rn FROM i0),
w AS (SELECT project, rn, rn AS anchor, 1 AS n FROM i WHERE rn = 1 UNION ALL
SELECT project, rn, CASE WHEN ok THEN anchor ELSE rn END, CASE WHEN ok THEN n + 1 ELSE 1 END FROM (SELECT w.project, i.rn, w.anchor, w.n, w.n < 13 AND ({_MATCH}) AS ok FROM w JOIN i ON i.project = w.project AND i.rn = w.rn + 1 JOIN i p ON p.project = w.project AND p.rn = w.rn JOIN i a ON a.project = w.project AND a.rn = w.anchor)),
s AS (SELECT i.project, i.id, a.id AS anchor FROM w JOIN i USING (project, rn) JOIN i a ON a.project = w.project AND a.rn = w.anchor)"""


@query(f"{_BURSTS} SELECT project, id, anchor FROM s")
def burst_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.burst_segments(burst_items(spark, sf_dir), _LOOSE)


@query(f"""{_BURSTS}, m AS (SELECT vec_id AS id, (vec_id * 37 % 100)::DOUBLE AS quality, (vec_id * 53 % 100)::DOUBLE AS sharpness, vec_id % 3 AS eyes, vec_id % 8 = 0 AS blurred, bits FROM e),
r AS (SELECT *, quality * 0.40 + sharpness * 0.35 + CASE eyes WHEN 0 THEN 25 WHEN 1 THEN -40 ELSE 0 END - CASE WHEN blurred THEN 50 ELSE 0 END AS score FROM s JOIN m USING (id)),
b AS (SELECT *, first_value(id) OVER o AS best, first_value(bits) OVER o AS best_bits, count(*) OVER (PARTITION BY project, anchor) AS size FROM r WINDOW o AS (PARTITION BY project, anchor ORDER BY score DESC, id))
SELECT project, anchor, id, id = best AS is_best, round(greatest(50.0, 100 - bit_count(xor(bits, best_bits)) / 64 * 100), 1) AS similarity FROM b WHERE size > 1""")
def burst_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    eyes = F.when(i % 3 == 0, "OPEN").when(i % 3 == 1, "CLOSED").otherwise("PARTIAL")
    metrics = vectors(spark, sf_dir).select(i.alias("id"), (i * 37 % 100).cast("double").alias("quality"), (i * 53 % 100).cast("double").alias("sharpness"), eyes.alias("eyes"), (i % 8 == 0).alias("blurred"), F.col("bits").alias("dhash"))
    return sequences.burst_winners(sequences.burst_segments(burst_items(spark, sf_dir), _LOOSE), metrics)


@query(f"WITH e AS ({_VECTORS}), x AS (SELECT vec_id, unnest(v) AS v FROM e) SELECT vec_id, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(avg(v), 6) AS mean, round(var_pop(v), 8) AS variance FROM x GROUP BY vec_id")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return x.groupBy("vec_id").agg(*[F.round(F.percentile("v", q / 100), 6).alias(f"p{q}") for q in (5, 50, 95)], F.round(F.avg("v"), 6).alias("mean"), F.round(F.var_pop("v"), 8).alias("variance"))


@query("""WITH t AS (SELECT vec_id, (i - 1) // 8 AS tile, x::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings)), v AS (SELECT vec_id, tile, var_pop(x) AS v FROM t GROUP BY ALL)
SELECT vec_id, round(quantile_cont(v, 0.95), 8) AS focus_var FROM v GROUP BY vec_id""")
def tile_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.floor(F.col("i") / 8).alias("tile"), F.col("x").cast("double").alias("x"))
    return robust.tile_focus(t, "vec_id", "tile", "x").select("vec_id", F.round("focus_var", 8).alias("focus_var"))


#: Metric columns over the lineitem table.
_METRICS = {
    "id": "l_orderkey",
    "line": "l_linenumber",
    "part": "l_partkey",
    "variance": "l_quantity * l_quantity",
    "mean": "l_tax * 2000 + 60",
    "p5": "l_tax * 500",
    "p10": "l_tax * 800 + 40",
    "p50": "l_tax * 1500 + 70",
    "p90": "l_tax * 1000 + 150",
    "p95": "l_tax * 1000 + 160",
    "shadow": "l_discount * 150",
    "highlight": "(l_orderkey % 12)",
    "faces": "l_linenumber % 3",
    "face_sharp": "l_quantity + 10",
    "face_hires": "case when l_partkey % 4 = 0 then -1 else l_quantity - 3 end",
    "brightness": "(l_partkey % 26) * 10",
    "candid": "l_partkey % 5 = 0",
    "eyes": "case when l_returnflag = 'A' then 'CLOSED' else 'OPEN' end",
    "group_id": "case when l_linestatus = 'F' then concat('G', cast(l_suppkey as string)) end",
    "is_best": "l_partkey % 2 = 0",
}
_M = f"SELECT {', '.join(f'{e} AS {k}' for k, e in _METRICS.items())} FROM lineitem"
_STATUS = "CASE WHEN p50 < 85 OR mean < 85 OR shadow > 14 OR p90 < 155 THEN 'UNDER_EXPOSED' WHEN p50 > 155 OR mean > 160 OR highlight > 10 OR p10 > 105 THEN 'OVER_EXPOSED' ELSE 'GOOD' END"
_SHARP = "least(greatest(ln(1 + variance) / ln(2501.0) * 100, 0), 100)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {k}" for k, e in _METRICS.items()])
    c = F.col
    return rows.withColumns({"exposure": rules.exposure_status(c("mean"), c("p10"), c("p50"), c("p90"), c("shadow"), c("highlight")), "sharpness": rules.log_sharpness(c("variance")), "focus": F.lit(-1.0)})


@query(f"""WITH m AS ({_M}), s AS (SELECT *, {_STATUS} AS exposure, {_SHARP} AS sharp, variance < 120 AS blurred FROM m),
x AS (SELECT *, least(greatest(CASE exposure WHEN 'UNDER_EXPOSED' THEN greatest(10, 100 - (90 - mean) * 1.6 - shadow * 1.5) WHEN 'OVER_EXPOSED' THEN greatest(10, 100 - (mean - 150) * 1.6 - highlight * 1.8) ELSE greatest(55, 100 - abs(p50 - 125) * 0.5 - shadow * 0.6 - highlight * 0.8) END, 0), 100) AS score FROM s)
SELECT exposure, blurred, count(*) AS n, round(avg(sharp), 3) AS sharpness, round(avg(score), 3) AS exposure_score, round(avg((sharp * 0.45 + score * 0.40 + least(greatest((p95 - p5) / 210 * 100, 0), 100) * 0.15) * CASE WHEN blurred THEN 0.6 ELSE 1 END), 3) AS quality FROM x GROUP BY ALL""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    m = metrics(spark, sf_dir).withColumn("blurred", c("variance") < 120)
    score = rules.exposure_score(c("exposure"), c("mean"), c("p50"), c("shadow"), c("highlight"))
    quality = rules.overall_quality(c("sharpness"), score, c("p5"), c("p95"), c("blurred"))
    return m.groupBy("exposure", "blurred").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sharpness"), 3).alias("sharpness"), F.round(F.avg(score), 3).alias("exposure_score"), F.round(F.avg(quality), 3).alias("quality"))


@query(f"""WITH m AS ({_M}), s AS (SELECT *, {_STATUS} AS exposure, {_SHARP} AS sharp, faces > 0 AS face FROM m),
f AS (SELECT *, CASE WHEN face AND face_hires >= 0 THEN face_hires >= 36 AND face_sharp >= 38 WHEN face THEN face_sharp >= 48 ELSE sharp >= 42 END AS ok,
  CASE WHEN face AND face_hires >= 0 THEN face_hires < 30 OR (face_hires < 36 AND face_sharp < 38) WHEN face THEN face_sharp < 38 ELSE sharp < 34 END AS bad, CASE WHEN face THEN face_sharp ELSE sharp END AS subject, face AND brightness > 0 AS lit FROM s),
r AS (SELECT *, CASE WHEN lit THEN brightness < 18 AND mean < 30 ELSE exposure = 'UNDER_EXPOSED' AND mean < 22 END AS black, CASE WHEN lit THEN brightness > 250 AND mean > 235 ELSE exposure = 'OVER_EXPOSED' AND mean > 238 END AS white,
  CASE WHEN lit THEN brightness < 45 OR brightness > 238 ELSE (exposure = 'UNDER_EXPOSED' AND mean < 40) OR (exposure = 'OVER_EXPOSED' AND mean > 220) END AS doubtful FROM f),
d AS (SELECT *, CASE WHEN bad OR black OR white THEN CASE WHEN bad AND (subject < 30 OR (face AND face_hires >= 0 AND face_hires < 25)) THEN 'REJECT 95' ELSE 'REJECT 88' END WHEN group_id IS NOT NULL AND NOT is_best THEN 'SIMILAR 92' WHEN group_id IS NOT NULL AND NOT ok THEN 'REVIEW 74' WHEN group_id IS NOT NULL THEN 'BEST 96'
  WHEN NOT ok THEN 'REVIEW 70' WHEN face AND eyes = 'CLOSED' AND NOT candid THEN 'REVIEW 72' WHEN doubtful THEN 'REVIEW 68' WHEN exposure = 'GOOD' THEN 'BEST 95' ELSE 'BEST 90' END AS v FROM r)
SELECT split_part(v, ' ', 1) AS label, split_part(v, ' ', 2)::DOUBLE AS confidence, count(*) AS n, sum(id)::BIGINT AS ids FROM d GROUP BY 1, 2""")
def cull_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keep, review or reject decision of every row, counted."""
    names: dict[str, Column] = {k: F.col(k) for k in ("faces", "face_sharp", "face_hires", "brightness", "sharpness", "focus", "mean", "exposure", "eyes", "candid", "group_id", "is_best")}
    return metrics(spark, sf_dir).select("id", rules.cull(names).alias("d")).groupBy("d.label", "d.confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


_SCENE = "CASE WHEN mean < 85 THEN 'Reception & Sangeet' WHEN red - blue > 25 THEN 'Mandap & Ceremony' WHEN mean > 145 AND blue > 120 THEN 'Outdoor Portraits' WHEN pos < 0.25 AND red - blue > 10 THEN 'Bride Makeup' WHEN pos < 0.25 THEN 'Groom Preparation' WHEN pos > 0.70 THEN 'Stage & Couple Portraits' ELSE 'Mandap & Ceremony' END"
_SHOTS = "SELECT o_orderkey AS id, o_custkey AS project, (o_orderkey % 200)::DOUBLE AS mean, (o_orderkey % 150 + 20)::DOUBLE AS red, 130.0::DOUBLE AS blue, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / count(*) OVER (PARTITION BY o_custkey) AS pos, round(o_totalprice / 10000, 1) AS temperature, o_orderkey % 10 = 0 AS locked FROM orders"


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with their place in the shoot. Shoots are small groups; the place is a rank within one."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    w = Window.partitionBy("o_custkey")
    position = (F.row_number().over(w.orderBy("o_orderkey")) - 1) / F.count(F.lit(1)).over(w)
    rows = o.select(k.alias("id"), F.col("o_custkey").alias("project"), (k % 200).cast("double").alias("mean"), (k % 150 + 20).cast("double").alias("red"), F.lit(130.0).alias("blue"), position.alias("pos"), F.round(F.col("o_totalprice") / 10000, 1).alias("temperature"), (k % 10 == 0).alias("locked"))
    return rows.withColumn("scene", rules.scene(F.col("mean"), F.col("red"), F.col("blue"), F.col("pos")))


@query(f"WITH s AS ({_SHOTS}) SELECT id, {_SCENE} AS scene FROM s")
def scene_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots(spark, sf_dir).select("id", "scene")


@query(f"""WITH s AS (SELECT *, {_SCENE} AS scene FROM ({_SHOTS})), m AS (SELECT project, scene, count(*) AS n, quantile_cont(temperature, 0.5) AS med FROM s GROUP BY ALL)
SELECT id, CASE WHEN n > 1 AND NOT locked THEN round(cast(temperature * 0.65 + med * 0.35 AS DECIMAL(20,8)), 1)::DOUBLE ELSE temperature END AS temperature FROM s JOIN m USING (project, scene)""")
def harmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperatures move a third of the way to their scene's median."""
    return robust.harmonize(shots(spark, sf_dir), ["project", "scene"], ["temperature"], F.col("locked")).select("id", "temperature")


@query("""WITH c AS (SELECT l_returnflag AS k, l_discount AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v) AS c, sum(w) OVER (PARTITION BY k) AS a FROM c), m AS (SELECT k, min(v) AS med FROM r WHERE c >= a / 2 GROUP BY k)
SELECT k AS l_returnflag, med AS weighted_median, round(sum(abs(v - med) * w) / sum(w), 8) AS deviation FROM c JOIN m USING (k) GROUP BY k, med""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_discount", "l_quantity")
    return robust.weighted_median(rows, ["l_returnflag"], "l_discount", "l_quantity").withColumn("deviation", F.round("deviation", 8))


@query("""WITH m AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem GROUP BY 1) SELECT l_suppkey, round(median, 4) AS median, round(1.4826 * quantile_cont(abs(l_extendedprice - median), 0.5), 4) AS robust_std FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey, median""")
def mad_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.mad_std(table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice").select("l_suppkey", F.round("median", 4).alias("median"), F.round("robust_std", 4).alias("robust_std"))


@query("""WITH g AS (SELECT o_custkey, exp(median(ln(least(greatest(o_totalprice / 250000, 0.3), 3.0)))) AS gain, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, round(exp(ln(least(greatest(o_totalprice / 250000, 0.3), 3.0)) * 0.65 + ln(gain) * 0.35), 4) AS gain FROM orders JOIN g USING (o_custkey) WHERE n >= 2""")
def log_gain_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-balance gains move towards their scene's median in log space, where the scene has two or more."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumn("lg", F.log(F.least(F.greatest(F.col("o_totalprice") / 250000, F.lit(0.3)), F.lit(3.0))))
    g = o.groupBy("o_custkey").agg(F.percentile("lg", 0.5).alias("med"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return o.join(g, "o_custkey").select("o_orderkey", F.round(F.exp(F.col("lg") * 0.65 + F.col("med") * 0.35), 4).alias("gain"))


@query("SELECT a.o_orderkey AS photo, b.event_id AS donor FROM orders a JOIN events b ON abs(a.o_orderkey - b.event_id) <= 10 WHERE b.event_type = 'view'")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by number, at most ten away, of every photo."""
    a = table(spark, sf_dir, "orders", "o_orderkey").toDF("photo")
    b = table(spark, sf_dir, "events", "event_id", "event_type").where("event_type = 'view'").select(F.col("event_id").alias("donor"))
    return selection.band_join(a, b, "photo", "donor", 10).select("photo", "donor")


@query("""WITH c AS (SELECT a.o_orderkey AS photo, b.o_orderkey AS donor, b.o_orderstatus = 'F' AS opened FROM orders a JOIN orders b ON abs(a.o_orderkey - b.o_orderkey) <= 10 AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderpriority = '5-LOW')
SELECT photo, donor, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY opened DESC, abs(photo - donor), donor) AS rn FROM c) WHERE rn <= 8""")
def donors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best donors of each photo with closed eyes: open eyes first, then the nearest."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    a = o.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("photo"))
    b = o.select(F.col("o_orderkey").alias("donor"), (F.col("o_orderstatus") == "F").alias("opened"))
    pairs = selection.band_join(a, b, "photo", "donor", 10).where("photo <> donor")
    rank = F.row_number().over(Window.partitionBy("photo").orderBy(F.desc("opened"), F.abs(F.col("photo") - F.col("donor")), "donor"))
    return pairs.select("photo", "donor", rank.alias("rank")).where("rank <= 8")


_BOX = "{'i': box, 'x': x, 'y': y, 'w': w, 'h': h}"
_SHARED = "greatest(0, least(k.x + k.w, x + w) - greatest(k.x, x)) * greatest(0, least(k.y + k.h, y + h) - greatest(k.y, y))"


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS image, l_linenumber AS box, max({{'p': l_extendedprice, 'q': l_quantity, 'd': l_discount, 't': l_tax, 'k': l_partkey}}) AS m FROM lineitem GROUP BY ALL),
o AS MATERIALIZED (SELECT image, box, m.q * 2 AS x, m.d * 500 AS y, 40.0::DOUBLE AS w, m.t * 200 + 20 AS h, row_number() OVER (PARTITION BY image ORDER BY -m.p, box) AS rn FROM b),
s AS (SELECT image, rn, [{_BOX}] AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.image, o.rn, CASE WHEN len(list_filter(kept, lambda k: {_SHARED} / (k.w * k.h + w * h - {_SHARED}) >= 0.35)) > 0 THEN kept ELSE list_append(kept, {_BOX}) END FROM s JOIN o ON o.image = s.image AND o.rn = s.rn + 1)
SELECT image, unnest(list_transform(kept, lambda k: k.i)) AS box FROM (SELECT image, arg_max(kept, rn) AS kept FROM s GROUP BY image)""")
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face boxes of each image without those that overlap a better one."""
    b = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    boxes = b.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_partkey")).alias("m")).select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("id"), F.col("m.l_extendedprice").alias("score"), (F.col("m.l_quantity") * 2).alias("x"), (F.col("m.l_discount") * 500).alias("y"), F.lit(40.0).alias("w"), (F.col("m.l_tax") * 200 + 20).alias("h")
    )
    return sequences.suppress(boxes, "image").withColumnRenamed("id", "box")
