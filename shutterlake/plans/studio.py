"""Imports, album updates, fulfilment, licences and faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators import faces, mutations
from shutterlake.plans.registry import _view, query
from shutterlake.plans.vision import _SCENE, _SHOTS, shots
from shutterlake.sources.tables import bridge, photos, table


def _rows(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{e} as {k}" for k, e in columns.items()])


_OLD = {"project": "o_custkey % 25", "id": "o_orderkey", "filename": "concat('IMG_', o_orderkey % 5000)", "path": "concat('/shoot/', o_custkey % 25, '/', o_orderkey)", "size": "o_orderkey * 3"}
_FILES = {"project": "user_id % 25", "filename": "concat('IMG_', event_id % 7000)", "path": "concat('/shoot/', user_id % 25, '/', event_id)", "size": "event_id * 7"}


@query(f"""WITH o AS ({_view(_OLD, 'orders')}), f AS ({_view(_FILES, 'events')}), p AS (SELECT project, path, min(id) AS id FROM o GROUP BY ALL), q AS (SELECT project, filename, min(id) AS id FROM o GROUP BY ALL),
m AS (SELECT f.*, least(p.id, q.id) AS id FROM f LEFT JOIN p USING (project, path) LEFT JOIN q USING (project, filename)),
r AS (SELECT id, max({{'p': path, 's': size}}) AS f FROM m WHERE id IS NOT NULL GROUP BY id), n AS (SELECT project, filename, max({{'p': path, 's': size}}) AS f FROM m WHERE id IS NULL GROUP BY project, filename)
SELECT project, o.id, filename, coalesce(f.p, path) AS path, coalesce(f.s, size) AS size FROM o LEFT JOIN r ON r.id = o.id UNION ALL SELECT project, NULL, filename, f.p, f.s FROM n""")
def import_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos after an import of files that are partly known by path or name."""
    return mutations.import_photos(_rows(spark, sf_dir, "orders", _OLD), _rows(spark, sf_dir, "events", _FILES))


_PROJECTS = {"id": "c_custkey", "name": "c_name", "folder": "concat('/Shoots/', c_mktsegment, '/', c_custkey % 600)"}
_SCANS = {"name": "s_name", "folder": "concat('/shoots/Building/', s_suppkey)"}


@query(f"""WITH p AS ({_view(_PROJECTS, 'customer')}), l AS (SELECT lower(folder) AS k, max({{'f': folder, 'n': name}}) AS s FROM ({_view(_SCANS, 'supplier')}) GROUP BY 1), m AS (SELECT k, s, (SELECT min(id) FROM p WHERE lower(folder) = k) AS id FROM l)
SELECT p.id, coalesce(s.n, name) AS name, coalesce(s.f, folder) AS folder FROM p LEFT JOIN m ON m.id = p.id UNION ALL SELECT NULL, s.n, s.f FROM m WHERE id IS NULL""")
def upsert_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects after folders were scanned that are partly known in another case."""
    return mutations.upsert_projects(_rows(spark, sf_dir, "customer", _PROJECTS), _rows(spark, sf_dir, "supplier", _SCANS))


_ENTRIES = {"gallery": "l_suppkey", "photo_id": "l_orderkey", "remote_id": "case when l_orderkey % 3 = 0 then l_orderkey + 1 end", "selection": "case l_returnflag when 'A' then 'SELECTED' else 'UNRATED' end", "note": "l_linestatus"}
_ITEMS = {"gallery": "l_suppkey", "key": "case when l_partkey % 7 = 0 then 'none' else cast(l_orderkey as string) end", "status": "case l_linestatus when 'O' then 'selected' when 'F' then 'rejected' else 'maybe' end", "note": "case when l_partkey % 5 = 0 then null else l_returnflag end"}
_PULL = f"""e AS ({_view(_ENTRIES, 'lineitem')}), i AS (SELECT gallery, try_cast(key AS BIGINT) AS key, CASE WHEN upper(status) IN ('SELECTED', 'REJECTED') THEN upper(status) ELSE 'UNRATED' END AS s, coalesce(note, '') AS n FROM ({_view(_ITEMS, 'lineitem')})),
l AS (SELECT gallery, key, max({{'s': s, 'n': n}}) AS i FROM i WHERE key IS NOT NULL GROUP BY ALL),
pulled AS (SELECT e.gallery, photo_id, remote_id, coalesce(i.s, selection) AS selection, coalesce(i.n, note) AS note FROM e LEFT JOIN l ON l.gallery = e.gallery AND l.key = coalesce(remote_id, photo_id))"""


@query(f"WITH {_PULL} SELECT * FROM pulled")
def pull_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Album entries with the choices that clients made on the album server."""
    return mutations.pull_selections(_rows(spark, sf_dir, "lineitem", _ENTRIES), _rows(spark, sf_dir, "lineitem", _ITEMS))


_ALBUMS = {"gallery": "s_suppkey", "status": "'SELECTING'", "submitted_at": "case when s_suppkey % 4 = 0 then s_suppkey * 10 end"}


@query(f"""WITH {_PULL}, n AS (SELECT gallery, count(*) FILTER (WHERE selection = 'SELECTED') AS n FROM pulled GROUP BY gallery), g AS ({_view(_ALBUMS, 'supplier')})
SELECT gallery, CASE WHEN gallery % 2 = 0 THEN 'SUBMITTED' ELSE status END AS status, CASE WHEN gallery % 2 = 0 THEN coalesce(submitted_at, 99) ELSE submitted_at END AS submitted_at, coalesce(n, 0) AS selected FROM g LEFT JOIN n USING (gallery)""")
def submit_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums with their counts and status after the pull; the first time of submission stays."""
    return mutations.submit(_rows(spark, sf_dir, "supplier", _ALBUMS), pull_selections(spark, sf_dir), F.col("gallery") % 2 == 0, F.lit(99).cast("long"))


_KEPT = {"gallery": "l_suppkey", "photo_id": "l_orderkey", "filename": "case when l_linenumber = 1 then '' when l_linenumber = 2 then 'kept.jpg' end", "remote_id": "case when l_linenumber = 3 then l_partkey end"}


@query(f"WITH CATALOG SELECT gallery, k.photo_id, coalesce(nullif(k.filename, ''), p.filename) AS filename, coalesce(remote_id, k.photo_id) AS remote_id FROM ({_view(_KEPT, 'lineitem')}) k LEFT JOIN photos p ON p.photo_id = k.photo_id")
def keep_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of albums that stay when their shoot is deleted."""
    return mutations.keep_albums(_rows(spark, sf_dir, "lineitem", _KEPT), photos(spark, sf_dir))


_EDITS = {"photo_id": "o_orderkey", "unblur": "case when o_orderkey % 3 > 0 then cast(o_orderkey % 100 as double) end", "sharpness": "cast(o_custkey % 80 as double)", "noise_reduction": "cast(o_orderkey % 20 as double)"}


@query(f"""SELECT photo_id, CASE WHEN coalesce(unblur, 0) < 50 THEN 70.0 ELSE 0.0 END::DOUBLE AS unblur, CASE WHEN coalesce(unblur, 0) < 50 THEN least(50, greatest(sharpness, 32)) ELSE sharpness END AS sharpness,
CASE WHEN coalesce(unblur, 0) < 50 THEN greatest(noise_reduction, 12) ELSE noise_reduction END AS noise_reduction FROM ({_view(_EDITS, 'orders')})""")
def toggle_deblur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.toggle_deblur(_rows(spark, sf_dir, "orders", _EDITS))


_JOBS = {"id": "event_id", "status": "case event_type when 'view' then 'RUNNING' when 'click' then 'PAUSED' when 'purchase' then 'COMPLETED' else upper(event_type) end"}


@query(f"SELECT id, CASE WHEN status IN ('RUNNING', 'PAUSED') THEN 'CANCELLED' ELSE status END AS status FROM ({_view(_JOBS, 'events')})")
def recover_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.recover_jobs(_rows(spark, sf_dir, "events", _JOBS))


_SALES = {"order_id": "o_orderkey", "status": "case o_orderstatus when 'F' then 'PAID' else 'CREATED' end", "agent": "o_custkey % 40", "amount": "case when o_orderkey % 9 = 0 then 0.0 else o_totalprice end", "coupon": "case when o_orderkey % 2 = 0 then concat('C', o_custkey % 60) else '' end"}
_AGENTS = {"agent": "cast(n_nationkey as bigint)", "rate": "cast(n_nationkey % 7 + 5 as double)"}
_COUPONS = {"coupon": "concat('C', s_suppkey)", "used": "cast(s_nationkey as bigint)"}
_PAID = f"paid AS (SELECT * FROM ({_view(_SALES, 'orders')}) WHERE status <> 'PAID' AND order_id IN (SELECT event_id FROM events WHERE event_type <> 'view'))"


def paid_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    payments = table(spark, sf_dir, "events", "event_id", "event_type").where("event_type <> 'view'").select(F.col("event_id").alias("order_id"))
    return mutations.newly_paid(_rows(spark, sf_dir, "orders", _SALES), payments)


@query(f"WITH {_PAID} SELECT order_id, p.agent, amount AS sale, rate, round(cast(amount * rate / 100 AS DECIMAL(20,8)), 2)::DOUBLE AS earned FROM paid p JOIN ({_view(_AGENTS, 'nation')}) a ON a.agent = p.agent WHERE amount > 0")
def fulfil_commissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commissions of the orders that payments have just paid, each once."""
    return mutations.commission_rows(paid_orders(spark, sf_dir), _rows(spark, sf_dir, "nation", _AGENTS))


@query(f"WITH {_PAID}, u AS (SELECT coupon, count(*) AS n FROM paid WHERE coupon <> '' GROUP BY coupon) SELECT coupon, used + coalesce(n, 0) AS used FROM ({_view(_COUPONS, 'supplier')}) LEFT JOIN u USING (coupon)")
def fulfil_coupons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.coupon_use(_rows(spark, sf_dir, "supplier", _COUPONS), paid_orders(spark, sf_dir))


_REQUESTS = {"id": "event_id", "license": "user_id % 20", "machine": "user_id", "at": "ts"}
_SEATS = {"license": "cast(n_nationkey as bigint)", "max_devices": "n_nationkey % 4"}


@query(f"""WITH r AS ({_view(_REQUESTS, 'events')}), f AS (SELECT license, machine, min({{'a': r.at, 'i': id}}) AS f FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY license ORDER BY f) AS rn FROM f),
s AS (SELECT license, machine FROM k JOIN ({_view(_SEATS, 'nation')}) USING (license) WHERE rn <= max_devices) SELECT r.id, r.license, r.machine, s.machine IS NOT NULL AS ok FROM r LEFT JOIN s USING (license, machine)""")
def seat_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests a licence lets in, by its number of computers."""
    return mutations.activate(_rows(spark, sf_dir, "events", _REQUESTS), _rows(spark, sf_dir, "nation", _SEATS)).select("id", "license", "machine", "ok")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN greatest(c_custkey * 1000, 500000) + 30 * 86400 END AS expires FROM customer")
def extend_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    expires = F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") * 1000)
    return table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), mutations.extended(expires, F.lit(500000), F.lit(30)).alias("expires"))


@query("""WITH CATALOG, s AS (SELECT DISTINCT gallery_id, photo_id, note FROM bridge WHERE choice = 'SELECTED'), n AS (SELECT s.*, filename, is_edited, row_number() OVER (PARTITION BY gallery_id ORDER BY photo_id) AS rn FROM (SELECT gallery_id, photo_id, max(note) AS note FROM s GROUP BY ALL) s JOIN photos USING (photo_id))
SELECT gallery_id, printf('[%03d] %s%s', rn, filename, CASE WHEN note = 'F' THEN ' | Note: F' ELSE '' END) AS line FROM n WHERE is_edited""")
def selection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines for the album designer: the chosen photos of each album, of which the edited ones were copied."""
    chosen = bridge(spark, sf_dir).where("choice = 'SELECTED'").groupBy("gallery_id", "photo_id").agg(F.max("note").alias("note"))
    rows = chosen.join(photos(spark, sf_dir).select("photo_id", "filename", F.col("is_edited").alias("copied")), "photo_id").withColumn("note", F.when(F.col("note") == "F", "F").otherwise(""))
    return mutations.manifest(rows, "gallery_id")


_FACES = {"photo": "l_orderkey", "at": "l_linenumber", "area": "l_quantity * 100", "sharpness": "l_discount * 1000", "luma": "l_tax * 2000", "eyes": "greatest(l_partkey % 4 - 1, 0)", "smile": "l_suppkey % 9 = 0", "large": "l_quantity > 45"}


@query(f"""WITH f AS (SELECT *, max(area) OVER (PARTITION BY photo) AS largest FROM ({_view(_FACES, 'lineitem')})),
b AS (SELECT photo, sharpness, luma FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY sharpness DESC, f.at, luma DESC) AS rn FROM f WHERE area >= 0.25 * largest) WHERE rn = 1),
g AS (SELECT photo, count(*) AS faces, sum(least(2, eyes)) / (2 * count(*)) AS ratio, bool_or(smile) OR bool_or(large) OR avg(sharpness) > 60 AS candid FROM f GROUP BY photo)
SELECT photo, faces, round(sharpness, 1) AS sharpness, round(luma, 1) AS luma, CASE WHEN ratio >= 0.5 THEN 'OPEN' WHEN ratio > 0 THEN 'PARTIAL' WHEN candid THEN 'OPEN' ELSE 'CLOSED' END AS eyes,
CASE WHEN ratio >= 0.5 THEN 0.92 WHEN ratio > 0 THEN 0.80 WHEN candid THEN 0.85 ELSE 0.82 END::DOUBLE AS confidence FROM g JOIN b USING (photo)""")
def face_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness, light and eyes of the faces that count, per photo."""
    return faces.face_metrics(_rows(spark, sf_dir, "lineitem", _FACES))


_GENRE = """CASE WHEN scene IN ('Bride Makeup', 'Groom Preparation') THEN 'Solo Portrait & Makeup' WHEN scene = 'Mandap & Ceremony' THEN 'Mandap & Sacred Pheras' WHEN scene = 'Reception & Sangeet' THEN 'Night Reception & Dance' WHEN scene = 'Outdoor Portraits' THEN 'Outdoor Sunlight & Garden'
WHEN id % 5 = 0 AND red - blue > 28 AND id % 2 = 0 THEN 'Mandap & Sacred Pheras' WHEN id % 5 = 0 THEN 'Décor, Rituals & Macro Details' WHEN id % 5 = 1 THEN 'Solo Portrait & Makeup' WHEN id % 5 = 2 THEN 'Couple Portrait' ELSE 'Family & Stage Group' END"""


@query(f"WITH s AS (SELECT *, {_SCENE} AS scene FROM ({_SHOTS})) SELECT id, {_GENRE} AS genre FROM s")
def shot_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    return s.select("id", faces.genre(F.col("scene"), F.col("id") % 5, F.col("red") - F.col("blue"), F.col("id") % 2 == 0).alias("genre"))


_FAR = "{'far': sqrt((x - b.x) * (x - b.x) + (y - b.y) * (y - b.y)), 'at': b.at}"


@query(f"""WITH RECURSIVE p AS (SELECT l_orderkey AS pair, l_linenumber::BIGINT AS at, l_quantity / 50 AS x, l_discount * 10 AS y, l_tax AS dx FROM lineitem), d AS MATERIALIZED (SELECT pair, list({{'at': p.at + 100, 'x': x + dx, 'y': y}}) AS free FROM p GROUP BY pair),
t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY p.at, x, y) AS rn FROM p), w AS (SELECT pair, 0::BIGINT AS rn, []::STRUCT(target BIGINT, donor BIGINT)[] AS done FROM d UNION ALL
SELECT pair, rn, CASE WHEN n.far < 0.12 THEN list_append(done, {{'target': n2, 'donor': n.at}}) ELSE done END FROM (SELECT w.pair, t.rn, done, t.at AS n2, list_min(list_transform(list_filter(free, lambda b: NOT list_contains(list_transform(done, lambda m: m.donor), b.at)), lambda b: {_FAR})) AS n FROM w JOIN t ON t.pair = w.pair AND t.rn = w.rn + 1 JOIN d ON d.pair = w.pair))
SELECT pair, m.target AS target, m.donor AS donor FROM (SELECT pair, unnest(done) AS m FROM (SELECT pair, arg_max(done, rn) AS done FROM w GROUP BY pair))""")
def face_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each face of a photo with the same person's in the next frame."""
    points = _rows(spark, sf_dir, "lineitem", {"pair": "l_orderkey", "at": "cast(l_linenumber as bigint)", "x": "l_quantity / 50", "y": "l_discount * 10", "dx": "l_tax"})
    donors = points.select("pair", (F.col("at") + 100).alias("at"), (F.col("x") + F.col("dx")).alias("x"), "y")
    return faces.match_faces(points.drop("dx"), donors)


_SUBMITTED = {"gallery": "o_orderkey", "status": "case o_orderstatus when 'F' then 'SUBMITTED' else 'SELECTING' end", "submitted_at": "case when o_orderkey % 4 > 0 then o_custkey * 1000 end", "expired_at": "case when o_orderkey % 6 = 0 then o_orderkey end"}


@query(f"SELECT gallery, status, submitted_at, CASE WHEN status = 'SUBMITTED' AND expired_at IS NULL AND submitted_at <= 700000 - 7 * 86400 THEN 700000 ELSE expired_at END AS expired_at FROM ({_view(_SUBMITTED, 'orders')})")
def album_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums whose previews are cleaned a week after they were submitted."""
    return mutations.retire_albums(_rows(spark, sf_dir, "orders", _SUBMITTED), F.lit(700000).cast("long"))


@query(f"""WITH d AS (SELECT user_id % 20 AS license, count(DISTINCT user_id) AS seen FROM events WHERE event_type <> 'signup' GROUP BY 1) SELECT license, max_devices, coalesce(seen, 0) AS active FROM ({_view(_SEATS, 'nation')}) LEFT JOIN d USING (license)""")
def active_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences with their active computers, counted before the join."""
    active = table(spark, sf_dir, "events", "user_id", "event_type").where("event_type <> 'signup'").groupBy((F.col("user_id") % 20).alias("license")).agg(F.countDistinct("user_id").alias("seen"))
    return _rows(spark, sf_dir, "nation", _SEATS).join(active, "license", "left").select("license", "max_devices", F.coalesce("seen", F.lit(0).cast("long")).alias("active"))
