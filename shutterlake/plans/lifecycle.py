"""Lists in their orders, albums over their life, prices with referrals, presets and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions import columns as C
from shutterlake.operators import albums, rules, selection
from shutterlake.operators.selection import effective
from shutterlake.plans.business import _COUPONS
from shutterlake.plans.registry import _view, query
from shutterlake.sources.tables import photos, table


def _rows(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{e} as {k}" for k, e in columns.items()])


# --- lists and filters ---------------------------------------------------------


@query("""WITH CATALOG SELECT photo_id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY ai_score DESC, photo_id) AS by_score, row_number() OVER (PARTITION BY project_id ORDER BY filename, photo_id) AS by_name,
  row_number() OVER (PARTITION BY project_id ORDER BY star_rating DESC, ai_score DESC, photo_id) AS by_rating, row_number() OVER (PARTITION BY project_id ORDER BY photo_id) AS by_id FROM photos""")
def gallery_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each photo in its shoot's list, for each order that a list can have."""
    place = {f"by_{name}": F.row_number().over(Window.partitionBy("project_id").orderBy(*selection.sort_order(name))) for name in ("score", "name", "rating", "id")}
    return photos(spark, sf_dir).select("photo_id", "project_id", *[c.alias(k) for k, c in place.items()])


@query("""WITH CATALOG SELECT photo_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY eff <> 'BEST', ai_score DESC, photo_id) AS place FROM photos WHERE group_id IN (SELECT group_id FROM photos WHERE eff = 'SIMILAR')""")
def similar_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with a SIMILAR photo, each in the order in which it is shown."""
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(*selection.sort_order("similar")))
    return selection.similar_members(photos(spark, sf_dir)).select("photo_id", "group_id", place.alias("place"))


@query("SELECT o_orderkey AS photo_id, o_orderstatus AS status FROM orders WHERE o_orderkey BETWEEN 990 AND 1010")
def id_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where(F.col("o_orderkey").between(990, 1010)).select(F.col("o_orderkey").alias("photo_id"), F.col("o_orderstatus").alias("status"))


@query("SELECT user_id, count(*) AS n, max(taken) AS latest FROM (SELECT user_id, strftime(ts, '%Y:%m:%d %H:%M:%S') AS taken FROM events) WHERE taken > '2024:01:10 00:00:00' AND taken < '2100' GROUP BY user_id")
def taken_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera times are text in an order that is that of time: a range of texts."""
    taken = table(spark, sf_dir, "events", "user_id", "ts").select("user_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("taken"))
    return taken.where((F.col("taken") > "2024:01:10 00:00:00") & (F.col("taken") < "2100")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("taken").alias("latest"))


_IMAGES = {"id": "o_orderkey", "name": "concat('img', o_orderkey % 3000, '.png')", "width": "o_orderkey % 4"}
_MASKS = {"id": "event_id", "name": "concat('img', event_id % 4000, '.jpg')", "width": "event_id % 3"}


@query(f"""WITH a AS (SELECT split_part(name, '.', 1) AS base, min({{'i': id, 'w': width}}) AS f FROM ({_view(_IMAGES, 'orders')}) GROUP BY 1), b AS (SELECT split_part(name, '.', 1) AS base, min({{'i': id, 'w': width}}) AS f FROM ({_view(_MASKS, 'events')}) GROUP BY 1)
SELECT base, a.f.i AS image, b.f.i AS mask FROM a JOIN b USING (base) WHERE a.f.w = b.f.w""")
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with the mask of the same name and width."""
    return selection.file_pairs(_rows(spark, sf_dir, "orders", _IMAGES), _rows(spark, sf_dir, "events", _MASKS)).select("base", F.col("left_id").alias("image"), F.col("right_id").alias("mask"))


# --- faces ----------------------------------------------------------------------

_DONORS = {"id": "o_orderkey", "burst": "o_custkey", "project": "o_custkey % 25", "opened": "o_orderstatus = 'F'", "score": "o_totalprice", "closed": "o_orderpriority = '5-LOW'"}


@query(f"""WITH p AS ({_view(_DONORS, 'orders')}), b AS (SELECT t.id AS photo, d.id AS donor, d.opened, row_number() OVER (PARTITION BY t.id ORDER BY d.opened DESC, d.score DESC, d.id) AS rn FROM p t JOIN p d ON d.burst = t.burst AND d.id <> t.id WHERE t.closed),
n AS (SELECT t.id AS photo, d.id AS donor, d.opened, row_number() OVER (PARTITION BY t.id ORDER BY d.opened DESC, abs(d.id - t.id), d.id) AS rn FROM p t JOIN p d ON d.project = t.project AND d.id <> t.id AND d.id BETWEEN t.id - 10 AND t.id + 10 WHERE t.closed AND t.id NOT IN (SELECT photo FROM b WHERE rn >= 3)),
a AS (SELECT *, true AS same FROM b UNION ALL SELECT *, false FROM n WHERE rn <= 8 AND NOT EXISTS (SELECT 1 FROM b WHERE b.photo = n.photo AND b.donor = n.donor)), r AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY same DESC, rn) AS place FROM a)
SELECT photo, donor, same AS same_burst, place, place = coalesce(min(CASE WHEN same AND opened THEN place END) OVER (PARTITION BY photo), 1) AS is_best FROM r""")
def blink_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors of open eyes for each photo with closed ones: its burst first, then its neighbours."""
    p = _rows(spark, sf_dir, "orders", _DONORS)
    return albums.eye_donors(p.where("closed").select(F.col("id").alias("photo"), "project", "burst"), p.select(F.col("id").alias("donor"), "project", "burst", "opened", "score"))


# --- partners and prices ----------------------------------------------------------


@query("SELECT p_partkey AS coupon, coalesce(n_name, '') AS agent, p_size AS percent FROM part LEFT JOIN nation ON n_nationkey = CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 40 END")
def coupon_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupons with the name of their partner, empty where there is none."""
    c = _rows(spark, sf_dir, "part", {"coupon": "p_partkey", "agent_id": "case when p_partkey % 3 > 0 then p_partkey % 40 end", "percent": "p_size"})
    agents = table(spark, sf_dir, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").alias("agent_id"), F.col("n_name").alias("agent"))
    return c.join(agents, "agent_id", "left").select("coupon", F.coalesce("agent", F.lit("")).alias("agent"), "percent")


@query("""SELECT p_partkey AS coupon, array_to_string(list_sort(list_intersect(string_split(CASE p_partkey % 4 WHEN 0 THEN 'pro,studio' WHEN 1 THEN 'studio,gold,basic' WHEN 2 THEN 'gold' ELSE '' END, ','), ['basic', 'pro', 'studio'])), ',') AS plans FROM part""")
def plan_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the plans that a coupon names, those that exist."""
    named = "case p_partkey % 4 when 0 then 'pro,studio' when 1 then 'studio,gold,basic' when 2 then 'gold' else '' end"
    known = F.array(*[F.lit(p) for p in ("basic", "pro", "studio")])
    return _rows(spark, sf_dir, "part", {"coupon": "p_partkey", "named": named}).select("coupon", F.array_join(F.array_sort(F.array_intersect(F.split("named", ","), known)), ",").alias("plans"))


_PRICES = {("pro", "monthly", "INR"): 1500.0, ("pro", "yearly", "INR"): 12999.0, ("studio", "monthly", "INR"): 2500.0, ("pro", "monthly", "USD"): 19.99, ("pro", "yearly", "USD"): 189.5, ("studio", "yearly", "USD"): 349.0}
_PRICE_SQL = " ".join(f"WHEN plan = '{p}' AND cycle = '{c}' AND currency = '{u}' THEN {x}" for (p, c, u), x in _PRICES.items())
_ASK = {
    "id": "o_orderkey",
    "customer": "o_custkey",
    "at": "o_orderdate",
    "paid": "o_orderstatus = 'F'",
    "agent": "case when o_orderkey % 5 < 3 then o_orderkey % 9 end",
    "plan": "case o_orderkey % 4 when 0 then 'pro' when 1 then 'studio' when 2 then 'pro' else 'gold' end",
    "cycle": "case when o_orderkey % 3 = 0 then 'yearly' else 'monthly' end",
    "currency": "case when o_orderkey % 2 = 0 then 'INR' else 'USD' end",
    "code": "case when o_orderkey % 6 < 4 then o_orderkey % 500 end",
}


@query(f"""WITH c AS ({_COUPONS}), a AS (SELECT *, (CASE {_PRICE_SQL} END)::DOUBLE AS base FROM ({_view(_ASK, 'orders')})),
h AS (SELECT customer, count(*) AS bought, arg_min(agent, {{'a': a.at, 'i': a.id}}) FILTER (WHERE agent IS NOT NULL) AS referrer FROM a WHERE paid GROUP BY customer),
q AS (SELECT a.*, c.id AS cid, active, valid_until, max_uses, used, plans, agent_id, CASE WHEN agent_id < 5 THEN 'ACTIVE' ELSE 'BLOCKED' END AS astatus, bought, CASE WHEN referrer < 5 THEN referrer END AS referrer FROM a LEFT JOIN c ON c.id = a.code LEFT JOIN h ON h.customer = a.customer WHERE NOT paid),
e AS (SELECT *, CASE WHEN base IS NULL THEN 'Invalid plan or billing cycle' WHEN code IS NULL THEN NULL WHEN cid IS NULL OR active = 0 THEN 'Invalid or expired coupon code' WHEN valid_until > 0 AND valid_until < 1500 THEN 'This coupon has expired' WHEN max_uses > 0 AND used >= max_uses THEN 'This coupon has reached its usage limit'
  WHEN plans <> '' AND NOT list_contains(string_split(plans, ','), plan) THEN 'This coupon is not valid for the ' || plan || ' plan' WHEN agent_id IS NOT NULL AND astatus <> 'ACTIVE' THEN 'This referral code is no longer active' WHEN bought > 0 THEN 'Coupon codes work only on the first purchase. Please continue without the coupon.' END AS error FROM q),
d AS (SELECT *, CASE WHEN code IS NULL THEN 0.0::DOUBLE WHEN currency = 'INR' THEN round(base * 15 / 100) ELSE round(base * 15 / 100, 2) END AS less FROM e)
SELECT id, error, CASE WHEN error IS NULL THEN base END AS original_price, CASE WHEN error IS NULL THEN round(greatest(0, base - less), 2) END AS final_price, CASE WHEN error IS NULL THEN CASE WHEN code IS NOT NULL THEN agent_id ELSE referrer END END AS agent FROM d""")
def referral_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote for each open order: base price, coupon, the rule of the first purchase, and the partner who is credited."""
    asked = _rows(spark, sf_dir, "orders", _ASK)
    prices = F.create_map(*[F.lit(x) for k, v in _PRICES.items() for x in ("|".join(k), v)])
    asked = asked.withColumn("base", F.try_element_at(prices, F.concat_ws("|", "plan", "cycle", "currency")))
    history = asked.where("paid").groupBy("customer").agg(F.count(F.lit(1)).alias("bought"), F.min_by("agent", F.when(F.col("agent").isNotNull(), F.struct("at", "id"))).alias("referrer"))
    c = table(spark, sf_dir, "part").selectExpr(*_COUPONS.removeprefix("SELECT ").removesuffix(" FROM part").replace("'pro,studio'", "'pro;studio'").split(", "))
    c = c.withColumns({"plans": F.replace("plans", F.lit(";"), F.lit(",")), "agent_status": F.when(F.col("agent_id") < 5, "ACTIVE").when(F.col("agent_id").isNotNull(), "BLOCKED")}).withColumnRenamed("id", "cid")
    q = asked.where("not paid").drop("agent").join(c, F.col("cid") == F.col("code"), "left").join(history, "customer", "left")
    names = {k: F.col(k) for k in ("active", "valid_until", "max_uses", "used", "plans", "agent_id", "agent_status")} | {"code": F.col("cid")}
    error = F.when(F.col("base").isNull(), rules.NO_SUCH_PLAN).otherwise(F.when(F.col("code").isNotNull(), F.coalesce(rules.coupon_error(F.lit(1500), F.col("plan"), names), F.when(F.col("bought") > 0, rules.COUPON_FIRST_ONLY))))
    less = F.when(F.col("code").isNull(), 0.0).otherwise(C.discount(F.col("base"), F.lit(15), F.col("currency")))
    credited = F.when(F.col("code").isNotNull(), F.col("agent_id")).otherwise(F.when(F.col("referrer") < 5, F.col("referrer")))
    good = error.isNull()
    return q.select("id", error.alias("error"), F.when(good, F.col("base")).alias("original_price"), F.when(good, F.round(F.greatest(F.lit(0.0), F.col("base") - less), 2)).alias("final_price"), F.when(good, credited).alias("agent"))


# --- albums -------------------------------------------------------------------------

_SHOOT = {"project": "o_custkey % 300", "photo_id": "o_orderkey", "filename": "case when o_orderkey % 10 > 0 then concat('IMG_', o_orderkey, '.JPG') end", "rejected": "o_orderstatus = 'O' or o_orderpriority = '5-LOW'"}
_NEW = {"project": "s_suppkey * 3", "gallery": "concat('A', s_suppkey)", "days": "case when s_suppkey % 4 > 0 then s_nationkey end"}


@query(f"""WITH p AS ({_view(_SHOOT, 'orders')}), s AS (SELECT project, count(*) AS n, count(*) FILTER (WHERE NOT rejected) AS good FROM p GROUP BY project)
SELECT gallery, project, photo_id, coalesce(filename, '') AS filename, photo_id AS remote_id, 'UNRATED' AS selection, '' AS note, CASE WHEN good > 0 THEN good ELSE n END AS total, CASE WHEN days > 0 THEN 1000000 + days * 86400 END AS expires_at FROM p JOIN s USING (project) JOIN ({_view(_NEW, 'supplier')}) USING (project) WHERE NOT rejected OR good = 0""")
def create_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return albums.create_albums(_rows(spark, sf_dir, "orders", _SHOOT), _rows(spark, sf_dir, "supplier", _NEW), F.lit(1000000))


_ONLINE = {"gallery": "page_id", "url": "url", "status": "case page_id % 3 when 0 then 'SUBMITTED' when 1 then 'ACTIVE' end", "hosting_status": "'DONE'", "hosting_error": "case when page_id % 7 = 0 then 'Album server moved. Upload again.' end"}
_MOVED = "(url LIKE '%example.com%/en/%' OR url LIKE '%.example.org%') AND coalesce(status, 'ACTIVE') <> 'SUBMITTED' AND coalesce(hosting_error, '') NOT LIKE 'Album server moved.%'"


@query(f"SELECT gallery, status, CASE WHEN {_MOVED} THEN 'FAILED' ELSE hosting_status END AS hosting_status, CASE WHEN {_MOVED} THEN 'Album server moved.' ELSE hosting_error END AS hosting_error FROM ({_view(_ONLINE, 'pages')})")
def moved_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open albums whose address is an old one."""
    return albums.moved_albums(_rows(spark, sf_dir, "pages", _ONLINE), ("%example.com%/en/%", "%.example.org%"), "Album server moved.").drop("url")


@query("WITH CATALOG SELECT photo_id, CASE WHEN user_selection = 'SELECTED' THEN 'BEST' ELSE user_selection END AS user_selection, CASE WHEN ai_recommendation = 'SELECTED' THEN 'BEST' ELSE ai_recommendation END AS ai_recommendation FROM photos")
def recode_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos after the choice SELECTED was merged into BEST."""
    return selection.recode(photos(spark, sf_dir), ("user_selection", "ai_recommendation"), {"SELECTED": "BEST"}).select("photo_id", "user_selection", "ai_recommendation")


_EDITABLE = {"photo_id": "o_orderkey", "params": "concat('{\"e\":', o_orderkey % 9, '}')", "manual_override": "o_orderkey % 4 = 0", "is_edited": "o_orderkey % 2 = 0"}
_EDITS = {"photo_id": "event_id % 3000", "at": "event_id", "params": "concat('{\"e\":', user_id, '}')"}


@query(f"""WITH e AS (SELECT photo_id, arg_max(params, e.at) AS params FROM ({_view(_EDITS, 'events')}) e GROUP BY photo_id), r AS (SELECT DISTINCT l_orderkey AS photo_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)
SELECT p.photo_id, CASE WHEN r.photo_id IS NOT NULL THEN '{{}}' ELSE coalesce(e.params, p.params) END AS params, CASE WHEN r.photo_id IS NOT NULL THEN false WHEN e.params IS NOT NULL THEN true ELSE manual_override END AS manual_override,
CASE WHEN r.photo_id IS NOT NULL THEN false WHEN e.params IS NOT NULL THEN true ELSE is_edited END AS is_edited FROM ({_view(_EDITABLE, 'orders')}) p LEFT JOIN e USING (photo_id) LEFT JOIN r USING (photo_id)""")
def edit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos after edits were stored and others were set back."""
    resets = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").where("l_returnflag = 'R' and l_linenumber = 1").select(F.col("l_orderkey").alias("photo_id"))
    return albums.with_edits(_rows(spark, sf_dir, "orders", _EDITABLE), _rows(spark, sf_dir, "events", _EDITS), resets)


_GONE = {"gallery": "s_suppkey", "project": "case when s_suppkey % 3 > 0 then s_nationkey + 100 else s_nationkey % 8 end", "folder": "case when s_suppkey % 5 > 0 then concat('/Shoots/', s_suppkey % 10) else '' end"}
_LOST = {"gallery": "l_suppkey", "photo_id": "l_orderkey * 10 + l_linenumber", "remote_id": "case when l_linenumber % 2 = 0 then l_orderkey * 10 + l_linenumber + 5 end", "filename": "concat('IMG_', l_partkey % 400, '.JPG')", "selection": "case l_returnflag when 'A' then 'SELECTED' when 'R' then '' end", "note": "l_linestatus"}
_BACK = {"project": "n_nationkey", "folder": "concat('/shoots/', n_nationkey)"}
_FOUND = {"project": "cast(p_partkey % 8 as int)", "photo_id": "p_partkey", "filename": "case when p_partkey % 50 > 0 then concat('img_', cast(floor(p_partkey / 8) as bigint) % 260, '.jpg') end", "client_selection": "'UNRATED'", "client_note": "''"}
_RELINK = f"""pr AS (SELECT * FROM ({_view(_BACK, 'nation')}) WHERE project < 8), o AS (SELECT gallery, lower(folder) AS f FROM ({_view(_GONE, 'supplier')}) WHERE project NOT IN (SELECT project FROM pr)),
own AS (SELECT gallery, coalesce(remote_id, photo_id) AS remote_id, max({{'f': filename, 's': selection, 'n': note}}) AS e, f FROM ({_view(_LOST, 'lineitem')}) JOIN o USING (gallery) GROUP BY ALL),
k AS (SELECT project, lower(filename) AS k, min(photo_id) AS new FROM ({_view(_FOUND, 'part')}) WHERE coalesce(filename, '') <> '' GROUP BY ALL), m AS (SELECT gallery, remote_id, f, e.f AS filename, e.s AS selection, e.n AS note, project, new FROM own JOIN k ON k.k = lower(e.f)),
c AS (SELECT gallery, m.project, count(*) AS m, coalesce(f <> '' AND f = lower(folder), false) AS same FROM m JOIN pr ON pr.project = m.project GROUP BY gallery, m.project, f, folder), n AS (SELECT gallery, count(*) AS n FROM own GROUP BY gallery),
b AS (SELECT gallery, arg_min(project, {{'a': NOT same, 'b': -m, 'c': project}}) AS project FROM c JOIN n USING (gallery) WHERE same OR m >= greatest(1, floor(0.6 * n + 0.999)) GROUP BY gallery),
relinked AS (SELECT gallery, project, new AS photo_id, coalesce(nullif(selection, ''), 'UNRATED') AS selection, coalesce(note, '') AS note, filename, remote_id FROM (SELECT m.*, row_number() OVER (PARTITION BY gallery, m.project, new ORDER BY remote_id DESC) AS rn FROM m JOIN b USING (gallery, project)) WHERE rn = 1)"""


@query(f"WITH {_RELINK} SELECT * FROM relinked")
def relink_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of albums without a shoot, under the shoot that holds their photos."""
    projects = _rows(spark, sf_dir, "nation", _BACK).where("project < 8")
    return albums.relink(_rows(spark, sf_dir, "supplier", _GONE), _rows(spark, sf_dir, "lineitem", _LOST), projects, _rows(spark, sf_dir, "part", _FOUND))


@query(f"""WITH {_RELINK}, t AS (SELECT project, photo_id, max({{'s': selection, 'n': note}}) AS c FROM relinked WHERE selection <> 'UNRATED' OR note <> '' GROUP BY ALL)
SELECT project, photo_id, filename, coalesce(c.s, client_selection) AS client_selection, coalesce(c.n, client_note) AS client_note FROM ({_view(_FOUND, 'part')}) LEFT JOIN t USING (project, photo_id)""")
def relinked_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with the choices that their re-linked albums carried."""
    return albums.carried_choices(_rows(spark, sf_dir, "part", _FOUND), relink_albums(spark, sf_dir)).select("project", "photo_id", "filename", "client_selection", "client_note")


_BOARD = {"gallery": "s_suppkey", "title": "case when s_suppkey % 6 > 0 then s_name end", "client": "case when s_suppkey % 7 > 0 then concat('C', s_nationkey) end", "created_at": "case when s_suppkey % 9 > 0 then concat('day ', s_suppkey) end"}
_FILES = {"gallery": "l_suppkey * 2", "size": "l_partkey * 10"}
_DONE = {"gallery": "o_orderkey % 120", "status": "case o_orderstatus when 'F' then 'SUBMITTED' else 'SELECTING' end", "submitted_at": "case when o_orderkey % 5 > 0 then o_orderdate end", "updated_at": "case when o_orderkey % 4 = 0 then concat('order ', o_orderkey) end", "selected": "o_custkey"}


@query(f"""WITH h AS (SELECT gallery, count(*) AS n, sum(size)::BIGINT AS size FROM ({_view(_FILES, 'lineitem')}) GROUP BY gallery), d AS (SELECT * FROM ({_view(_DONE, 'orders')}) WHERE gallery IN (SELECT s_suppkey FROM supplier)), s AS (SELECT DISTINCT ON (gallery) * FROM (SELECT o_orderkey, {', '.join(f'{e} AS {k}' for k, e in _DONE.items())} FROM orders) ORDER BY gallery, o_orderkey DESC)
SELECT a.gallery, coalesce(title, 'Untitled Shoot') AS title, coalesce(client, 'Client') AS client, coalesce(n, 0) AS total, coalesce(selected, 0) AS selected, coalesce(status, 'SELECTING') AS status, coalesce(updated_at, created_at, 'Recently') AS updated_at,
CASE WHEN status = 'SUBMITTED' AND submitted_at IS NOT NULL THEN strftime(submitted_at + INTERVAL 7 DAY, '%d %b %Y') END AS clean_on, coalesce(h.size, 0) AS size FROM ({_view(_BOARD, 'supplier')}) a LEFT JOIN h ON h.gallery = a.gallery LEFT JOIN s ON s.gallery = a.gallery""")
def album_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board of albums: what is held, chosen, submitted, and when it is cleaned."""
    done = _rows(spark, sf_dir, "orders", {"key": "o_orderkey"} | _DONE)
    return albums.album_board(_rows(spark, sf_dir, "supplier", _BOARD), _rows(spark, sf_dir, "lineitem", _FILES), selection.last_write(done, ["gallery"], "key").drop("key"))


@query("""WITH CATALOG, h AS (SELECT gallery_id, list({'id': photo_id, 'name': filename} ORDER BY photo_id) AS photos FROM (SELECT DISTINCT gallery_id, photo_id FROM bridge WHERE choice = 'SELECTED' AND note = 'O') JOIN photos USING (photo_id) GROUP BY gallery_id)
SELECT s_suppkey AS gallery, to_json({'title': s_name, 'photos': coalesce(photos, [])})::VARCHAR AS document FROM supplier LEFT JOIN h ON gallery_id = s_suppkey""")
def gallery_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each album as one document for the album server."""
    from shutterlake.sources.tables import bridge

    chosen = bridge(spark, sf_dir).where("choice = 'SELECTED' and note = 'O'").select("gallery_id", "photo_id").distinct()
    held = chosen.join(photos(spark, sf_dir).select("photo_id", "filename"), "photo_id").select(F.col("gallery_id").alias("gallery"), F.col("photo_id").alias("id"), F.col("filename").alias("name"))
    return albums.gallery_documents(_rows(spark, sf_dir, "supplier", {"gallery": "s_suppkey", "title": "s_name"}), held)


# --- keys, checks and presets -----------------------------------------------------------


@query("SELECT o_orderkey AS photo_id, left(md5(concat(o_orderpriority, '|', o_custkey)), 12) AS cache_key, sha1(concat(o_orderkey, ':', o_orderstatus)) AS content_key FROM orders")
def photo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of cached renderings, by parameters and by content."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return o.select(F.col("o_orderkey").alias("photo_id"), C.cache_key("o_orderpriority", "o_custkey").alias("cache_key"), F.sha1(F.concat_ws(":", "o_orderkey", "o_orderstatus")).alias("content_key"))


_INPUT = {"id": "event_id", "uuid": "case event_id % 4 when 0 then substring(md5(cast(event_id as string)), 1, 12) when 1 then concat(md5(cast(event_id as string)), '/..') when 2 then 'AB-12_x' else '' end", "status": "case event_id % 3 when 0 then 'selected' when 1 then 'Rejected' else event_type end", "note": "repeat(concat(event_type, ' '), cast(event_id % 150 as int))"}


@query(f"SELECT id, regexp_full_match(uuid, '[a-zA-Z0-9_-]{{6,64}}') AS known, CASE WHEN upper(status) IN ('SELECTED', 'REJECTED', 'UNRATED') THEN upper(status) END AS status, substring(note, 1, 500) AS note FROM ({_view(_INPUT, 'events').replace('as string', 'as varchar')})")
def checked_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client sends, checked and cut to its length."""
    rows = _rows(spark, sf_dir, "events", _INPUT)
    return rows.select("id", C.is_key(F.col("uuid")).alias("known"), C.one_of(F.col("status"), ("SELECTED", "REJECTED", "UNRATED")).alias("status"), F.substring("note", 1, 500).alias("note"))


_LOOK = {"photo_id": "l_orderkey * 8 + l_linenumber", **{k: e for k, e in zip(("exposure", "temperature", "tint", "contrast", "highlights", "shadows", "whites", "blacks", "vibrance", "saturation", "sharpness", "noise_reduction"), ("l_discount", "l_quantity - 25", "l_tax * 100", "l_quantity / 4", "-l_quantity / 3", "l_discount * 200", "l_tax * 60", "-l_tax * 45", "l_quantity / 7", "l_discount * 30", "case when l_linenumber > 1 then l_quantity end", "case when l_linenumber > 2 then l_tax * 200 end"), strict=True)}}


@query(f"""SELECT photo_id, round(exposure, 4) AS exposure, trunc(5500 + temperature * 25)::INTEGER AS temperature, {', '.join(f'trunc(round({k}, 6))::INTEGER AS {k}' for k in ('tint', 'contrast', 'highlights', 'shadows', 'whites', 'blacks', 'vibrance', 'saturation'))},
trunc(round(coalesce(sharpness, 15.0), 6))::INTEGER AS sharpness, trunc(round(coalesce(noise_reduction, 10.0), 6))::INTEGER AS smoothing FROM ({_view(_LOOK, 'lineitem')})""")
def preset_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits as the whole numbers of a raw converter's preset."""
    return _rows(spark, sf_dir, "lineitem", _LOOK).select("photo_id", *rules.raw_preset())


_PIXELS = {"image": "l_orderkey", "r": "l_partkey % 256", "g": "(l_suppkey * 7) % 256", "b": "(l_linenumber * 36) % 256"}


@query(f"""WITH p AS (SELECT image, r, g, b, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM ({_view(_PIXELS, 'lineitem')})),
h AS (SELECT image, hi, lo, CASE WHEN hi = lo THEN 0.0 WHEN hi = r THEN ((g - b) * 60.0 / (hi - lo) + 360) % 360 WHEN hi = g THEN (b - r) * 60.0 / (hi - lo) + 120 ELSE (r - g) * 60.0 / (hi - lo) + 240 END AS hue FROM p),
c AS (SELECT image, least(floor(hue / 45), 7)::INTEGER * 4 + CASE WHEN hi = 0 THEN 0 ELSE least(floor(255.0 * (hi - lo) / hi / 64), 3)::INTEGER END AS bin, count(*) AS n FROM h GROUP BY ALL),
a AS (SELECT image, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT image FROM c) CROSS JOIN (SELECT unnest(range(32))::INTEGER AS bin) LEFT JOIN c USING (image, bin)), m AS (SELECT image, min(n) AS low, max(n) AS high FROM a GROUP BY image)
SELECT image, bin, round(CASE WHEN high > low THEN (n - low)::DOUBLE / (high - low) ELSE 0.0 END, 6) AS share FROM a JOIN m USING (image) WHERE n > low""")
def hsv_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour part of a photo's fingerprint: 8 hues by 4 saturations, from 0 to 1; bins of the least count left out."""
    return C.hsv_histogram(_rows(spark, sf_dir, "lineitem", _PIXELS), "image").where("share > 0")
