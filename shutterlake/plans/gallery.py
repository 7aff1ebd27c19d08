"""Gallery lists, facets, albums and mutations over the photo catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions.columns import normal_url, parts, renamed, sequence_number, stem
from shutterlake.operators import rules, selection
from shutterlake.operators.selection import effective
from shutterlake.plans.registry import query
from shutterlake.sources.tables import bridge, photos, table

#: Album entries that one task joins with their photos.
ENTRIES_A_TASK = 250_000
_WINNER = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY user_selection = 'BEST' DESC, ai_recommendation = 'BEST' DESC, ai_score DESC, photo_id) AS rn FROM photos) WHERE rn = 1"


@query(f"WITH CATALOG SELECT photo_id, group_id, eff AS choice, ai_score FROM ({_WINNER}) WHERE eff = 'BEST'")
def best_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners of their groups that count as BEST, best score first."""
    winners = selection.group_winner(photos(spark, sf_dir), "group_id")
    return winners.where(selection.photo_filter("BEST")).select("photo_id", "group_id", effective().alias("choice"), "ai_score").orderBy(F.desc("ai_score"), "photo_id")


@query("""WITH CATALOG SELECT photo_id, group_id, count(*) OVER g AS group_size, first_value(photo_id) OVER o AS best_id, first_value(ai_score) OVER o AS best_score,
  photo_id = first_value(photo_id) OVER o AS is_best FROM photos WINDOW g AS (PARTITION BY group_id), o AS (PARTITION BY group_id ORDER BY eff <> 'BEST', ai_score DESC, photo_id)""")
def group_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.group_meta(photos(spark, sf_dir), "group_id").select("photo_id", "group_id", "group_size", "best_id", "best_score", "is_best")


@query("""WITH CATALOG SELECT project_id, count(*) AS total, count(DISTINCT CASE WHEN eff = 'BEST' THEN group_id END) AS best, count(*) FILTER (WHERE eff = 'SELECTED') AS selected,
  count(*) FILTER (WHERE eff = 'REVIEW') AS review, count(*) FILTER (WHERE eff = 'REJECT') AS reject, count(*) FILTER (WHERE eff = 'SIMILAR') AS similar, count(DISTINCT group_id) AS groups FROM photos GROUP BY project_id""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.facets(photos(spark, sf_dir), "project_id")


@query("WITH CATALOG SELECT eff AS choice, count(*) AS n, round(sum(ai_score), 2) AS score FROM photos WHERE star_rating = 3 AND scene = 'Stage' GROUP BY eff")
def effective_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).where(selection.photo_filter("ALL", 3, "Stage"))
    return rows.groupBy(effective().alias("choice")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ai_score"), 2).alias("score"))


@query("WITH CATALOG SELECT photo_id, group_id, eff AS choice FROM photos WHERE group_id IN (SELECT group_id FROM photos WHERE eff = 'SIMILAR')")
def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.similar_members(photos(spark, sf_dir)).select("photo_id", "group_id", effective().alias("choice"))


@query("WITH CATALOG SELECT photo_id FROM photos WHERE upper(client_selection) = 'SELECTED' OR photo_id IN (SELECT photo_id FROM bridge WHERE choice = 'SELECTED' AND note = 'F')")
def client_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence under OR: chosen in the catalog or in any album."""
    chosen = bridge(spark, sf_dir).where("choice = 'SELECTED' and note = 'F'")
    return selection.exists_flag(photos(spark, sf_dir), chosen, "photo_id", "in_album").where((F.upper("client_selection") == "SELECTED") | F.col("in_album")).select("photo_id")


@query("WITH CATALOG SELECT gallery_id, count(*) AS photos, count(DISTINCT b.photo_id) AS different, round(sum(ai_score), 2) AS score FROM bridge b JOIN photos p ON b.photo_id = p.photo_id GROUP BY gallery_id")
def album_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Album entries with their photos, in so many parts by photo that a task's work stays the same; a photo's entries in an album are counted in its part."""
    entries = bridge(spark, sf_dir).select("gallery_id", "photo_id")
    n = parts(entries, ENTRIES_A_TASK)
    j = entries.repartition(n, "photo_id").join(photos(spark, sf_dir).select("photo_id", "ai_score").repartition(n, "photo_id"), "photo_id")
    once = j.groupBy("gallery_id", "photo_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ai_score").alias("score"))
    return once.groupBy("gallery_id").agg(F.sum("n").alias("photos"), F.count("photo_id").alias("different"), F.round(F.sum("score"), 2).alias("score"))


@query("""WITH CATALOG SELECT s_suppkey AS gallery_id, s_name AS title, count(b.photo_id) AS total, count(CASE WHEN choice = 'SELECTED' THEN 1 END) AS selected FROM supplier LEFT JOIN bridge b ON gallery_id = s_suppkey AND note = 'O' GROUP BY s_suppkey, s_name""")
def gallery_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every album with its counts, zero where it has no photo. Entries are counted before the join."""
    counts = bridge(spark, sf_dir).where("note = 'O'").groupBy("gallery_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("choice") == "SELECTED").alias("selected"))
    albums = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(F.col("s_suppkey").alias("gallery_id"), F.col("s_name").alias("title"))
    return albums.join(counts, "gallery_id", "left").na.fill(0, ["total", "selected"])


@query("""WITH CATALOG, g AS (SELECT photo_id, min(note) AS note FROM bridge WHERE choice = 'SELECTED' GROUP BY photo_id)
SELECT p.photo_id, coalesce(nullif(client_selection, ''), 'GALLERY') AS choice, g.note, g.photo_id IS NOT NULL AS in_gallery FROM photos p LEFT JOIN g ON p.photo_id = g.photo_id WHERE coalesce(client_selection, '') <> 'SELECTED'""")
def coalesce_nullif_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join with a side that is aggregated before."""
    g = bridge(spark, sf_dir).where("choice = 'SELECTED'").groupBy("photo_id").agg(F.min("note").alias("note"), F.lit(True).alias("hit"))
    rows = photos(spark, sf_dir).where(F.coalesce("client_selection", F.lit("")) != "SELECTED").join(g, "photo_id", "left")
    return rows.select("photo_id", F.coalesce(F.nullif("client_selection", F.lit("")), F.lit("GALLERY")).alias("choice"), "note", F.coalesce("hit", F.lit(False)).alias("in_gallery"))


@query("SELECT o_custkey AS project_id, count(*) AS albums FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums whose project is gone: a null-aware anti join."""
    projects = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0").select(F.col("c_custkey").alias("project_id"))
    albums = table(spark, sf_dir, "orders", "o_custkey").select(F.col("o_custkey").alias("project_id"))
    return selection.not_in(albums, projects, "project_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("albums"))


@query("""SELECT e.event_id, e.event_type AS status, o.o_orderkey AS photo_id FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id * 2 END AS remote_id FROM events) e JOIN orders o ON coalesce(remote_id, event_id) = o.o_orderkey""")
def remote_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote rows find their photo by remote id, else by their own."""
    e = table(spark, sf_dir, "events", "event_id", "event_type").withColumn("remote_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 2))
    ids = photos(spark, sf_dir).select("photo_id")
    return e.join(ids, F.coalesce("remote_id", "event_id") == F.col("photo_id")).select("event_id", F.col("event_type").alias("status"), "photo_id")


@query("SELECT p_partkey, first_id FROM (SELECT p_partkey, lower(p_name) AS k FROM part) p JOIN (SELECT lower(p_name) AS k, min(p_partkey) AS first_id FROM part GROUP BY 1) f USING (k)")
def filename_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names meet without regard to case; the smallest id of a name wins."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("k", F.lower("p_name"))
    return p.join(p.groupBy("k").agg(F.min("p_partkey").alias("first_id")), "k").select("p_partkey", "first_id")


@query("WITH CATALOG SELECT filename, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '(_edited)+', ''), '[\\s_-]*\\(\\d+\\)', '')), '^\\s+|\\s+$', '') AS stem, cast(regexp_extract(filename, '(\\d{3,7})', 1) AS BIGINT) AS seq FROM photos")
def stem_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).select("filename", stem(F.col("filename")).alias("stem"), sequence_number(F.col("filename")).alias("seq"))


@query("SELECT page_id, rtrim(regexp_replace(trim(url), '[?#].*$', ''), '/') AS url FROM pages")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", normal_url(F.col("url")).alias("url"))


@query("SELECT part AS folder, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(url, '^https?://', ''), '/')) AS part FROM pages) WHERE part <> '' AND lower(part) NOT IN ('en', 'photos', 'images', 'dcim', 'raw') GROUP BY part HAVING count(*) > 1")
def folder_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of path parts, common folder names left out."""
    part = F.explode(F.split(F.regexp_replace("url", "^https?://", ""), "/")).alias("folder")
    rows = table(spark, sf_dir, "pages", "url").select(part).where((F.col("folder") != "") & ~F.lower("folder").isin("en", "photos", "images", "dcim", "raw"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00012%' OR c_mktsegment ILIKE '%build%'")
def ilike_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").where(F.col("c_name").ilike("%00012%") | F.col("c_mktsegment").ilike("%build%")).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY (o_orderstatus = 'F') DESC, o_orderkey DESC LIMIT 300")
def top_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admin list: 300 rows by status, then newest."""
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").orderBy(F.desc(F.col("o_orderstatus") == "F"), F.desc("o_orderkey")).limit(300)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1998-06-01'")
def expiry_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums past their time that were not submitted; the time is a parameter."""
    now = F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").where((F.col("o_orderstatus") != "F") & F.col("o_orderdate").isNotNull() & (F.col("o_orderdate") < now)).select("o_orderkey")


@query("WITH CATALOG, k AS (SELECT *, count(*) FILTER (WHERE eff <> 'REJECT') OVER (PARTITION BY group_id) AS good FROM photos) SELECT photo_id, group_id FROM k WHERE eff <> 'REJECT' OR good = 0")
def nonreject_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are not rejected; all rows of groups that have no other."""
    p = photos(spark, sf_dir)
    good = p.groupBy("group_id").agg(F.count_if(effective() != "REJECT").alias("good"))
    return p.join(good, "group_id").where((effective() != "REJECT") | (F.col("good") == 0)).select("photo_id", "group_id")


@query("WITH CATALOG SELECT photo_id, CASE WHEN photo_id IN (SELECT photo_id FROM bridge WHERE choice = 'SELECTED') THEN 'SELECTED' ELSE client_selection END AS client_selection FROM photos")
def semi_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.semi_update(photos(spark, sf_dir), bridge(spark, sf_dir).where("choice = 'SELECTED'"), "photo_id", "client_selection", "SELECTED").select("photo_id", "client_selection")


@query("""WITH CATALOG, pick AS (SELECT group_id, min(photo_id) AS pick FROM photos WHERE star_rating = 5 GROUP BY group_id)
SELECT photo_id, CASE WHEN photo_id = pick THEN 'BEST' WHEN pick IS NOT NULL AND eff = 'BEST' THEN 'UNRATED' ELSE user_selection END AS user_selection,
  CASE WHEN photo_id <> pick AND eff = 'BEST' THEN 'SIMILAR' ELSE ai_recommendation END AS ai_recommendation FROM photos LEFT JOIN pick USING (group_id)""")
def promote_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user promotes every photo with five stars."""
    p = photos(spark, sf_dir)
    return selection.promote(p, p.where("star_rating = 5").select("group_id", "photo_id")).select("photo_id", "user_selection", "ai_recommendation")


@query("""WITH CATALOG, t AS (SELECT *, first_value(photo_id) OVER (PARTITION BY group_id ORDER BY ai_score DESC, photo_id) AS top FROM photos)
SELECT photo_id, CASE WHEN user_selection <> 'UNRATED' THEN ai_recommendation WHEN photo_id = top THEN 'BEST' ELSE 'SIMILAR' END AS ai_recommendation FROM t""")
def reset_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.reset_groups(photos(spark, sf_dir)).select("photo_id", "ai_recommendation")


@query("WITH CATALOG SELECT project_id, count(*) FILTER (WHERE eff <> 'REJECT') AS total_photos FROM photos GROUP BY project_id")
def delete_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected photos go and projects are counted anew, down to zero."""
    p = photos(spark, sf_dir)
    left = p.join(p.where(effective() == "REJECT").select("photo_id"), "photo_id", "left_anti").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return p.select("project_id").distinct().join(left, "project_id", "left").select("project_id", F.coalesce("n", F.lit(0)).alias("total_photos"))


@query("""SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, coalesce(n.balance, o.balance) AS balance FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer) o
FULL JOIN (SELECT s_suppkey * 20 AS k, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS balance FROM supplier) n ON n.k = o.k""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal").toDF("k", "name", "balance")
    new = table(spark, sf_dir, "supplier").selectExpr("s_suppkey * 20 as k", "s_name as name", "case when s_suppkey % 2 = 0 then s_acctbal end as balance")
    return selection.upsert(old, new, "k")


@query("SELECT conv_id, role, turn, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each role."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.char_length("text").cast("long").alias("n_chars"))
    return selection.last_write(rows.withColumn("at", F.col("turn")), ["conv_id", "role"], "at").select("conv_id", "role", "turn", "n_chars")


@query("""WITH CATALOG, q AS (SELECT photo_id, filename, is_edited, CASE WHEN upper(client_selection) = 'SELECTED' THEN 'CLIENT_SELECTED' WHEN eff IN ('BEST', 'SELECTED') THEN eff END AS choice, project_id FROM photos)
SELECT photo_id, choice, CASE WHEN choice = 'CLIENT_SELECTED' THEN 'Customer-Selected' WHEN is_edited THEN 'AI-Edited' ELSE 'AI-Selected' END AS folder,
  regexp_replace(filename, '\\.[^.]*$', '') || '_' || lpad(cast(row_number() OVER (PARTITION BY project_id ORDER BY photo_id) AS VARCHAR), 4, '0') || '.jpg' AS target FROM q WHERE choice IS NOT NULL""")
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each exported photo goes, and its new name, numbered within its project."""
    choice = rules.export_choice(("CLIENT_SELECTED", "BEST", "SELECTED"), effective(), F.upper("client_selection") == "SELECTED")
    rows = photos(spark, sf_dir).withColumn("choice", choice).where("choice is not null")
    index = F.row_number().over(Window.partitionBy("project_id").orderBy("photo_id"))
    return rows.select("photo_id", "choice", rules.export_folder(F.col("choice"), F.col("is_edited")).alias("folder"), renamed("{original}_{index}", F.col("filename"), index).alias("target"))


@query("""WITH CATALOG, a AS (SELECT gallery_id, photo_id, max(note || ':' || choice) AS last FROM bridge GROUP BY ALL)
SELECT gallery_id, count(*) AS total, count(*) FILTER (WHERE last LIKE '%:SELECTED') AS selected FROM a GROUP BY gallery_id""")
def album_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Album documents with a map of choices, counted through the map's values."""
    items = bridge(spark, sf_dir).groupBy("gallery_id", "photo_id").agg(F.max(F.concat_ws(":", "note", "choice")).alias("last"))
    albums = items.groupBy("gallery_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("photo_id").cast("string"), "last"))).alias("items"))
    chosen = F.filter(F.map_values("items"), lambda v: v.endswith(":SELECTED"))
    return albums.select("gallery_id", F.size("items").cast("long").alias("total"), F.size(chosen).cast("long").alias("selected"))


@query("""WITH pairs AS (SELECT DISTINCT l_suppkey AS gallery, l_partkey AS name FROM lineitem), here AS (SELECT p_partkey AS name FROM part WHERE p_size <= 30),
m AS (SELECT gallery, count(*) AS n, count(here.name) AS matched FROM pairs LEFT JOIN here USING (name) GROUP BY gallery)
SELECT gallery, n, matched, matched >= greatest(1, cast(floor(0.6 * n + 0.999) AS BIGINT)) AS relinked FROM m""")
def relink_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums go to a new project if three in five of their names are found there."""
    pairs = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").toDF("gallery", "name").distinct()
    here = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size <= 30").select(F.col("p_partkey").alias("name"), F.lit(1).alias("hit"))
    m = pairs.join(here, "name", "left").groupBy("gallery").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("matched"))
    return m.withColumn("relinked", F.col("matched") >= F.greatest(F.lit(1), F.floor(0.6 * F.col("n") + 0.999)))
