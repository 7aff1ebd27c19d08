"""Orders, partners, coupons, limits and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions.columns import commission, discount, exif_time, json_or, masked, rounded
from shutterlake.operators import rules, selection, sequences
from shutterlake.plans.registry import query
from shutterlake.sources.tables import table


@query("SELECT o_orderstatus AS currency, count(*) AS n, round(sum(o_totalprice), 2) AS revenue, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS recent FROM orders GROUP BY 1")
def revenue_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice", "o_orderdate").groupBy(F.col("o_orderstatus").alias("currency")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count_if(F.col("o_orderdate") >= since).alias("recent")
    )


@query("""SELECT n_nationkey AS agent, n_name AS name, coalesce(s.codes, '') AS codes, coalesce(o.orders, 0) AS orders, coalesce(round(o.amount, 2), 0) AS amount FROM nation
LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY s_name) AS codes FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS orders, sum(o_totalprice) AS amount FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) o ON c_nationkey = n_nationkey""")
def partner_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners with their codes and sales; each part is grouped before the join."""
    codes = table(spark, sf_dir, "supplier", "s_nationkey", "s_name").groupBy(F.col("s_nationkey").alias("agent")).agg(F.expr("listagg(s_name, ', ') within group (order by s_name)").alias("codes"))
    by_customer = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("amount"))
    sales = by_customer.join(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), "c_custkey").groupBy(F.col("c_nationkey").alias("agent")).agg(F.sum("n").alias("orders"), F.round(F.sum("amount"), 2).alias("amount"))
    agents = table(spark, sf_dir, "nation", "n_nationkey", "n_name").toDF("agent", "name")
    return agents.join(codes, "agent", "left").join(sales, "agent", "left").select("agent", "name", F.coalesce("codes", F.lit("")).alias("codes"), F.coalesce("orders", F.lit(0).cast("long")).alias("orders"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


@query("""SELECT count(*) FILTER (WHERE event_type = 'signup') AS signups, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20') AS expiring, count(DISTINCT user_id) AS seen, coalesce(round(sum(CASE WHEN event_type = 'purchase' THEN value END), 2), 0) AS paid FROM events""")
def time_predicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, sf_dir, "events", "event_type", "ts", "user_id", "value").agg(
        F.count_if(F.col("event_type") == "signup").alias("signups"),
        F.count_if((F.col("ts") >= at("2024-01-10 00:00:00")) & (F.col("ts") < at("2024-01-20 00:00:00"))).alias("expiring"),
        F.countDistinct("user_id").alias("seen"),
        F.coalesce(F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 2), F.lit(0.0)).alias("paid"),
    )


@query("""WITH c AS (SELECT c_custkey, lower(c_mktsegment) || c_nationkey AS mail, 'P' || cast(c_custkey % 997 AS VARCHAR) AS phone FROM customer), s AS (SELECT s_suppkey, 'building' || s_nationkey AS mail, 'P' || cast(s_suppkey AS VARCHAR) AS phone FROM supplier)
SELECT DISTINCT c_custkey AS l, s_suppkey AS r FROM c JOIN s ON c.mail = s.mail OR c.phone = s.phone""")
def identity_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same customer by mail or by phone: one equi-join each."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(lower(c_mktsegment), c_nationkey) as mail", "concat('P', c_custkey % 997) as phone")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('building', s_nationkey) as mail", "concat('P', s_suppkey) as phone")
    return selection.or_match(c, s, {"mail": "mail", "phone": "phone"}, "c_custkey", "s_suppkey")


@query("""SELECT o_custkey AS customer, agent FROM (SELECT o_custkey, o_orderkey % 5 AS agent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderkey % 5 > 0) WHERE rn = 1""")
def first_referrer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partner of a customer's first order that has one."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate").withColumn("agent", F.col("o_orderkey") % 5)
    return o.where("agent > 0").groupBy(F.col("o_custkey").alias("customer")).agg(F.min_by("agent", F.struct("o_orderdate", "o_orderkey")).alias("agent"))


_COUPONS = "SELECT p_partkey AS id, p_size % 2 AS active, p_size * 100 AS valid_until, p_partkey % 5 AS max_uses, p_partkey % 7 AS used, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'pro,studio' ELSE 'studio' END AS plans, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 10 END AS agent_id FROM part"


@query(f"""WITH c AS ({_COUPONS}), q AS (SELECT o_orderkey, o_totalprice AS base, CASE WHEN o_orderkey % 2 = 0 THEN 'INR' ELSE 'USD' END AS currency, c.*, CASE WHEN agent_id < 5 THEN 'ACTIVE' WHEN agent_id IS NOT NULL THEN 'BLOCKED' END AS agent_status FROM orders LEFT JOIN c ON id = o_orderkey),
e AS (SELECT *, CASE WHEN id IS NULL OR active = 0 THEN 'Invalid or expired coupon code' WHEN valid_until > 0 AND valid_until < 1500 THEN 'This coupon has expired' WHEN max_uses > 0 AND used >= max_uses THEN 'This coupon has reached its usage limit'
  WHEN plans <> '' AND NOT list_contains(string_split(plans, ','), 'pro') THEN 'This coupon is not valid for the pro plan' WHEN agent_id IS NOT NULL AND agent_status <> 'ACTIVE' THEN 'This referral code is no longer active' END AS error FROM q)
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN greatest(0, base - CASE WHEN currency = 'INR' THEN round(base * 15 / 100) ELSE round(base * 15 / 100, 2) END) END AS final_price FROM e""")
def quote_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote per order: the first error of its coupon, or the price after the discount."""
    c = table(spark, sf_dir, "part").selectExpr(*_COUPONS.removeprefix("SELECT ").removesuffix(" FROM part").replace("'pro,studio'", "'pro;studio'").split(", "))
    c = c.withColumn("plans", F.replace("plans", F.lit(";"), F.lit(",")))
    q = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").join(c, F.col("id") == F.col("o_orderkey"), "left")
    status = F.when(F.col("agent_id") < 5, "ACTIVE").when(F.col("agent_id").isNotNull(), "BLOCKED")
    names = {"code": F.col("id"), "agent_status": status} | {k: F.col(k) for k in ("active", "valid_until", "max_uses", "used", "plans", "agent_id")}
    error = rules.coupon_error(F.lit(1500), F.lit("pro"), names)
    currency = F.when(F.col("o_orderkey") % 2 == 0, "INR").otherwise("USD")
    price = F.greatest(F.lit(0.0), F.col("o_totalprice") - discount(F.col("o_totalprice"), F.lit(15), currency))
    return q.select("o_orderkey", error.alias("error"), F.when(error.isNull(), price).alias("final_price"))


@query("SELECT l_suppkey AS agent, count(*) AS sales, round(sum(round(cast(l_extendedprice * (l_discount * 100) / 100 AS DECIMAL(20,8)), 2))::DOUBLE, 2) AS earned FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def commissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    earned = commission(F.col("l_extendedprice"), F.col("l_discount") * 100)
    return table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag").where("l_returnflag <> 'R'").groupBy(F.col("l_suppkey").alias("agent")).agg(F.count(F.lit(1)).alias("sales"), F.round(F.sum(earned), 2).alias("earned"))


_HITS = "SELECT event_id, user_id, cast(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000000), event_id) AS rn FROM events"


@query(f"""WITH RECURSIVE h AS MATERIALIZED ({_HITS}), w AS (SELECT user_id, rn, event_id, t AS window_start, 1 AS hits FROM h WHERE rn = 1
UNION ALL SELECT h.user_id, h.rn, h.event_id, CASE WHEN h.t - w.window_start >= 86400 THEN h.t ELSE w.window_start END, CASE WHEN h.t - w.window_start >= 86400 THEN 1 ELSE w.hits + 1 END FROM w JOIN h ON h.user_id = w.user_id AND h.rn = w.rn + 1)
SELECT user_id, event_id AS id, window_start, hits, hits <= 3 AS allowed FROM w""")
def rate_limit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hits per user in a day that starts with the first."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts").select("user_id", F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return sequences.fixed_window(e, "user_id", "t", 3, 86400)


@query(f"WITH h AS ({_HITS}) SELECT event_id, n, n < 3 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING) AS n FROM h)")
def rolling_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of the same user in the 30 days before."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-2592000, -1))
    return table(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("t", t).select("event_id", n.alias("n")).withColumn("allowed", F.col("n") < 3)


@query("""SELECT user_id, n, CASE WHEN n >= 5 THEN latest END AS latest FROM (SELECT user_id, count(*) AS n, max(strftime(ts, '%Y:%m:%d %H:%M:%S')) AS latest FROM events WHERE event_type = 'view' GROUP BY user_id)""")
def clock_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest camera time as text, given if five photos or more have one."""
    rows = table(spark, sf_dir, "events", "user_id", "event_type", "ts").where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("latest"))
    return rows.select("user_id", "n", F.when(F.col("n") >= 5, F.col("latest")).alias("latest"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE cast(floor(epoch_us(ts) / 1000000) AS BIGINT) END AS seconds FROM events")
def exif_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera times from text and back; a malformed text gives null, here -1."""
    text = F.when(F.col("event_id") % 5 == 0, F.lit("0000:00:00 broken text")).otherwise(F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit(".123")))
    return table(spark, sf_dir, "events", "event_id", "ts").select("event_id", F.coalesce(F.unix_seconds(exif_time(text)), F.lit(-1)).alias("seconds"))


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(p, '$.k') AS BIGINT), 50) AS temperature, 5.0::DOUBLE AS vibrance FROM (SELECT event_id, CASE WHEN event_id % 6 > 0 AND json_valid(props) THEN props END AS p FROM events)""")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of a JSON text with defaults; a sixth of the texts is malformed."""
    text = F.when(F.col("event_id") % 6 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", json_or(text, "$.k", "long", 50).alias("temperature"), json_or(text, "$.vibrance", "double", 5.0).alias("vibrance"))


@query("SELECT event_id, cast(trunc(5500 + 25 * k) AS INTEGER) AS temperature, round(cast(value / 100 AS DECIMAL(20,8)), 2)::DOUBLE AS exposure FROM (SELECT event_id, value, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def xmp_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events", "event_id", "props", "value").select("event_id", (5500 + 25 * k).cast("int").alias("temperature"), rounded(F.col("value") / 100, 2).alias("exposure"))


@query("SELECT user_id, list_aggregate(list_transform(list_slice(l, greatest(1, len(l) - 9), len(l)), lambda x: cast(x AS VARCHAR)), 'string_agg', ',') AS tail FROM (SELECT user_id, list(event_id ORDER BY event_id) AS l FROM events GROUP BY user_id)")
def last_n_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten log entries of each user, by a ranked top-k that no group has to fit in memory for."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    last = table(spark, sf_dir, "events", "user_id", "event_id").withColumn("r", F.row_number().over(w)).where("r <= 10")
    return last.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("tail"))


@query("SELECT c_custkey, left(c_name, 4) || '…' || right(c_name, 4) AS masked, left(md5(c_name), 12) AS cache_key FROM customer WHERE length(c_name) >= 8")
def masked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").where(F.length("c_name") >= 8).select("c_custkey", masked(F.col("c_name")).alias("masked"), F.left(F.md5("c_name"), F.lit(12)).alias("cache_key"))
