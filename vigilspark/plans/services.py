"""Requests and syncs: curated lists, screening counts, reports, points in polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.operators import fixed_lists, geo, history, jobs, portfolio
from vigilspark.plans import histories
from vigilspark.plans.catalog import query, table

_NOW = "TIMESTAMP '2024-01-30 00:00:00'"


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = F.col("c_acctbal") < 0
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("thor_address"), flagged.alias("flagged"), F.expr(f"{_NOW} - make_interval(0, 0, 0, 0, c_custkey)").alias("first_seen"), F.expr(f"{_NOW} - make_interval(0, 0, 0, 0, 2 * c_custkey)").alias("screened_at"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listed entries, one source for each type."""
    source = F.expr("CASE event_type WHEN 'click' THEN 'OFAC' WHEN 'view' THEN 'EU' WHEN 'purchase' THEN 'HACK' WHEN 'signup' THEN 'TETHER' ELSE 'MANUAL' END")
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("address"), F.lit("BTC").alias("chain"), source.alias("source"), F.lit("e").alias("entity_name"), F.lit("r").alias("reason"), F.col("ts").cast("timestamp").alias("added_at"), F.col("ts").cast("timestamp").alias("last_seen"))


@query("""SELECT (SELECT count(*) FROM customer) AS total_users, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS flagged_users, count(*) FILTER (event_type = 'click') AS ofac_entries,
count(*) FILTER (event_type = 'view') AS eu_entries, count(*) FILTER (event_type = 'purchase') AS hack_entries, count(*) FILTER (event_type IN ('click', 'view', 'purchase')) AS total_list_entries FROM events""")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stats(_users(spark, sf_dir), _entries(spark, sf_dir))


@query("""SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS flagged, (SELECT count(*) FROM customer WHERE c_custkey < 24) AS users_24h,
(SELECT count(*) FROM customer WHERE c_acctbal < 0 AND 2 * c_custkey < 24) AS flagged_24h, count(*) AS entries, count(*) FILTER (event_type = 'signup') AS tether,
count(*) FILTER (ts > TIMESTAMP '2024-01-29') AS entries_24h, (SELECT count(DISTINCT (o_orderpriority, o_custkey)) FROM orders) AS links, (SELECT count(DISTINCT (o_orderpriority, o_custkey)) FROM orders WHERE o_orderstatus = 'P') AS links_24h FROM events""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.when(F.col("o_orderstatus") == "P", F.expr(_NOW)).otherwise(F.expr("TIMESTAMP '2000-01-01 00:00:00'"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("l1_address"), F.col("o_orderpriority").alias("chain"), seen.alias("discovered_at"))
    got = jobs.overview(_users(spark, sf_dir), _entries(spark, sf_dir), edges, F.expr(_NOW))
    return got.select("users", "flagged", "users_24h", "flagged_24h", "entries", "tether", "entries_24h", "links", "links_24h")


_INCIDENTS = ", ".join(str((k, *r)) for k, r in enumerate(fixed_lists.INCIDENTS))


@query(f"""WITH i AS (SELECT *, CASE WHEN chain = 'ETH' THEN lower(address) ELSE address END AS a FROM (VALUES {_INCIDENTS}) v(k, address, chain, incident, usd, day, who)),
l AS (SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN event_id % 40 END AS k, CAST(event_id AS VARCHAR) AS own FROM events), known AS (SELECT DISTINCT k FROM l WHERE k < {len(fixed_lists.INCIDENTS)} AND event_id % 3 = 0),
s AS (SELECT a AS address, chain, incident AS entity_name, CASE WHEN known.k IS NULL THEN incident || ' — est. $' || format('{{:,}}', usd) || ' (' || who || ')' ELSE incident || ' (' || who || ')' END AS reason, 'HACK' AS source FROM i LEFT JOIN known USING (k))
SELECT address, chain, entity_name, reason, source FROM s UNION ALL SELECT own, 'BTC', 'e', 'r', 'EU' FROM l WHERE event_type = 'view'""")
def incident_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated incidents synced into entries made of events: clicks name some incidents that are listed already, views are entries of another list."""
    now = F.expr(_NOW)
    known = fixed_lists.incidents(spark).withColumn("address", F.when(F.col("chain") == "ETH", F.lower("address")).otherwise(F.col("address")))
    order = {r[0].lower() if r[1] == "ETH" else r[0]: k for k, r in enumerate(fixed_lists.INCIDENTS)}
    number = F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("address"))
    named = table(spark, sf_dir, "events").filter("event_type = 'click' AND event_id % 3 = 0").select((F.col("event_id") % 40).cast("int").alias("k")).distinct()
    listed = known.withColumn("k", number).join(named, "k", "left_semi").select("address", "chain", F.lit("HACK").alias("source"), F.lit("old").alias("entity_name"), F.lit("old").alias("reason"), now.alias("added_at"), now.alias("last_seen"))
    entries = _entries(spark, sf_dir).filter("source = 'EU'").select(*listed.columns).unionByName(listed)
    return jobs.sync_incidents(entries, fixed_lists.incidents(spark), now).select("address", "chain", "entity_name", "reason", "source")


@query(f"""WITH b AS (SELECT * FROM (VALUES {", ".join(str(r) for r in fixed_lists.FROZEN)}) v(address, chain)), s AS (SELECT 'T' || s_suppkey AS address, 'TRX' AS chain, s_suppkey AS k FROM supplier)
SELECT address, chain, 'USDT blacklisted address (ETH)' AS reason FROM b
UNION ALL SELECT address, chain, CASE WHEN k % 3 = 0 THEN 'USDT address (unfrozen by Tether)' ELSE 'USDT blacklisted address (TRX)' END FROM s""")
def frozen_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen baseline with suppliers as a feed, every third of which was unfrozen."""
    feed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("T"), "s_suppkey").alias("address"), F.lit("TRX").alias("chain"), F.col("s_suppkey").alias("k"))
    removed = feed.filter("k % 3 = 0").select(F.lower("address").alias("address"))
    got = jobs.sync_frozen(_entries(spark, sf_dir).limit(0), fixed_lists.frozen_baseline(spark), [feed.drop("k")], [removed], F.expr(_NOW))
    return got.select("address", "chain", "reason")


@query(f"""WITH {histories._DECODED}, t AS (SELECT * FROM (VALUES {", ".join(str(kv) for kv in fixed_lists.TYPE_LABELS.items())}) v(kind, label)) SELECT type AS kind, coalesce(t.label, type) AS label, count(*) AS n FROM h LEFT JOIN t ON t.kind = type GROUP BY ALL""")
def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display names of the types that actions have."""
    rows = history.parse_actions(histories.contract_actions(spark, sf_dir), fixed_lists.contracts(spark))
    return rows.groupBy(F.col("type").alias("kind"), history.type_label(F.col("type")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH {histories._DECODED}, l AS (SELECT k, f.address AS a FROM o JOIN c f ON s_known AND f.i = k % {histories._N} UNION SELECT k, t.address FROM o JOIN c t ON r_known AND t.i = k // 11 % {histories._N} UNION SELECT k, x.address FROM o JOIN c x ON t_known AND x.i = k * 3 % {histories._N})
SELECT category, count(*) AS actions, count(DISTINCT a) AS contracts, min(name) AS first_name FROM l JOIN c ON c.address = a GROUP BY category""")
def known_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known contracts that actions name among their senders and recipients, by category."""
    actions = histories.contract_actions(spark, sf_dir)
    legs = F.array_distinct(F.transform(F.concat("`in`", "`out`"), lambda x: x["address"]))
    named = actions.select(F.explode(legs).alias("address")).join(fixed_lists.contracts(spark), "address")
    return named.groupBy("category").agg(F.count("*").alias("actions"), F.count_distinct("address").alias("contracts"), F.min("name").alias("first_name"))


@query("""WITH p AS (SELECT c_custkey, c_custkey * 37 % 3600 / 10.0 - 179.95 AS lon, c_custkey * 53 % 1800 / 10.0 - 89.95 AS lat FROM customer), n AS (SELECT n_nationkey, n_nationkey * 12 - 150.0 AS x, n_regionkey * 30 - 60.0 AS y FROM nation)
SELECT c_custkey, CAST(n_nationkey AS VARCHAR) AS polygon FROM p, n WHERE abs(lon - x) < 14 AND abs(lat - y) < 14 AND NOT (abs(lon - x) < 3 AND abs(lat - y) < 3)""")
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points, nations as squares with a square hole."""
    points = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 3600 / 10 - 179.95).alias("lon"), (F.col("c_custkey") * 53 % 1800 / 10 - 89.95).alias("lat"))
    x, y = F.col("n_nationkey") * 12 - 150.0, F.col("n_regionkey") * 30 - 60.0
    square = lambda r: F.array(*[F.array(x + a * r, y + b * r) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    polygons = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("polygon"), F.array(square(14), square(3)).alias("rings"))
    return geo.within(points, polygons).select("c_custkey", "polygon")


@query("""WITH pr AS (SELECT 'k' || p_partkey AS asset, p_retailprice AS usd FROM part WHERE p_partkey <= 40), l AS (SELECT 'k' || (l_partkey % 50) AS asset, l_returnflag AS f, sum(l_quantity) AS amount FROM lineitem GROUP BY ALL),
v AS (SELECT l.*, amount * coalesce(usd, 0) AS usd FROM l LEFT JOIN pr USING (asset)), s AS (SELECT date_trunc('day', ts) AS day, sum(value) AS tvl, count(DISTINCT user_id) AS wallets, max(value) AS fees FROM events GROUP BY 1),
o AS (SELECT * FROM s WHERE day <= TIMESTAMP '2024-01-30' - INTERVAL 24 HOURS ORDER BY day DESC LIMIT 1), n AS (SELECT sum(usd) FILTER (f = 'A') AS tvl, sum(usd) FILTER (f = 'R') AS fees, sum(usd) FILTER (f = 'N') AS volume FROM v)
SELECT round(n.tvl, 2) AS tvl_usd, CAST(77 AS INTEGER) AS wallets, round(n.fees, 2) AS fees_usd, round(n.volume + 1000, 2) AS volume_usd, true AS volume_is_real, round((n.tvl - o.tvl) / o.tvl * 100, 4) AS tvl_change, CAST(77 - o.wallets AS INTEGER) AS wallet_change,
  round((n.fees - o.fees) / o.fees * 100, 4) AS revenue_change, round((n.volume + 1000 - 1000) / 1000 * 100, 4) AS volume_change FROM n, o""")
def protocol_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as assets held, fees and volume by flag; days of events as the snapshots before."""
    now = F.expr(_NOW)
    price = table(spark, sf_dir, "part").filter("p_partkey <= 40").select(F.concat(F.lit("k"), "p_partkey").alias("asset"), F.col("p_retailprice").alias("usd"))
    amounts = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("k"), (F.col("l_partkey") % 50)).alias("asset"), F.col("l_returnflag").alias("f")).agg(F.sum("l_quantity").alias("amount"))
    tvl, fees, volume = (amounts.filter(F.col("f") == f).drop("f") for f in "ARN")
    days = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("created_at")).agg(F.sum("value").cast("string").alias("tvl_usd"), F.count_distinct("user_id").cast("int").alias("wallet_count"), F.max("value").cast("string").alias("cumulative_fees_usd"))
    none = F.lit(None).cast("array<struct<asset:string,amount:double>>")
    before = days.filter(F.col("created_at") < now).withColumns({"revenue_usd": F.lit("0"), "cumulative_volume_usd": F.lit("1000"), "cumulative_volume_assets": none})
    made = portfolio.snapshot(tvl, 77, fees, fees, volume, price, before, now)
    got = portfolio.report(made, before, now)
    return got.select(*[F.round(c, 2).alias(c) if c.endswith("_usd") else F.round(c, 4).alias(c) if c.endswith("change") and c != "wallet_change" else F.col(c) for c in got.columns])
