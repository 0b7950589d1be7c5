"""Valuation queries: parts stand for assets with prices, line items for amounts, events for snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import numbers
from vigilspark.operators import portfolio as P
from vigilspark.plans.catalog import query, table


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("asset"), F.col("p_retailprice").alias("usd"))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("asset")).agg(F.sum("l_quantity").alias("amount"))


_TVL = """SELECT l_partkey AS asset, sum(l_quantity) AS amount, round(sum(l_quantity) * coalesce(any_value(CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END), 0), 4) AS usd
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1"""


@query(_TVL)
def tvl_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.valued(_amounts(spark, sf_dir), _prices(spark, sf_dir)).withColumn("usd", F.round("usd", 4)).select("asset", "amount", "usd")


@query(f"SELECT round(sum(usd), 2) AS usd FROM ({_TVL})")
def tvl_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.total_usd(P.valued(_amounts(spark, sf_dir), _prices(spark, sf_dir))).withColumn("usd", F.round("usd", 2))


@query("""SELECT round(coalesce(max(CASE WHEN p_name = 'no such part' THEN p_retailprice / p_size END), arg_min(p_retailprice / p_size, p_partkey), 0), 8) AS usd FROM part WHERE p_size > 0 AND p_retailprice > 0""")
def price_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = table(spark, sf_dir, "part").select(F.col("p_name").alias("asset"), F.col("p_partkey").alias("pos"), F.col("p_size").cast("string").alias("assetPrice"), F.col("p_retailprice").cast("string").alias("assetPriceUSD"))
    return P.home_price(pools, "no such part").select(F.round("usd", 8).alias("usd"))


@query("""WITH r AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 'x/bow-' || l_partkey WHEN l_partkey % 3 = 1 THEN 'thor.k' || (l_partkey % 50) ELSE 'k' || (l_partkey % 50) END AS denom, CAST(l_quantity * 1000000 AS BIGINT) AS raw FROM lineitem),
s AS (SELECT upper(regexp_extract(denom, '([^.]*)$', 1)) AS asset, sum(raw) AS t FROM r WHERE NOT starts_with(denom, 'x/bow-') GROUP BY 1)
SELECT asset, CAST(t AS BIGINT) AS total, CASE WHEN t / 1e8 > 10000 THEN CAST(CAST(t / 100000000000 AS DECIMAL(20, 1)) AS VARCHAR) || 'k' WHEN t / 1e8 > 1 THEN CAST(CAST(t AS DECIMAL(38, 10)) / 100000000 AS DECIMAL(30, 2))::VARCHAR ELSE CAST(CAST(t AS DECIMAL(38, 10)) / 100000000 AS DECIMAL(30, 4))::VARCHAR END AS amount FROM s""")
def balances_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    denom = F.when(k % 3 == 0, F.concat(F.lit("x/bow-"), k)).when(k % 3 == 1, F.concat(F.lit("thor.k"), k % 50)).otherwise(F.concat(F.lit("k"), k % 50))
    rows = table(spark, sf_dir, "lineitem").select(denom.alias("denom"), (F.col("l_quantity") * 1_000_000).cast("bigint").cast("string").alias("amount"))
    return P.merged_balances(rows).withColumn("total", F.col("total").cast("bigint"))


def _transfers(spark: SparkSession, sf_dir: str, **asked: str) -> DataFrame:
    """Line items as transfer events: one hash each, an attribute list with a repeated key, coins as text."""
    line = table(spark, sf_dir, "lineitem")
    coins = F.concat((F.col("l_quantity") * 100_000_000).cast("bigint").cast("string"), F.lit("thor.a"), (F.col("l_partkey") % 5).cast("string"), F.lit(",7"))
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    attrs = F.array(attr("recipient", F.lit("nobody")), attr("recipient", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))), attr("sender", F.concat(F.lit("o"), (F.col("l_orderkey") % 10).cast("string"))), attr("amount", coins))
    hash_ = F.sha1(F.concat_ws("|", *line.columns))
    events = F.array(F.struct(F.lit("transfer").alias("type"), attrs.alias("attributes")))
    return P.transfers(line.select(hash_.alias("txhash"), events.alias("events"), F.array(F.struct(events.alias("events"))).alias("logs")), **asked)


_DISTINCT = "(SELECT DISTINCT * FROM lineitem)"


@query(f"SELECT 'a' || (l_partkey % 5) AS asset, sum(l_quantity) AS amount FROM {_DISTINCT} WHERE l_suppkey = 3 GROUP BY 1")
def transfers_by_recipient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.incoming(_transfers(spark, sf_dir, recipient="s3"), "s3")


@query(f"SELECT 'a' || (l_partkey % 5) AS asset, sum(l_quantity) AS amount FROM {_DISTINCT} WHERE l_orderkey % 10 = 4 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) GROUP BY 1")
def transfers_to_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    wallets = table(spark, sf_dir, "supplier").filter("s_acctbal < 2000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("address"))
    return P.sent_to_set(_transfers(spark, sf_dir, sender="o4"), "o4", wallets)


@query("""SELECT l_returnflag, round(sum(CASE WHEN l_discount > 0 THEN l_tax / (l_discount * 100 / 10000) END), 4) AS volume FROM lineitem GROUP BY 1""")
def fee_volume_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("v", numbers.volume_from_fees(F.col("l_tax"), F.col("l_discount") * 100))
    return rows.groupBy("l_returnflag").agg(F.round(F.sum("v"), 4).alias("volume"))


_DAILY = "SELECT date_trunc('day', ts) AS day, event_type AS asset, max(value) AS amount FROM events GROUP BY 1, 2"


@query(f"""WITH d AS ({_DAILY}), x AS (SELECT *, greatest(0, amount - coalesce(lag(amount) OVER (PARTITION BY asset ORDER BY day), 0)) AS delta FROM d),
t AS (SELECT day, sum(delta * length(asset)) AS usd FROM x GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, round(sum(usd) OVER (ORDER BY day), 4) AS locked_usd FROM t""")
def snapshot_delta_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), F.col("event_type").alias("asset")).agg(F.max("value").alias("amount"))
    grown = P.locked_volume(daily, "asset", "day", "amount", F.length("asset").cast("double"))
    total = P.running_total(grown.groupBy("day").agg(F.sum("delta_usd").alias("usd")), "day", "usd")
    return total.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("locked_usd", 4).alias("locked_usd"))


@query("""WITH s AS (SELECT date_trunc('day', ts) AS day, sum(value) AS tvl, count(DISTINCT user_id) AS wallets, sum(value) FILTER (event_type = 'purchase') AS revenue FROM events GROUP BY 1),
n AS (SELECT * FROM s ORDER BY day DESC LIMIT 1), b AS (SELECT s.* FROM s, n WHERE s.day <= n.day - INTERVAL 24 HOURS ORDER BY s.day DESC LIMIT 1)
SELECT round((n.tvl - b.tvl) / b.tvl * 100, 6) AS tvl_change, n.wallets - b.wallets AS wallet_change, round((n.revenue - b.revenue) / b.revenue * 100, 6) AS revenue_change, round((n.revenue - b.revenue) / b.revenue * 100, 6) AS volume_change FROM n LEFT JOIN b ON true""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    snaps = events.groupBy("day").agg(F.sum("value").alias("tvl"), F.count_distinct("user_id").alias("wallets"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("revenue"), F.lit(0.0).alias("volume"))
    now = snaps.orderBy(F.desc("day")).limit(1)
    before = snaps.join(F.broadcast(now.select(F.col("day").alias("now"))), F.col("day") <= F.col("now") - F.expr("INTERVAL 24 HOURS")).drop("now").orderBy(F.desc("day")).limit(1)
    got = P.changes(now, before)
    return got.select(*[F.round(c, 6).alias(c) if c != "wallet_change" else F.col(c) for c in got.columns])


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY time_bucket(INTERVAL 10 MINUTES, ts) ORDER BY ts) = 1")
def snapshots_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.thinned(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts"), "ts", 10).select("event_id")


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 4 = 1 THEN 'BTC.BTC' ELSE 'X.' || p_partkey END AS asset, p_retailprice / p_size AS usd FROM part WHERE p_size > 0 AND p_retailprice > 0 AND p_partkey % 8 <> 1)
SELECT round(coalesce(max(usd) FILTER (asset = 'BTC.BTC'), 0), 8) AS usd FROM p""")
def price_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home asset's price from the reference pool, which stands several times, some without a price."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 1, "BTC.BTC").otherwise(F.concat(F.lit("X."), k.cast("string")))
    usd = F.when(k % 8 == 1, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    pools = table(spark, sf_dir, "part").select(name.alias("asset"), k.alias("pos"), F.col("p_size").cast("string").alias("assetPrice"), usd.alias("assetPriceUSD"))
    return P.home_price(pools).select(F.round("usd", 8).alias("usd"))


_CHANGES = "SELECT date_trunc('day', ts) AS day, sum(value) AS tvl, count(DISTINCT user_id) AS wallets, sum(value) FILTER (event_type = 'purchase') AS revenue, sum(value) FILTER (event_type = 'click') AS volume FROM events GROUP BY 1"


@query(f"""WITH s AS ({_CHANGES}), n AS (SELECT * FROM s ORDER BY day DESC LIMIT 1), b AS (SELECT s.* FROM s, n WHERE s.day <= n.day - INTERVAL 24 HOURS ORDER BY s.day DESC LIMIT 1)
SELECT round((n.volume - b.volume) / b.volume * 100, 6) AS volume_change, round((n.revenue - b.revenue) / b.revenue * 100, 6) AS revenue_change FROM n LEFT JOIN b ON true""")
def snapshot_volume_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the last day against the day before where volume is known."""
    events = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")))
    snaps = events.groupBy("day").agg(F.sum("value").alias("tvl"), F.count_distinct("user_id").alias("wallets"), of("purchase").alias("revenue"), of("click").alias("volume"))
    now = snaps.orderBy(F.desc("day")).limit(1)
    before = snaps.join(F.broadcast(now.select(F.col("day").alias("now"))), F.col("day") <= F.col("now") - F.expr("INTERVAL 24 HOURS")).drop("now").orderBy(F.desc("day")).limit(1)
    return P.changes(now, before).select(F.round("volume_change", 6).alias("volume_change"), F.round("revenue_change", 6).alias("revenue_change"))
