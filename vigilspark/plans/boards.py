"""Dashboard queries: counts, groups, status summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import numbers
from vigilspark.operators import dashboards as D
from vigilspark.plans.catalog import query, table

_NOW = "TIMESTAMP_NTZ '2024-01-30 00:00:00'"
_K = "from_json(props, 'k int').k"


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase' AND value > 10) AS big,
count(*) FILTER (ts > TIMESTAMP '2024-01-30' - INTERVAL 24 HOURS) AS day, count(*) FILTER (ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS) AS week FROM events""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, now = table(spark, sf_dir, "events"), F.expr(_NOW)
    within = {n: F.col("ts") > now - F.expr(f"INTERVAL {i}") for n, i in (("day", "24 HOURS"), ("week", "7 DAYS"))}
    return D.counts(events, {"errors": F.col("event_type") == "error", "big": (F.col("event_type") == "purchase") & (F.col("value") > 10)} | within)


@query("""SELECT count(DISTINCT o_custkey || ':' || o_orderpriority) AS pairs, count(DISTINCT CASE WHEN o_orderdate > TIMESTAMP '2000-01-01' THEN o_custkey || ':' || o_orderpriority END) AS late_pairs FROM orders""")
def distinct_pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    late = F.col("o_orderdate") > F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")
    return orders.agg(D.distinct_pairs(orders, "o_custkey", "o_orderpriority").alias("pairs"), D.distinct_pairs(orders, "o_custkey", "o_orderpriority", late).alias("late_pairs"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.by_group(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("SELECT coalesce(nullif(o_orderpriority, '5-LOW'), 'UNKNOWN') AS chain, count(*) AS n FROM orders GROUP BY 1")
def counts_by_chain_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.by_group(table(spark, sf_dir, "orders").withColumn("chain", F.nullif("o_orderpriority", F.lit("5-LOW"))), "chain", "UNKNOWN")


@query("SELECT string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) AS counts FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)")
def counts_as_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = D.as_map(D.by_group(table(spark, sf_dir, "lineitem"), "l_returnflag"), "l_returnflag", "n")
    return made.select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("""SELECT event_type, count(*) AS runs, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at, arg_max(value, (ts, event_id)) AS last_value, arg_max(CAST(props->>'k' AS INTEGER), (ts, event_id)) AS last_k FROM events GROUP BY 1""")
def sync_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("k", F.expr(_K))
    return D.status(log, "event_type", "ts", "event_id", ["value", "k"]).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("""WITH s AS (SELECT DISTINCT upper(substr(event_type, 1, 1)) AS k, event_type FROM events), c AS (SELECT upper(substr(c_mktsegment, 1, 1)) AS k, count(*) AS n FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1)
SELECT event_type, n FROM s LEFT JOIN c USING (k)""")
def sync_with_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "events").select("event_type", F.upper(F.substring("event_type", 1, 1)).alias("k")).distinct()
    lists = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'").groupBy(F.upper(F.substring("c_mktsegment", 1, 1)).alias("k")).agg(F.count("*").alias("n"))
    return types.join(lists, "k", "left").select("event_type", "n")


@query("""WITH f AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 50.0) AS BIGINT) AS pages FROM f ORDER BY o_orderkey LIMIT 50""")
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey")
    return D.with_totals(rows.orderBy("o_orderkey").limit(50), rows).withColumn("pages", numbers.pages(F.col("total"), 50).cast("bigint"))


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, CAST(floor(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*) + 0.5) AS INTEGER) AS pct, CAST(ceil(count(*) / 3.0) * 10 AS BIGINT) AS eta FROM orders GROUP BY 1""")
def progress_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return rows.withColumns({"pct": D.progress(F.col("done"), F.col("total")), "eta": D.minutes_left(F.col("total"), 3, 10)})


@query("SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_K).alias("k"))
