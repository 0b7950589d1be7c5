"""Merges, deduplication, lookups, paging, set operations and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import numbers
from vigilspark.operators import relational as R
from vigilspark.plans.catalog import query, table

_LINE = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_DAY = "1999-01-01"


def _versions(spark: SparkSession, sf_dir: str, where: str, last: bool) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(where)
    order = [F.desc(c) if last else F.asc(c) for c in _LINE]
    return R.first_wins(rows, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.col("l_suppkey").alias("entity"))


def _version_sql(where: str, last: bool) -> str:
    order = ", ".join(f"{c} {'DESC' if last else 'ASC'}" for c in _LINE)
    return f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_suppkey AS entity FROM lineitem WHERE {where} QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1"


def entry_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries as they are listed, and as a later sync has them."""
    return _versions(spark, sf_dir, f"l_shipdate < TIMESTAMP '{_DAY}'", True), _versions(spark, sf_dir, f"l_shipdate >= TIMESTAMP '{_DAY}'", True)


@query(f"""WITH o AS ({_version_sql(f"l_shipdate < TIMESTAMP '{_DAY}'", True)}), n AS ({_version_sql(f"l_shipdate >= TIMESTAMP '{_DAY}'", True)})
SELECT coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey, coalesce(o.l_linenumber, n.l_linenumber) AS l_linenumber, coalesce(n.l_quantity, o.l_quantity) AS l_quantity,
  coalesce(o.l_returnflag, n.l_returnflag) AS l_returnflag, coalesce(n.entity, o.entity) AS entity
FROM o FULL JOIN n ON o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber""")
def upsert_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = entry_versions(spark, sf_dir)
    return R.upsert(old, new, ["l_orderkey", "l_linenumber"], ["l_quantity", "entity"])


@query("""WITH t AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
n AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT * FROM t UNION ALL SELECT * FROM n WHERE NOT EXISTS (FROM t WHERE t.o_custkey = n.o_custkey AND t.o_orderpriority = n.o_orderpriority)""")
def insert_ignore_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["o_custkey", "o_orderpriority"]
    orders = table(spark, sf_dir, "orders").select(*keys, "o_orderkey", "o_orderstatus")
    target = R.first_wins(orders.filter("o_orderstatus = 'F'").drop("o_orderstatus"), keys, ["o_orderkey"])
    return R.insert_ignore(target, orders.filter("o_orderstatus = 'O'").drop("o_orderstatus"), keys, ["o_orderkey"])


@query("SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus = 'P', (o_orderdate, o_orderkey)) AS affiliate FROM orders GROUP BY ALL")
def edge_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("affiliate", F.col("o_orderstatus") == "P")
    return R.last_value(orders, ["o_custkey", "o_orderpriority"], "affiliate", ["o_orderdate", "o_orderkey"])


@query("""SELECT s_suppkey, s_name, s_acctbal >= 0 AS active FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 1 AND l_returnflag = 'N' AND l_linenumber = 7)""")
def soft_delete_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "lineitem").filter("l_quantity = 1 AND l_returnflag = 'N' AND l_linenumber = 7").select(F.col("l_suppkey").alias("s_suppkey"))
    kept = R.delete_keys(table(spark, sf_dir, "supplier").withColumn("active", F.lit(True)), gone, ["s_suppkey"])
    return R.soft_delete(kept, F.col("s_acctbal") < 0).select("s_suppkey", "s_name", "active")


@query("""SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'M') THEN 'RESET' ELSE c_mktsegment END AS segment, coalesce(n, -1) AS n
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def update_by_prefix_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(-1).cast("bigint").alias("n"))
    users = R.update_where(users, F.col("segment").startswith("M"), {"segment": F.lit("RESET")})
    counted = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return R.update_by_key(users, counted, ["c_custkey"], ["n"])


@query("""SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS id, c_custkey FROM customer""")
def insert_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return R.with_new_ids(target, table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")]).select("id", "c_custkey")


@query(_version_sql("true", False))
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir, "true", False)


@query(f"SELECT l_orderkey, l_linenumber, arg_max(l_suppkey, ({', '.join(_LINE)})) AS entity FROM lineitem GROUP BY ALL")
def dict_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_value(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey", list(_LINE), "entity")


@query("SELECT event_id, event_type, CAST(value AS DOUBLE) AS value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.newest(table(spark, sf_dir, "events"), ["ts", "event_id"], 20).select("event_id", "event_type", "value")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY nullif(o_orderpriority, '5-LOW') DESC NULLS FIRST, o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("chain", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return R.page(orders, [F.desc_nulls_first("chain"), F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3""")
def filter_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {"least": 1000, "segments": ["BUILDING", "MACHINERY"], "nation": 3, "name": None}
    conditions = [F.col("c_acctbal") > asked["least"], F.col("c_mktsegment").isin(asked["segments"]), F.col("c_nationkey") == asked["nation"], None if asked["name"] is None else F.col("c_name") == asked["name"]]
    return R.where_all(table(spark, sf_dir, "customer"), conditions).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e_ %'")
def like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").like(R.search_filter("e_ "))).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 'red')")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").startswith("red")).select("p_partkey")


@query("SELECT nullif(c_mktsegment, 'BUILDING') IS NULL AS missing, count(*) AS n FROM customer GROUP BY 1")
def null_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rows.groupBy(F.col("segment").isNull().alias("missing")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def users_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.holders(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def users_on_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.holders(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT o_custkey AS uid FROM orders WHERE o_orderkey = 77")
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").filter(F.col("c_name") == "77").select(F.col("c_custkey").alias("uid"))
    return R.with_fallback(users, table(spark, sf_dir, "orders").filter("o_orderkey = 77").select(F.col("o_custkey").alias("uid")))


@query("""SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority || ':' || o_orderstatus, ',' ORDER BY o_orderpriority || ':' || o_orderstatus), '') AS links, count(DISTINCT (o_orderpriority, o_orderstatus)) FILTER (o_orderkey IS NOT NULL) AS n
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def users_with_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")
    rows = R.nested_left(table(spark, sf_dir, "customer").select("c_custkey"), edges, "c_custkey", ["o_orderpriority", "o_orderstatus"], "e")
    return rows.select("c_custkey", F.array_join(F.transform("e", lambda x: F.concat(x["o_orderpriority"], F.lit(":"), x["o_orderstatus"])), ",").alias("links"), F.size("e").cast("bigint").alias("n"))


@query("SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")
def set_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bag_union(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))).distinct()


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT s_suppkey FROM supplier")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unseen(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), ["k"]).distinct()


@query("""SELECT src, count(*) AS n FROM (SELECT 'c' AS src FROM customer UNION ALL SELECT 's' FROM supplier UNION ALL SELECT 'n' FROM nation) GROUP BY 1""")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = [table(spark, sf_dir, t).select(F.lit(s).alias("src")) for t, s in (("customer", "c"), ("supplier", "s"), ("nation", "n"))]
    return R.bag_union(*feeds).groupBy("src").agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, p.value AS before, CASE WHEN p.value > 0 THEN round((e.value - p.value) / p.value * 100, 6) END AS pct
FROM events e ASOF LEFT JOIN events p ON e.user_id = p.user_id AND e.ts - INTERVAL 24 HOURS >= p.ts""")
def asof_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select("event_id", "user_id", "value", (F.col("ts") - F.expr("INTERVAL 24 HOURS")).alias("at"))
    got = R.as_of(rows, events.select("user_id", "ts", "value"), ["user_id"], "at", "ts", ["value"])
    return got.select("event_id", F.col("asof_value").alias("before"), F.round(numbers.percent_change(F.col("value"), F.col("asof_value")), 6).alias("pct"))
