"""Screening queries: customers stand for users, orders for their addresses, line items for listed entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.operators import relational as R
from vigilspark.operators import screening as S
from vigilspark.plans.catalog import query, table
from vigilspark.sources import exports

_ID = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
_LISTED = "l_returnflag = 'R' AND l_quantity >= 45"


def _entries(spark: SparkSession, sf_dir: str, where: str = _LISTED) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(where)
    return rows.select(F.struct(*_ID).alias("id"), F.col("l_orderkey").cast("string").alias("address"), F.lit("ETH").alias("chain"), F.col("l_returnflag").alias("source"), F.concat(F.lit("supplier "), "l_suppkey").alias("entity_name"), F.lit("listed").alias("reason"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").cast("string").alias("l1_address"), F.lit("ETH").alias("chain"), F.col("o_orderkey").alias("seq"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = S.screen_edges(_edges(spark, sf_dir), _entries(spark, sf_dir))
    return S.reasons(matches, "user", F.concat("source", F.lit(": "), "entity_name", F.lit(" ("), "l1_address", F.lit(")")), ["seq"])


_HITS = f"""e AS (
  SELECT l_orderkey, l_returnflag, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(f"{c} DESC" for c in _ID)}) AS n FROM lineitem WHERE {_LISTED}
), f AS (
  SELECT o_custkey AS "user", count(*) AS matches, string_agg(l_returnflag || ': supplier ' || l_suppkey || ' (' || o_orderkey || ')', '; ' ORDER BY o_orderkey) AS reason
  FROM orders JOIN e ON l_orderkey = o_orderkey AND n = 1 GROUP BY o_custkey
)"""


@query(f"WITH {_HITS} SELECT * FROM f")
def screen_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042')")
def screen_address_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_name").alias("address"))
    return S.screen_address(users, "CUSTOMER#000000042").drop("address")


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS address, 'supplier ' || l_suppkey AS entity_name, l_linenumber FROM lineitem
WHERE {_LISTED} AND (l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) OR l_orderkey = 7)""")
def screen_address_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).select(F.col("user").cast("string").alias("thor_address"), "l1_address")
    return S.screen_address_with_links(_entries(spark, sf_dir), edges, "7").select("address", "entity_name", F.col("id.l_linenumber").alias("l_linenumber"))


@query("""WITH f AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
SELECT c_custkey, o_orderkey, l_suppkey, l_linenumber FROM f LEFT JOIN (
  SELECT o_custkey, o_orderkey, l_suppkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45) h ON o_custkey = c_custkey""")
def screening_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey")
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    entries = table(spark, sf_dir, "lineitem").filter(_LISTED).select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber")
    return S.detail(flagged, edges, entries, "c_custkey", "o_orderkey")


@query("""SELECT c_custkey, '"' || c_name || '","' || c_mktsegment || '","' || coalesce(string_agg(o_orderpriority || ':' || o_orderkey, '|' ORDER BY o_orderpriority, o_orderkey), '') || '",""' AS line
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY c_custkey, c_name, c_mktsegment""")
def flagged_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey", F.col("c_name").alias("thor_address"), F.col("c_mktsegment").alias("flag_reason"), F.lit(None).cast("timestamp").alias("screened_at"))
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("chain"), F.col("o_orderkey").alias("l1_address"))
    nested = R.nested_left(users, links, "c_custkey", ["chain", "l1_address"], "links")
    return exports.flagged_lines(nested.withColumn("links", F.transform("links", lambda x: F.struct(x["chain"], x["l1_address"].cast("string").alias("l1_address")))), "c_custkey")


@query(f"WITH {_HITS} SELECT c_custkey, c_name, reason AS flag_reason, reason IS NOT NULL AS flagged FROM customer LEFT JOIN f ON f.\"user\" = c_custkey")
def screen_flags_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return S.refresh_flags(users, _flags(spark, sf_dir).withColumnRenamed("user", "c_custkey"), "c_custkey")


@query("""SELECT o_custkey AS uid FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1)
UNION SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1)""")
def manual_flag_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "lineitem").filter("l_quantity = 50 AND l_linenumber = 1").select(F.col("l_orderkey").alias("address"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("address"))
    return S.propagate_flag(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid")), edges, flags, "uid", "address")


@query("""SELECT count(*) AS total, count(*) FILTER (c_acctbal < 0) AS flagged, count(*) FILTER (NOT c_acctbal < 0) AS clean FROM customer""")
def flag_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flag_rate(table(spark, sf_dir, "customer").withColumn("flagged", F.col("c_acctbal") < 0))


@query("""WITH legs AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'thor' || (conv_id % 7) ELSE '0x' || substr(md5(CAST(conv_id * 31 + turn AS VARCHAR)), 1, 32) || substr(md5(CAST(turn AS VARCHAR)), 1, 8) END AS address, turn % 2 = 0 AS sent FROM conversations
), a AS (
  SELECT conv_id, list(address ORDER BY turn) FILTER (sent) AS ins, list(address ORDER BY turn) FILTER (NOT sent) AS outs, 'thor' || (conv_id % 7) AS me FROM legs GROUP BY conv_id
), r AS (
  SELECT conv_id, me, len([x for x in coalesce(outs, []) if x <> me and starts_with(x, 'thor')]) > 0 AS shared, list_contains(coalesce(ins, []), me) AS sends, list_contains(coalesce(outs, []), me) AS gets, coalesce(ins, []) AS ins, coalesce(outs, []) AS outs FROM a
), l AS (
  SELECT conv_id, me, NOT sends AND shared AS affiliate, unnest(CASE WHEN sends OR (gets AND shared) THEN ins || outs WHEN gets THEN ins ELSE [] END) AS address FROM r
), k AS (SELECT *, row_number() OVER (PARTITION BY me, address ORDER BY conv_id DESC) AS n FROM l WHERE NOT starts_with(address, 'thor'))
SELECT me AS uid, address AS l1_address, 'ETH' AS chain, affiliate FROM k WHERE n = 1""")
def link_rule_affiliate(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.concat(F.lit("0x"), F.substring(F.md5((F.col("conv_id") * 31 + F.col("turn")).cast("string")), 1, 32), F.substring(F.md5(F.col("turn").cast("string")), 1, 8))
    legs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.concat(F.lit("thor"), (F.col("conv_id") % 7).cast("string"))).otherwise(digest).alias("address"))
    leg = F.struct("turn", "address", F.array().cast("array<struct<asset:string,amount:string>>").alias("coins"))
    sides = legs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == 0, leg))).alias("in"), F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == 1, leg))).alias("out"))
    actions = sides.select(F.col("conv_id").alias("seq"), F.concat(F.lit("thor"), (F.col("conv_id") % 7).cast("string")).alias("uid"), "in", "out")
    return S.links_of_actions(actions, "uid").select("uid", "l1_address", "chain", "affiliate")
