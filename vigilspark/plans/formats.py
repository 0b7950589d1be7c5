"""Payloads without a fixed schema, and XML in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import nested
from vigilspark.plans.catalog import query, table
from vigilspark.sources import feeds


@query("SELECT event_type, CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS INTEGER) % 10 AS bucket, count(*) AS n, sum(CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT)) AS total FROM events GROUP BY ALL")
def variant_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties as variants."""
    rows = table(spark, sf_dir, "events").select("event_type", nested.at(nested.payload(F.col("props")), "$.k", "int").alias("k"))
    return rows.groupBy("event_type", (F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("""SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'list' WHEN o_custkey % 7 = 1 THEN 'none' ELSE 'object' END AS format,
CASE WHEN o_custkey % 3 <> 0 AND o_custkey % 7 = 1 THEN NULL ELSE CAST(count(*) AS INTEGER) END AS n, CASE WHEN o_custkey % 3 <> 0 AND o_custkey % 7 = 1 THEN NULL ELSE sum(o_orderkey) END AS keys,
CASE WHEN o_custkey % 3 = 0 OR o_custkey % 7 = 1 THEN NULL ELSE CAST(count(DISTINCT o_orderstatus) AS INTEGER) END AS n_groups FROM orders GROUP BY o_custkey""")
def variant_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a stored report, of the old format for every third, damaged for some, and read back."""
    tx = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    made = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(tx).alias("transactions"), F.collect_set(F.struct("o_orderstatus")).alias("groups"))
    old, damaged = F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 7 == 1
    text = F.when(old, F.to_json("transactions")).when(damaged, F.lit('{"transactions": [')).otherwise(F.to_json(F.struct("transactions", "groups")))
    report = made.select("o_custkey", nested.payload(text).alias("v")).withColumn("r", nested.report_parts(F.col("v")))
    kind = F.when(F.col("v").isNull(), "none").when(F.schema_of_variant("v").startswith("ARRAY"), "list").otherwise("object")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    keys = F.aggregate("r.transactions", F.lit(0).cast("bigint"), lambda total, t: total + nested.at(t, "$.key", "bigint"))
    return report.select("o_custkey", kind.alias("format"), size("r.transactions").alias("n"), keys.alias("keys"), size("r.groups").alias("n_groups"))


@query("""SELECT s_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS chain, CASE WHEN l_linenumber % 2 = 0 THEN 'Addr' || l_orderkey || '-' || l_suppkey ELSE lower('0xAd' || l_orderkey || '-' || l_suppkey) END AS address,
CASE WHEN s_suppkey % 5 = 0 THEN 'Unknown OFAC Entity' ELSE s_name || ' & Co <' || s_suppkey || '>' END AS entity_name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_linenumber <= 2""")
def xml_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as parties of a sanctions document, one XML text each, with lines as their addresses; parsed back by column."""
    part = F.struct(F.array(F.struct(F.concat("s_name", F.lit(" & Co <"), "s_suppkey", F.lit(">")).alias("_VALUE"))).alias("NamePartValue"))
    alias = F.struct(F.array(F.struct(F.array(part).alias("DocumentedNamePart"))).alias("DocumentedName"))
    named = F.when(F.col("s_suppkey") % 5 != 0, F.array(alias))
    key = F.col("s_suppkey").cast("string")
    identity = F.array(F.struct(key.alias("_ID"), named.alias("Alias")))
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    even = F.col("l_linenumber") % 2 == 0
    address = F.concat(F.when(even, "Addr").otherwise("0xAd"), "l_orderkey", F.lit("-"), "l_suppkey")
    version = F.struct(F.array(F.struct(address.alias("_VALUE"))).alias("VersionDetail"))
    feature = F.struct(F.when(even, "344").otherwise("345").alias("_FeatureTypeID"), F.array(version).alias("FeatureVersion"), F.array(F.struct(F.col("l_suppkey").cast("string").alias("_IdentityID"))).alias("IdentityReference"))
    features = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_list(feature).alias("Feature"))
    parties = table(spark, sf_dir, "supplier").join(features, "s_suppkey").select(F.array(F.struct(key.alias("_ID"), identity.alias("Identity"), F.col("Feature"))).alias("Profile"))
    found = feeds.sanctioned_addresses(feeds.parse_parties(feeds.party_texts(parties)).select("Profile"))
    return found.select(F.regexp_extract("address", r"-(\d+)$", 1).cast("bigint").alias("s_suppkey"), "chain", "address", "entity_name")
