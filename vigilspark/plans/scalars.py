"""Scalar functions over whole tables: assets, chains, addresses, coin lists, flag reasons, formats, times, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import codecs, nested, numbers, text, times
from vigilspark.plans.catalog import dealt, query, table
from vigilspark.sources import feeds

#: Asset and address texts of all shapes, made from keys (Spark and DuckDB read the same expression).
_ASSET = """CASE o_orderkey % 14 WHEN 0 THEN 'rune' WHEN 1 THEN 'THOR.RUNE' WHEN 2 THEN 'x/ruji' WHEN 3 THEN 'BTC.BTC' WHEN 4 THEN 'ETH.USDC-0XA0B86991' WHEN 5 THEN 'ETH~USDT-0XDAC17F' WHEN 6 THEN 'eth-usdc-0xa0b8'
WHEN 7 THEN 'gaia-atom' WHEN 8 THEN 'AVAX/AVAX' WHEN 9 THEN '' WHEN 10 THEN 'thor1abcdefghijk' WHEN 11 THEN '0xabc' WHEN 12 THEN 'btc-btc' ELSE 'tok' || CAST(o_orderkey % 100 AS STRING) END"""
_CLEAN = r"""WITH a AS (SELECT o_orderkey, {asset} AS a FROM orders), b AS (SELECT *, regexp_extract(regexp_extract(regexp_extract(regexp_replace(a, '^[xX]/', ''), '([^/]*)$', 1), '([^~]*)$', 1), '([^.]*)$', 1) AS s FROM a),
p AS (SELECT *, string_split(s, '-') AS p FROM b)
SELECT o_orderkey, CASE WHEN a = '' THEN '' WHEN lower(a) IN ('rune', 'thor.rune') THEN 'RUNE'
 WHEN len(p) >= 3 THEN upper(CASE WHEN length(p[2]) <= 6 AND NOT regexp_matches(p[2], '^[0-9a-fA-F]+$') THEN p[2] ELSE p[1] END)
 WHEN len(p) = 2 THEN upper(CASE WHEN length(p[2]) > 6 OR regexp_matches(p[2], '^0[xX]') THEN p[1] WHEN upper(p[1]) IN ('ETH','BTC','AVAX','BSC','BASE','GAIA','TRON','DOGE','LTC','BCH','XRP','SOL','TERRA','BNB','THOR') AND upper(p[1]) <> upper(p[2]) THEN p[2] ELSE p[1] END)
 WHEN regexp_matches(upper(s), '^0X') OR (regexp_matches(upper(s), '^THOR1') AND length(s) > 10) OR regexp_matches(upper(s), '^[A-F0-9]{{21,}}$') THEN '' ELSE upper(s) END AS asset FROM p"""


@query(_CLEAN.format(asset=_ASSET))
def clean_asset_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.clean_asset(F.expr(_ASSET)).alias("asset"))


@query(f"""WITH a AS (SELECT o_orderkey, {_ASSET} AS a FROM orders), b AS (SELECT *, CASE WHEN contains(a, '~') THEN string_split(a, '~')[2] WHEN contains(a, '/') THEN string_split(a, '/')[2] WHEN contains(a, '.') THEN string_split(a, '.')[2] ELSE a END AS s FROM a),
p AS (SELECT *, string_split(s, '-') AS p FROM b)
SELECT o_orderkey, CASE WHEN len(p) >= 3 THEN p[2] WHEN len(p) = 2 AND length(p[2]) <= 6 AND p[1] <> p[2] THEN p[2] ELSE p[1] END AS asset FROM p""")
def clean_asset_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.short_asset(F.expr(_ASSET)).alias("asset"))


@query(f"""WITH a AS (SELECT o_orderkey, {_ASSET} AS a FROM orders) SELECT o_orderkey, coalesce(nullif(string_split(a, CASE WHEN contains(a, '.') THEN '.' WHEN contains(a, '~') THEN '~' WHEN contains(a, '/') THEN '/' ELSE '-' END)[1], ''), 'UNKNOWN') AS chain FROM a""")
def chain_from_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.chain_of_asset(F.expr(_ASSET)).alias("chain"))


_ADDRESS = """CASE o_orderkey % 13 WHEN 0 THEN 'thor1' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'cosmos1x' WHEN 2 THEN 'terra1x' WHEN 3 THEN 'bc1q' || CAST(o_orderkey AS STRING) WHEN 4 THEN '1' || repeat('A', 27) WHEN 5 THEN 'ltc1z' WHEN 6 THEN 'bnb1z'
WHEN 7 THEN '0x' || repeat('aB', 20) WHEN 8 THEN 'r' || repeat('x', 30) WHEN 9 THEN 'D' || repeat('y', 33) WHEN 10 THEN 'bitcoincash:q' WHEN 11 THEN 'T' || repeat('z', 33) ELSE '0x12' END"""


@query(f"""SELECT o_orderkey, [ 'THOR', 'GAIA', 'TERRA', 'BTC', 'BTC', 'LTC', 'BNB', 'ETH', 'XRP', 'DOGE', 'BCH', 'TRX', NULL][o_orderkey % 13 + 1] AS chain FROM orders""")
def chain_from_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.chain_of_address(F.expr(_ADDRESS)).alias("chain"))


@query(f"""WITH a AS (SELECT o_orderkey, {_ADDRESS} AS a, CASE WHEN o_orderkey % 13 = 7 THEN 'BASE' ELSE 'BTC' END AS c FROM orders)
SELECT o_orderkey, a AS screening, CASE WHEN c = 'BASE' THEN lower(a) ELSE a END AS manual, CASE WHEN starts_with(a, '0x') THEN lower(a) ELSE a END AS hex FROM a""")
def normalize_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    address, chain = F.expr(_ADDRESS), F.when(F.col("o_orderkey") % 13 == 7, "BASE").otherwise("BTC")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normalize_address(address, chain, text.LOWER_SCREENING).alias("screening"), text.normalize_address(address, chain, text.LOWER_MANUAL).alias("manual"), text.lower_hex(address).alias("hex"))


_PATTERNS = {"HEX": r"[0-9a-f]{32,64}", "QUAD": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"}


@query("SELECT DISTINCT chain, address FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS chain, unnest(regexp_extract_all(text, '{p}')) AS address FROM documents" for c, p in _PATTERNS.items()) + ")")
def regex_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(text.addresses_in(F.col("text"), _PATTERNS)).alias("a")).select("a.chain", "a.address").distinct()


@query("""SELECT address, min(chain) AS chain FROM (SELECT lower(unnest(regexp_extract_all(text, '[0-9a-f]{32,64}'))) AS address, 'ETH' AS chain FROM documents WHERE length(text) >= 100) GROUP BY 1""")
def text_feed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.text_addresses(table(spark, sf_dir, "documents"), "text", patterns={"ETH": _PATTERNS["HEX"]}).select("address", "chain")


@query("""WITH c AS (SELECT o_orderkey, unnest([CAST(o_orderkey + 10 AS VARCHAR) || 'abc', 'bad', CAST(o_custkey + 10 AS VARCHAR)]) AS p FROM orders)
SELECT o_orderkey, regexp_extract(p, '^(\\d+)(.+)$', 1) AS amount, regexp_extract(p, '^(\\d+)(.+)$', 2) AS asset FROM c WHERE regexp_matches(p, '^(\\d+)(.+)$')""")
def coin_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat((F.col("o_orderkey") + 10).cast("string"), F.lit("abc, bad,"), (F.col("o_custkey") + 10).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.coin_list(made, clean=False)).alias("c")).select("o_orderkey", "c.amount", "c.asset")


@query("""SELECT o_orderkey, CASE k WHEN 0 THEN 'OFAC' ELSE 'UNKNOWN' END AS source, CASE k WHEN 0 THEN 'A' || o_custkey ELSE '' END AS address, CASE k WHEN 0 THEN 'OFAC: name (A' || o_custkey || ')' ELSE 'no source' END AS text, 'a' || o_custkey AS flagged
FROM orders, (VALUES (0), (1)) v(k)""")
def flag_reason_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.concat(F.lit("OFAC: name (A"), F.col("o_custkey").cast("string"), F.lit("); no source ; "))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.flag_reasons(reason)).alias("r"), F.array_join(text.flagged_addresses(reason), ",").alias("flagged"))
    return rows.select("o_orderkey", "r.source", "r.address", "r.text", "flagged")


@query("""WITH v AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * o_orderkey * 7919 AS raw FROM orders), x AS (SELECT *, CAST(raw AS DECIMAL(38, 8)) / 100000000 AS d FROM (SELECT o_orderkey, raw FROM v))
SELECT o_orderkey, CAST(raw AS VARCHAR) AS raw, CASE WHEN raw = 0 THEN '0' WHEN raw % 100000000 = 0 THEN CAST(raw // 100000000 AS VARCHAR) ELSE rtrim(CAST(raw // 100000000 AS VARCHAR) || '.' || lpad(CAST(raw % 100000000 AS VARCHAR), 8, '0'), '0') END AS exact,
  CASE WHEN raw = 0 THEN '0' WHEN raw > 1000000000000 THEN CAST((raw + 5000000000) // 10000000000 // 10 AS VARCHAR) || '.' || CAST((raw + 5000000000) // 10000000000 % 10 AS VARCHAR) || 'k'
    WHEN raw > 100000000 THEN CAST((raw + 500000) // 1000000 // 100 AS VARCHAR) || '.' || lpad(CAST((raw + 500000) // 1000000 % 100 AS VARCHAR), 2, '0')
    WHEN raw > 100000 THEN '0.' || lpad(CAST((raw + 5000) // 10000 AS VARCHAR), 4, '0') WHEN raw > 100 THEN '0.' || lpad(CAST((raw + 50) // 100 AS VARCHAR), 6, '0') ELSE '0.' || lpad(CAST(raw AS VARCHAR), 8, '0') END AS shown FROM v""")
def format_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (F.col("o_orderkey").cast("decimal(38,0)") * F.col("o_orderkey") * 7919).cast("decimal(38,0)").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", numbers.raw_amount(F.col("raw")).alias("exact"), numbers.format_amount(F.col("raw")).alias("shown"))


@query("""WITH v AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 997 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1000000 THEN CAST((n + 50000) // 100000 // 10 AS VARCHAR) || '.' || CAST((n + 50000) // 100000 % 10 AS VARCHAR) || 'M' WHEN n >= 1000 THEN CAST((n + 50) // 100 // 10 AS VARCHAR) || '.' || CAST((n + 50) // 100 % 10 AS VARCHAR) || 'k' ELSE CAST(n AS VARCHAR) END AS short,
  CASE WHEN n = 0 THEN '-' WHEN n < 1000 THEN n || 'ms' ELSE CAST((n + 50) // 100 // 10 AS VARCHAR) || '.' || CAST((n + 50) // 100 % 10 AS VARCHAR) || 's' END AS took, format('{:,}', n) AS thousands FROM v""")
def format_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * 997
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.compact(n, separators=False).alias("short"), numbers.duration(n).alias("took"), numbers.thousands(n).alias("thousands"))


@query("""SELECT c_custkey, CASE WHEN length(c_name) > 16 THEN left(c_name, 8) || '...' || right(c_name, 6) ELSE c_name END AS middle, CASE WHEN length(c_name) > 10 THEN left(c_name, 10) || '...' ELSE c_name END AS head FROM customer""")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.middle_cut(F.col("c_name"), 8, 6, 16).alias("middle"), text.end_cut(F.col("c_name"), 10).alias("head"))


@query("""WITH s AS (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-02-01') - epoch(ts)) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age, CASE WHEN s < 5 THEN 'now' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' ELSE s // 3600 || 'h' END AS short FROM s""")
def time_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, ts = F.expr("TIMESTAMP '2024-02-01 00:00:00 UTC'"), F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", times.time_ago(ts, now).alias("age"), times.time_ago(ts, now, "short").alias("short"))


@query("SELECT event_id, strftime(make_timestamp(event_id * 86461001000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events WHERE event_id < 100000000")
def ns_to_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    nanos = (F.col("event_id").cast("decimal(20,0)") * 86461001000000).cast("string")
    return table(spark, sf_dir, "events").filter("event_id < 100000000").select("event_id", times.iso(times.from_nanos(nanos)).alias("iso"))


@query("SELECT c_custkey, c_name AS plain, c_name AS decoded FROM customer")
def base64_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", nested.maybe_base64(name).alias("plain"), nested.maybe_base64(F.base64(name.cast("binary"))).alias("decoded"))


@query("SELECT c_custkey, true AS ok FROM customer")
def bech32_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home-chain addresses survive the way to another prefix and back."""
    home = codecs.bech32_of_hex(F.substring(F.sha1(F.col("c_custkey").cast("string")), 1, 40))
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", home.alias("home"))
    return rows.select("c_custkey", (codecs.to_home_address(codecs.to_cosmos_address("home")) == F.col("home")).alias("ok"))


@query("SELECT s_suppkey, 34 AS size, 'T' AS head FROM supplier")
def base58_tron(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", codecs.to_tron_address(F.concat(F.lit("0x"), F.substring(F.sha1(F.col("s_suppkey").cast("string")), 1, 40))).alias("a"))
    return rows.select("s_suppkey", F.length("a").alias("size"), F.left("a", F.lit(1)).alias("head"))


@query("SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE contains(url, 'utm_')")
def html_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(F.col("url").contains("utm_")).select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT event_id, '0x' || lpad(printf('%x', user_id + 1), 40, '0') AS address FROM events")
def event_log_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("user_id") + 1)), 64, "0"))
    return table(spark, sf_dir, "events").select("event_id", nested.event_address(data).alias("address"))
