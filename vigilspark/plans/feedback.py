"""The live feed, discovery of users and links, oracle lookups, contract state, work queues, and display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import codecs, numbers, text, times
from vigilspark.operators import fixed_lists, history, jobs, portfolio, screening
from vigilspark.plans.catalog import dealt, query, table
from vigilspark.sources import exports
from vigilspark.streaming import live


def _hex(key: Column) -> Column:
    """Forty hexadecimal digits from a key."""
    return F.concat(F.md5(key.cast("string")), F.left(F.md5(key.cast("string")), F.lit(8)))


def _words_sql(key: str) -> str:
    """The 32 five-bit words of the forty digits."""
    bits = f"flatten([[ (('0x' || d)::INTEGER >> 3) & 1, (('0x' || d)::INTEGER >> 2) & 1, (('0x' || d)::INTEGER >> 1) & 1, ('0x' || d)::INTEGER & 1] for d in string_split(md5(CAST({key} AS VARCHAR)) || md5(CAST({key} AS VARCHAR))[1:8], '')])"
    return f"(SELECT [b[5 * j + 1] * 16 + b[5 * j + 2] * 8 + b[5 * j + 3] * 4 + b[5 * j + 4] * 2 + b[5 * j + 5] for j in range(32)] FROM (SELECT {bits} AS b))"


def _bech32_sql(prefix: str, words: str) -> str:
    """Address of the words: the checksum is the remainder of a polynomial division, one step for each word."""
    head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    step = "xor((s & 33554431) << 5, v)"
    for i, g in enumerate(codecs.GENERATOR):
        step = f"xor({step}, CASE WHEN (s >> {25 + i}) & 1 = 1 THEN CAST({g} AS BIGINT) ELSE 0 END)"
    check = f"xor(list_reduce(list_concat([CAST(1 AS BIGINT)], {head}, {words}, [0, 0, 0, 0, 0, 0]), lambda s, v: {step}), 1)"
    letters = f"array_to_string([('{codecs.BECH32}')[w + 1] for w in list_concat({words}, [({check} >> (5 * (5 - i))) & 31 for i in range(6)])], '')"
    return f"'{prefix}1' || {letters}"


@query(f"WITH w AS (SELECT c_custkey, {_words_sql('c_custkey')} AS w FROM customer) SELECT c_custkey, {_bech32_sql('thor', 'w')} AS home, {_bech32_sql('cosmos', 'w')} AS hub, {_bech32_sql('thor', 'w')} AS back FROM w")
def bech32_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the same key on two chains, and back."""
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", codecs.bech32_of_hex(_hex(F.col("c_custkey"))).alias("home"))
    rows = rows.withColumn("hub", codecs.to_cosmos_address("home"))
    return rows.withColumn("back", codecs.to_home_address("hub"))


def _base58_sql(hexes: str, rows: str) -> str:
    """Base58 of 25 bytes (in hexadecimal) by Horner's rule over limbs of ten digits, one step for each byte."""
    limb = 58**10
    parts = [f"h AS ({rows})", f"s0 AS (SELECT *, {', '.join(f'CAST(0 AS HUGEINT) AS l{j}' for j in range(4))} FROM h)"]
    for i in range(25):
        parts.append(f"t{i} AS (SELECT * REPLACE (l0 * 256 + ('0x' || {hexes}[{2 * i + 1}:{2 * i + 2}])::INTEGER AS l0, l1 * 256 AS l1, l2 * 256 AS l2, l3 * 256 AS l3) FROM s{i})")
        for j in range(3):
            parts.append(f"t{i}_{j} AS (SELECT * REPLACE (l{j} % {limb} AS l{j}, l{j + 1} + l{j} // {limb} AS l{j + 1}) FROM t{i}{f'_{j - 1}' if j else ''})")
        parts.append(f"s{i + 1} AS (SELECT * FROM t{i}_2)")
    digits = " || ".join(f"('{codecs.BASE58}')[CAST(l{j} // {58**k} % 58 AS INTEGER) + 1]" for j in range(3, -1, -1) for k in range(9, -1, -1))
    return "WITH " + ", ".join(parts) + f" SELECT s_suppkey, ltrim({digits}, '1') AS address FROM s25"


_PAYLOAD = "'41' || md5(CAST(s_suppkey AS VARCHAR)) || md5(CAST(s_suppkey AS VARCHAR))[1:8]"


@query(_base58_sql("x", f"SELECT s_suppkey, p || sha256(unhex(sha256(unhex(p))))[1:8] AS x FROM (SELECT s_suppkey, {_PAYLOAD} AS p FROM supplier)"))
def base58_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", codecs.to_tron_address(F.concat(F.lit("0x"), _hex(F.col("s_suppkey")))).alias("address"))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as actions: some without a sender, some dust."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    leg = lambda who, asset, amount: F.array(F.struct(who.alias("address"), F.concat(F.lit("t"), k.cast("string")).alias("txID"), F.array(F.struct(asset.alias("asset"), amount.cast("string").alias("amount"))).alias("coins")))
    sender = F.when(F.col("l_linenumber") == 5, F.lit("")).otherwise(F.concat(F.lit("thor1sender"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0")))
    receiver = F.when(F.col("l_linenumber") == 4, F.lit("")).otherwise(F.concat(F.lit("bc1"), F.col("l_partkey").cast("string")))
    asset_in = F.when(F.col("l_returnflag") == "A", "BTC.BTC").otherwise("THOR.RUNE")
    amount = F.when(F.col("l_linenumber") == 6, F.lit(999_999)).otherwise(F.col("l_quantity").cast("bigint") * F.col("l_orderkey") * 1_000_000)
    kind = F.when(F.col("l_returnflag") == "R", "addLiquidity").when(F.col("l_returnflag") == "A", "swap").otherwise("odd")
    streaming = F.struct(F.struct((F.col("l_linenumber") == 2).alias("isStreamingSwap")).alias("swap"))
    date = ((F.col("l_orderkey") + 1_600_000_000) * 1_000_000_000).cast("string")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(k.alias("k"), kind.alias("type"), date.alias("date"), leg(sender, asset_in, amount).alias("in"), leg(receiver, F.lit("ETH.USDC"), amount).alias("out"), streaming.alias("metadata"))


@query("""WITH l AS (SELECT *, 'thor1sender' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS s, CASE WHEN l_linenumber = 6 THEN 999999 ELSE CAST(l_quantity AS BIGINT) * l_orderkey * 1000000 END AS raw FROM lineitem WHERE l_linenumber <> 5),
r AS (SELECT *, CASE WHEN l_linenumber = 4 THEN s ELSE 'bc1' || l_partkey END AS t FROM l WHERE NOT (raw < 1000000 AND l_returnflag <> 'A'))
SELECT CASE l_returnflag WHEN 'R' THEN 'ADD' WHEN 'A' THEN CASE WHEN l_linenumber = 2 THEN 'STREAM' ELSE 'SWAP' END ELSE 'ODD' END AS type, left(s, 8) || '...' || right(s, 4) AS sender, CASE WHEN length(t) > 20 THEN left(t, 8) || '...' || right(t, 4) ELSE t END AS receiver,
  CASE WHEN l_returnflag = 'A' THEN 'BTC' ELSE 'RUNE' END AS asset_in, 'USDC' AS asset_out,
  CASE WHEN raw > 1000000000000 THEN CAST((raw + 50000000000) // 100000000000 AS VARCHAR) || 'k' WHEN raw > 100000000000 THEN CAST((raw + 5000000000) // 10000000000 // 10 AS VARCHAR) || '.' || CAST((raw + 5000000000) // 10000000000 % 10 AS VARCHAR) || 'k'
    WHEN raw > 100000000 THEN CAST((raw + 5000000) // 10000000 // 10 AS VARCHAR) || '.' || CAST((raw + 5000000) // 10000000 % 10 AS VARCHAR) WHEN raw > 1000000 THEN '0.' || lpad(CAST((raw + 50000) // 100000 AS VARCHAR), 3, '0') ELSE '' END AS amount, count(*) AS n
FROM r GROUP BY ALL""")
def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live feed's rows, counted alike ones together."""
    rows = history.live_actions(_feed(spark, sf_dir)).select("type", F.col("from").alias("sender"), F.col("to").alias("receiver"), F.col("assetIn").alias("asset_in"), F.col("assetOut").alias("asset_out"), "amount")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS account, CASE WHEN o_orderkey % 3 = 0 THEN '0xab' || o_orderkey ELSE 'x' || o_orderkey END AS l1_address, CASE o_orderkey % 3 WHEN 0 THEN 'ETH' WHEN 1 THEN 'DOGE' ELSE 'AVAX' END AS chain,
CASE o_orderkey % 3 WHEN 0 THEN 'ETH.ETH' WHEN 1 THEN 'DOGE.DOGE' ELSE 'AVAX~AVAX' END AS pool FROM orders WHERE o_orderkey % 5 <> 0""")
def pool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of liquidity providers: each customer's orders as pool positions, some without an address."""
    k = F.col("o_orderkey")
    address = F.when(k % 5 == 0, "").when(k % 3 == 0, F.concat(F.lit("0xAB"), k.cast("string"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    pool = F.when(k % 3 == 0, "ETH.ETH").when(k % 3 == 1, "DOGE.DOGE").otherwise("AVAX~AVAX")
    members = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("account")).agg(F.collect_list(F.struct(pool.alias("pool"), address.alias("assetAddress"))).alias("pools"))
    return screening.links_of_pools(members, "account")


_MEMBERS = f"""w AS (SELECT c_custkey AS k, {_words_sql("c_custkey")} AS w FROM customer), m AS (SELECT k, {_bech32_sql("thor", "w")} AS home, {_bech32_sql("cosmos", "w")} AS hub FROM w)"""


@query(f"""WITH {_MEMBERS}, shown AS (SELECT * FROM m WHERE k % 4 <> 3)
SELECT 'user' AS kind, home AS thor_address, '' AS l1_address, '' AS chain FROM shown WHERE k % 5 <> 0
UNION ALL SELECT 'edge', home, hub, 'GAIA' FROM m WHERE k % 5 = 0 OR k % 4 = 1""")
def member_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the home chain and of the hub, every fifth known before: new users and the edges of shared keys."""
    home = codecs.bech32_of_hex(_hex(F.col("c_custkey")))
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", home.alias("home")).withColumn("hub", codecs.to_cosmos_address("home"))
    members = rows.filter("c_custkey % 4 <> 3").select(F.when(F.col("c_custkey") % 4 == 1, F.col("hub")).otherwise(F.col("home")).alias("address"))
    users, edges = screening.member_sync(members, rows.filter("c_custkey % 5 = 0").select(F.col("home").alias("thor_address")))
    blank = F.lit("")
    return users.select(F.lit("user").alias("kind"), "thor_address", blank.alias("l1_address"), blank.alias("chain")).unionByName(edges.select(F.lit("edge").alias("kind"), "thor_address", "l1_address", "chain"))


@query("""SELECT o_custkey AS account, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'LIST' ELSE 'ORACLE' END AS source, CASE WHEN o_orderkey % 4 = 0 THEN 'listed' ELSE 'named' || o_orderkey END AS entity_name
FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 1 AND o_orderstatus = 'F'""")
def oracle_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges against listed entries and, where they have none, against an oracle that knows chains of one form of address."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    address = F.concat(F.lit("0xAb"), k.cast("string"))
    edges = orders.select(F.col("o_custkey").alias("account"), k.alias("k"), address.alias("l1_address"), F.when(F.col("o_orderstatus") == "F", "ETH").otherwise("BTC").alias("chain"))
    entries = orders.filter("o_orderkey % 4 = 0").select(k.alias("id"), address.alias("address"), F.when(F.col("o_orderstatus") == "F", "ETH").otherwise("BTC").alias("chain"), F.lit("LIST").alias("source"), F.lit("listed").alias("entity_name"), F.lit("r").alias("reason"))
    oracle = orders.filter("o_orderkey % 6 = 1").select(F.upper(address).alias("address"), F.concat(F.lit("named"), k.cast("string")).alias("entity_name"))
    return screening.screen_edges(edges, entries, oracle=oracle).select("account", "k", "source", "entity_name")


@query("""SELECT s_nationkey, arg_min(s_suppkey, s_suppkey) FILTER (s_suppkey % 3 = 0) AS total, coalesce(arg_min(s_acctbal, s_suppkey) FILTER (s_suppkey % 3 = 0), -1) AS rate FROM supplier GROUP BY s_nationkey HAVING count(*) FILTER (s_suppkey % 3 = 0) > 0""")
def contract_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers as base64 models of a contract's state, most of them damaged; the first that decodes counts."""
    good = F.to_json(F.struct(F.col("s_suppkey").alias("total"), F.col("s_acctbal").alias("rate")))
    value = F.when(F.col("s_suppkey") % 3 == 0, F.base64(good.cast("binary"))).when(F.col("s_suppkey") % 3 == 1, "no base64!").otherwise(F.base64(F.lit("no JSON").cast("binary")))
    models = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("pos"), value.alias("value"))
    return portfolio.contract_state(models, "total bigint, rate double", {"total": F.lit(0).cast("bigint"), "rate": F.lit(-1.0)}, "s_nationkey")


@query("""SELECT c_custkey, coalesce(o_orderkey, 0) AS k, CASE WHEN o_orderkey IS NULL THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS match_key, coalesce(o_orderstatus, '') AS match_status FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def screening_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each match of a screened user, and one with blanks where there is none."""
    matches = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("matches"))
    rows = exports.screening_rows(table(spark, sf_dir, "customer").select("c_custkey").join(matches, "c_custkey", "left"))
    return rows.select("c_custkey", F.coalesce(F.col("match_key").try_cast("bigint"), F.lit(0)).alias("k"), "match_key", "match_status")


@query(f"""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'the LAZARUS group of ' || user_id WHEN 1 THEN 'near Syria and Iran' WHEN 2 THEN 'Tornado cash' ELSE 'nobody' END AS name FROM events)
SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 39.0392 WHEN 1 THEN 35.6892 WHEN 2 THEN 52.3676 END AS DOUBLE) AS lat, CAST(CASE event_id % 4 WHEN 0 THEN 125.7625 WHEN 1 THEN 51.389 WHEN 2 THEN 4.9041 END AS DOUBLE) AS lng FROM e""")
def incident_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 4
    name = F.when(m == 0, F.concat(F.lit("the LAZARUS group of "), F.col("user_id").cast("string"))).when(m == 1, "near Syria and Iran").when(m == 2, "Tornado cash").otherwise("nobody")
    return table(spark, sf_dir, "events").select("event_id", text.incident_place(name).alias("p")).select("event_id", "p.lat", "p.lng")


@query("""WITH v AS (SELECT o_orderkey, o_orderkey * CAST(o_custkey AS HUGEINT) AS m FROM orders), x AS (SELECT *, CAST(m AS DOUBLE) / 1000000000 AS v, -CAST(floor(log10(nullif(CAST(m AS DOUBLE), 0) / 1000000000)) AS INTEGER) + 2 AS need FROM v)
SELECT o_orderkey, CASE WHEN m > 0 AND m < 10000000 THEN '0.' || lpad(CAST(CASE WHEN need >= 9 THEN m * CAST(pow(10, need - 9) AS HUGEINT) ELSE (m + CAST(pow(10, 9 - need) AS HUGEINT) // 2) // CAST(pow(10, 9 - need) AS HUGEINT) END AS VARCHAR), need, '0')
  ELSE CAST((m + 5000000) // 10000000 // 100 AS VARCHAR) || '.' || lpad(CAST((m + 5000000) // 10000000 % 100 AS VARCHAR), 2, '0') END AS shown FROM x""")
def significant_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (F.col("o_orderkey").cast("decimal(20,0)") * F.col("o_custkey")).cast("decimal(28,0)") / F.lit(1_000_000_000).cast("decimal(10,0)")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.significant(value).alias("shown"))


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 25""")
def recent_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest transactions of one kind, with a limit of the caller's choice."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("memo_type"))
    return jobs.recent_transactions(rows, 25, "purchase").select(F.col("id").alias("event_id"), F.col("memo_type").alias("event_type"))


@query("""SELECT count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_mktsegment LIKE 'M%') AS remaining, count(*) AS users FROM customer""")
def progress_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users left to be fetched after the progress of one prefix was forgotten."""
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(None).cast("timestamp").alias("fetched_at"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    marked = live.reset(live.mark_done(users, done, "c_custkey", "fetched_at", F.expr("TIMESTAMP '2024-01-01 00:00:00'")), "c_mktsegment", "fetched_at", "M")
    return live.remaining(marked, "fetched_at").join(marked.agg(F.count("*").alias("users")), F.lit(True))


@query("SELECT DISTINCT strftime(o_orderdate, '%b %-d, %Y') AS day FROM orders")
def display_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(times.long_day(F.col("o_orderdate")).alias("day")).distinct()
