"""History queries: conversations stand for transactions, their turns for actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import text
from vigilspark.operators import dims, fixed_lists
from vigilspark.operators import history as H
from vigilspark.plans.catalog import dealt, query, table
from vigilspark.sources import exports

#: Roles and turns as transaction types.
_KIND = """CASE WHEN role = 'system' THEN 'swap' WHEN role = 'user' AND turn % 4 = 0 THEN 'send' WHEN role = 'user' THEN 'fin-trade' WHEN turn % 3 = 0 THEN 'bow-swap' ELSE 'fin-order' END"""
_PRIORITY = "CASE kind WHEN 'swap' THEN 1 WHEN 'fin-order' THEN 23 WHEN 'bow-swap' THEN 31 WHEN 'fin-trade' THEN 32 ELSE 50 END"
_ASSET = "CASE WHEN length(text) % 3 = 0 THEN '' ELSE 'A' || CAST(length(text) % 5 AS STRING) END"
_BASE = f"SELECT conv_id, turn, {_KIND} AS kind, {_ASSET} AS asset FROM conversations"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_KIND).alias("kind"), F.expr(_ASSET).alias("asset"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.lit("")
    amount = F.when(F.col("asset") == "", "0").otherwise((F.col("turn") + 1).cast("string"))
    cells = {"date": blank, "assetIn": F.lit("RUNE"), "amountIn": F.lit("1"), "assetOut": F.col("asset"), "amountOut": amount, "rawAmountIn": F.lit("1"), "rawAmountOut": amount, "from": blank, "to": blank, "fromLabel": blank, "toLabel": blank}
    more = {"status": F.lit("success"), "feeAmount": blank, "feeCurrency": blank, "contractName": blank, "contractCategory": blank}
    return _rows(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("kind").alias("type"), *[v.alias(k) for k, v in cells.items()], F.concat(F.lit("tx"), F.col("conv_id").cast("string")).alias("txID"), *[v.alias(k) for k, v in more.items()])


@query(f"""WITH b AS ({_BASE}), p AS (SELECT *, {_PRIORITY} AS prio FROM b),
l AS (SELECT *, prio < coalesce(min(prio) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9999) AS led FROM p),
n AS (SELECT *, min(CASE WHEN led THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM l)
SELECT conv_id, turn, CAST(prio AS INTEGER) AS priority, led AND nxt IS NULL AS is_primary, CASE WHEN led THEN nxt ELSE turn END AS sub_order FROM n""")
def txn_group_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = H.with_priority(_rows(spark, sf_dir).withColumnRenamed("kind", "type"), None)
    return H.group_order(keyed, "conv_id", "turn", "priority").select("conv_id", "turn", "priority", "is_primary", "sub_order")


@query(f"""WITH b AS ({_BASE}), p AS (SELECT *, {_PRIORITY} AS prio FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY prio, turn) AS rk FROM p)
SELECT 'tx' || conv_id AS txID, any_value(kind) FILTER (rk = 1) AS primary_type,
  CAST(least(5, count(*) FILTER (rk > 1 AND kind <> 'fin-trade')) AS INTEGER) AS visible,
  CAST(count(*) FILTER (rk > 1 AND kind = 'fin-trade') + greatest(0, count(*) FILTER (rk > 1 AND kind <> 'fin-trade') - 5) AS INTEGER) AS internal
FROM f GROUP BY conv_id HAVING count(*) FILTER (rk = 1 AND kind = 'bow-swap' OR rk > 1 AND kind = 'bow-swap') > 0""")
def txn_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = H.groups_of_types(H.grouped(_history(spark, sf_dir)), ["bow-swap"])
    return groups.select("txID", F.col("primary.type").alias("primary_type"), F.size("subActions").alias("visible"), F.col("internalCount").alias("internal"))


@query(f"""WITH b AS ({_BASE}), s AS (SELECT conv_id, arg_min(asset, turn) AS a FROM b WHERE kind = 'bow-swap' AND asset <> '' GROUP BY 1)
SELECT conv_id, turn, CASE WHEN kind = 'fin-trade' AND asset = '' THEN coalesce(a, asset) ELSE asset END AS asset FROM b LEFT JOIN s USING (conv_id)""")
def sibling_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fill_siblings(_rows(spark, sf_dir), "conv_id", "turn", "kind", "asset").select("conv_id", "turn", "asset")


_CATEGORY = {"click": "browse", "view": "browse", "purchase": "trade", "signup": "account"}


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'browse' WHEN event_type = 'purchase' THEN 'trade' ELSE 'account' END AS category, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.category_counts(table(spark, sf_dir, "events"), "event_type", _CATEGORY)


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def subtype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.subtype_counts(table(spark, sf_dir, "events"), "browse", "event_type", _CATEGORY)


@query(f"""WITH b AS ({_BASE}) SELECT conv_id, turn, CASE WHEN asset = '' THEN '' ELSE CAST(turn + 1 AS VARCHAR) END AS received, asset,
  CASE kind WHEN 'swap' THEN 'Swap RUNE → ' || asset WHEN 'send' THEN 'Send RUNE' ELSE kind END AS description, '' AS label FROM b""")
def tax_label_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir)
    made = H.tax_rows(rows.withColumn("txID", F.col("seq").cast("string")))
    seq = F.col("TxHash").cast("bigint")
    return made.select(F.floor(seq / 1000).alias("conv_id"), (seq % 1000).alias("turn"), F.col("Received Amount").alias("received"), F.col("Received Currency").alias("asset"), F.col("Description").alias("description"), F.col("Label").alias("label"))


@query(f"""WITH b AS ({_BASE}) SELECT '"","' || kind || '","1","RUNE","' || CASE WHEN asset = '' THEN '0' ELSE CAST(turn + 1 AS VARCHAR) END || '","' || asset || '","","","success","","","","tx' || conv_id || '"' AS line FROM b""")
def history_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.csv_lines(exports.history_rows(_history(spark, sf_dir)))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return H.in_dates(rows, "day", F.lit("1997-01-01"), F.lit("1997-06-30")).select("o_orderkey", "day")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as actions of every decode class, built from their keys."""
    k = F.col("o_orderkey")
    kinds = ["wasm-rujira-fin/order.create", "wasm-rujira-fin/trade", "wasm-rujira-bow/swap", "wasm-rujira-ghost-vault/borrow", "wasm-rujira-ghost-vault/repay", "wasm-rujira-staking/account.claim", "wasm-rujira-fin/range.create", "wasm-other/thing"]
    coins = lambda a, n: F.array(F.struct(F.lit(a).alias("asset"), n.cast("string").alias("amount")))
    leg = lambda who, a, n: F.array(F.struct(who.alias("address"), F.concat(F.lit("tx"), k.cast("string")).alias("txID"), coins(a, n).alias("coins")))
    contract = F.struct(F.get(F.array(*[F.lit(x) for x in kinds]), (k % 8).cast("int")).alias("contractType"), F.concat((k * 1000 + 1).cast("string"), F.lit("rune,"), (k + 5).cast("string"), F.lit("btc-btc")).alias("funds"), F.create_map(F.lit("bid"), (k + 7).cast("string"), F.lit("returned"), F.concat((k + 9).cast("string"), F.lit("eth-eth")), F.lit("amount"), (k + 11).cast("string")).alias("attributes"))
    fees = F.when(k % 5 == 0, F.array(F.struct(F.lit("THOR.RUNE").alias("asset"), F.lit("2000000").alias("amount"))))
    swap = F.when(k % 2 == 0, F.struct(fees.alias("networkFees"), F.lit("123").alias("liquidityFee"), F.lit(False).alias("isStreamingSwap")))
    other = F.lit(None).cast("struct<networkFees:array<struct<asset:string,amount:string>>,liquidityFee:string>")
    meta = F.struct(F.when(k % 3 == 0, contract).alias("contract"), swap.alias("swap"), other.alias("addLiquidity"), other.alias("withdraw"))
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(k.alias("seq"), ((k + 1_600_000_000) * 1_000_000_000).cast("string").alias("date"), F.when(k % 3 == 0, "contract").otherwise("swap").alias("type"), F.lit("success").alias("status"), leg(F.concat(F.lit("thor"), F.col("o_custkey").cast("string")), "THOR.RUNE", k * 100).alias("in"), leg(F.lit("bc1pool"), "BTC.BTC", k * 10).alias("out"), meta.alias("metadata"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_custkey FROM orders), x AS (SELECT *, k % 3 = 0 AS c, k % 8 AS m FROM b)
SELECT k AS seq, CASE WHEN NOT c THEN 'swap' ELSE ['fin-order', 'fin-trade', 'bow-swap', 'ghost-borrow', 'ghost-repay', 'ruji-claim', 'fin-range', 'contract'][m + 1] END AS type,
  CASE WHEN NOT c THEN 'RUNE' WHEN m IN (3, 5) THEN '' ELSE 'RUNE' END AS assetIn,
  CASE WHEN NOT c THEN 'BTC' WHEN m = 2 THEN 'ETH' WHEN m = 3 THEN 'RUNE' WHEN m = 5 THEN 'RUJI' WHEN m = 6 THEN 'BTC' ELSE '' END AS assetOut,
  'thor' || o_custkey AS sender, 'tx' || k AS txID,
  CASE WHEN k % 2 = 1 THEN '' WHEN k % 5 = 0 THEN '0.02' ELSE '0.00000123' END AS feeAmount, CASE WHEN k % 2 = 1 THEN '' ELSE 'RUNE' END AS feeCurrency,
  CAST(CASE WHEN NOT c THEN k * 10 WHEN m = 1 THEN k + 7 WHEN m = 2 THEN k + 9 WHEN m = 3 THEN k + 11 WHEN m = 5 THEN k + 9 WHEN m = 6 THEN k + 5 ELSE 0 END AS BIGINT) AS raw_out
FROM x""")
def history_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, decoded; a claim's amount is that of the attribute `returned`, else of the first funds."""
    return _decoded(spark, sf_dir)


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = spark.createDataFrame([("thor-none", "none", "none", "", "")], "address string, category string, product string, name string, role string")
    rows = H.parse_actions(_actions(spark, sf_dir), contracts)
    raw = (F.col("rawAmountOut").cast("decimal(30,8)") * 100_000_000).cast("bigint")
    return rows.select("seq", "type", "assetIn", "assetOut", F.col("from").alias("sender"), "txID", "feeAmount", "feeCurrency", raw.alias("raw_out"))


# Classes of contract events, by what the query's SQL makes of them.
_CLASSES = (
    [("trade", ("fin-trade",)), ("ask", H.SWAP_ASK), ("returned", H.SWAP_RETURNED), ("in", H.IN_FUND), ("out_amount", H.OUT_AMOUNT), ("out", H.OUT_FUND), ("in_amount", H.IN_AMOUNT)]
    + [("two", H.TWO_FUNDS), ("fee", H.FEE_ONLY), ("nothing", H.NOTHING), ("stake", ("ruji-stake",)), ("claim", ("ruji-unstake", "ruji-claim")), ("mint", ("brune-mint",)), ("burn", ("brune-burn",))]
)
_EVENTS = [*dims.CONTRACT_TYPES, "wasm-other/thing"]
_USER = "thor1"


def _class_of(kind: str) -> str:
    return next((name for name, kinds in _CLASSES if kind in kinds), "plain")


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def contract_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as actions of all contract events, with known contracts among senders, recipients and later legs."""
    k = F.col("o_orderkey")
    pick = lambda xs, at: F.get(F.array(*[F.lit(x) for x in xs]), at.cast("int"))
    known = [c[0] for c in fixed_lists.CONTRACTS]
    user = F.concat(F.lit("thor"), F.col("o_custkey").cast("string"))
    sender = F.when(k % 7 == 0, pick(known, k % len(known))).otherwise(user)
    receiver = F.when(k % 11 == 0, pick(known, F.floor(k / 11) % len(known))).when(k % 17 == 0, F.lit(_USER)).otherwise(F.lit("bc1pool"))
    third = F.when(k % 13 == 0, pick(known, k * 3 % len(known))).otherwise(F.lit("bc1other"))
    coins = F.array(F.struct(F.lit("BTC.BTC").alias("asset"), k.cast("string").alias("amount")))
    leg = lambda who: F.struct(who.alias("address"), F.concat(F.lit("tx"), F.col("o_custkey").cast("string")).alias("txID"), coins.alias("coins"))
    coin = lambda add, denom: F.concat((k + add).cast("string"), F.lit(denom))
    attributes = {
        "bid": F.when(k % 4 == 1, coin(7, "")).when(k % 4 > 1, coin(7, "btc-btc")),
        "offer": F.when(k % 4 == 0, coin(8, "doge-doge")),
        "ask": coin(13, "gaia-atom"),
        "returned": F.when(k % 3 != 1, coin(9, "eth-eth")),
        "amount": F.when(k % 5 != 0, coin(11, "")),
        "quote": F.when(k % 3 == 0, "0").otherwise(coin(17, "")),
        "base": coin(19, ""),
    }
    held = F.map_filter(F.create_map(*[x for name, value in attributes.items() for x in (F.lit(name), value)]), lambda _, v: v.isNotNull())
    contract = F.struct(pick(_EVENTS, k % len(_EVENTS)).alias("contractType"), F.concat((k * 1000 + 1).cast("string"), F.lit("rune,"), coin(5, "btc-btc")).alias("funds"), held.alias("attributes"))
    other = F.lit(None).cast("struct<networkFees:array<struct<asset:string,amount:string>>,liquidityFee:string>")
    swap = F.lit(None).cast("struct<networkFees:array<struct<asset:string,amount:string>>,liquidityFee:string,isStreamingSwap:boolean>")
    meta = F.struct(contract.alias("contract"), swap.alias("swap"), other.alias("addLiquidity"), other.alias("withdraw"))
    date = ((k + 1_600_000_000) * 1_000_000_000).cast("string")
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(k.alias("seq"), date.alias("date"), F.lit("contract").alias("type"), F.lit("success").alias("status"), F.array(leg(sender)).alias("in"), F.array(leg(receiver), leg(third)).alias("out"), meta.alias("metadata"), user.alias("user"))


def _other_side_sql(asset: str, name: str) -> str:
    pair = f"regexp_replace({name}, '{text.PAIR_PREFIXES}', '')"
    side = lambda n: f"CASE WHEN contains({pair}, '/') THEN regexp_extract({pair}, '^(.+)/([^/]*)$', {n}) ELSE regexp_extract({pair}, '^(.+)-([^-]*)$', {n}) END"
    ticker = lambda x: f"upper(regexp_replace({x}, '^([^.]+)\\..*$', '\\1'))"
    named = f"regexp_matches({name}, '{text.PAIR_PREFIXES}') AND regexp_matches({pair}, '^.+[-/]')"
    return f"CASE WHEN {named} AND upper({asset}) = {ticker(side(1))} THEN {ticker(side(2))} WHEN {named} AND upper({asset}) = {ticker(side(2))} THEN {ticker(side(1))} ELSE '' END"


_N = len(fixed_lists.CONTRACTS)
_KINDS = [(i, kind := dims.CONTRACT_TYPES.get(e, "contract"), "unknown" if e not in dims.CONTRACT_TYPES else _class_of(kind), dims.PRIORITIES.get(kind, dims.OTHER_PRIORITY), dims.CATEGORIES.get(kind, ""), dims.TAX_LABELS.get(kind, ""), int(kind in dims.INTERNAL_TYPES)) for i, e in enumerate(_EVENTS)]
#: The history rows of `contract_actions`, decoded by event class.
_DECODED = f"""c AS (SELECT * FROM (VALUES {_values([(i, *r[:2], r[3]) for i, r in enumerate(fixed_lists.CONTRACTS)])}) v(i, address, category, name)),
kinds AS (SELECT * FROM (VALUES {_values(_KINDS)}) v(i, type, cls, prio, group_name, label, internal)),
o AS (SELECT o_orderkey AS k, o_custkey, 'thor' || o_custkey AS account, o_orderkey % 7 = 0 AS s_known, o_orderkey % 11 = 0 AS r_known, o_orderkey % 13 = 0 AS t_known FROM orders),
w AS (SELECT o.*, kinds.* EXCLUDE (i), f.name AS f_name, f.category AS f_category, t.name AS t_name, t.category AS t_category, coalesce(f.name, t.name, x.name) AS any_name, coalesce(f.category, t.category, x.category) AS any_category,
  coalesce(f.address, account) AS sender, coalesce(t.address, CASE WHEN k % 17 = 0 THEN '{_USER}' ELSE 'bc1pool' END) AS receiver, CASE WHEN k % 5 <> 0 THEN k + 11 ELSE k * 1000 + 1 END AS amount
  FROM o JOIN kinds ON kinds.i = k % {len(_EVENTS)} LEFT JOIN c f ON s_known AND f.i = k % {_N} LEFT JOIN c t ON r_known AND t.i = k // 11 % {_N} LEFT JOIN c x ON t_known AND x.i = k * 3 % {_N}),
d AS (SELECT *, CASE WHEN cls IN ('out_amount', 'out', 'fee', 'nothing', 'claim') THEN '' WHEN cls = 'burn' THEN 'BRUNE' ELSE 'RUNE' END AS asset_in,
  CASE WHEN cls IN ('out_amount', 'out', 'fee', 'nothing', 'claim') THEN 0 WHEN cls = 'in_amount' THEN amount ELSE k * 1000 + 1 END AS raw_in,
  CASE WHEN cls = 'trade' THEN CASE WHEN k % 4 = 0 THEN 'DOGE' WHEN k % 4 = 1 THEN '' ELSE 'BTC' END WHEN cls = 'ask' THEN CASE WHEN k % 3 <> 1 THEN 'ETH' ELSE 'ATOM' END WHEN cls = 'returned' THEN CASE WHEN k % 3 <> 1 THEN 'ETH' ELSE '' END
    WHEN cls IN ('out_amount', 'out') THEN 'RUNE' WHEN cls = 'two' THEN 'BTC' WHEN cls = 'claim' THEN 'RUJI' WHEN cls = 'mint' THEN 'BRUNE' ELSE '' END AS a_out,
  CASE WHEN cls = 'trade' THEN CASE WHEN k % 4 = 0 THEN k + 8 ELSE k + 7 END WHEN cls = 'ask' THEN CASE WHEN k % 3 <> 1 THEN k + 9 ELSE k + 13 END WHEN cls = 'returned' THEN CASE WHEN k % 3 <> 1 THEN k + 9 ELSE 0 END
    WHEN cls IN ('out_amount', 'mint') THEN amount WHEN cls = 'out' THEN k * 1000 + 1 WHEN cls = 'two' THEN k + 5 WHEN cls = 'claim' THEN CASE WHEN k % 3 <> 1 THEN k + 9 ELSE k * 1000 + 1 END
    WHEN cls = 'fee' THEN CASE WHEN k % 3 <> 0 THEN k + 17 ELSE k + 19 END ELSE 0 END AS raw_out FROM w),
p AS (SELECT *, a_out = '' AND asset_in <> '' AS open_ FROM d),
h AS (SELECT k AS seq, type, asset_in, raw_in, CASE WHEN open_ AND any_name IS NOT NULL THEN {_other_side_sql("asset_in", "any_name")} ELSE a_out END AS asset_out, raw_out, sender, receiver, account, 'tx' || o_custkey AS tx, internal, group_name, label,
  coalesce(f_name, '') AS from_label, coalesce(t_name, '') AS to_label, coalesce(nullif(f_name, ''), nullif(t_name, ''), CASE WHEN open_ THEN any_name END, '') AS contract_name, coalesce(nullif(f_category, ''), nullif(t_category, ''), CASE WHEN open_ THEN any_category END, '') AS contract_category,
  f_name IS NOT NULL AS f_known, t_name IS NOT NULL AS to_known, prio FROM p)"""


def _tier(user: str) -> str:
    return f"prio + CASE WHEN f_known AND to_known AND sender <> {user} AND receiver <> {user} THEN 300 WHEN sender = {user} THEN 0 WHEN receiver = {user} THEN 100 ELSE 200 END"


def _raw(column: str) -> F.Column:
    return (F.col(column).cast("decimal(30,8)") * 100_000_000).cast("bigint")


@query(f"""WITH {_DECODED} SELECT seq, type, asset_in, CAST(raw_in AS BIGINT) AS raw_in, asset_out, CAST(raw_out AS BIGINT) AS raw_out, sender, receiver, from_label, to_label, contract_name, contract_category, CAST({_tier(f"'{_USER}'")} AS INTEGER) AS priority, group_name AS category, label FROM h""")
def history_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of all contract events with the known contracts, from the view of one user: decoded, named, with priority, category and tax label."""
    known = fixed_lists.contracts(spark)
    rows = H.with_priority(H.parse_actions(contract_actions(spark, sf_dir), known), F.lit(_USER), known)
    category = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.CATEGORIES.items() for x in kv]), F.col("type")), F.lit(""))
    return rows.select("seq", "type", F.col("assetIn").alias("asset_in"), _raw("rawAmountIn").alias("raw_in"), F.col("assetOut").alias("asset_out"), _raw("rawAmountOut").alias("raw_out"), F.col("from").alias("sender"), F.col("to").alias("receiver"), F.col("fromLabel").alias("from_label"), F.col("toLabel").alias("to_label"), F.col("contractName").alias("contract_name"), F.col("contractCategory").alias("contract_category"), "priority", category.alias("category"), H.tax_label(F.col("type")).alias("label"))


@query(f"""WITH {_DECODED} SELECT group_name AS category, count(*) AS n FROM h WHERE group_name <> '' GROUP BY 1""")
def history_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded rows by category of the dimension."""
    return H.category_counts(H.parse_actions(contract_actions(spark, sf_dir), fixed_lists.contracts(spark)))


#: Groups of each account's transactions, their primary rows filled from sub-actions.
_GROUPS = f"""{_DECODED}, b AS (SELECT *, {_tier("account")} AS pr FROM h), l AS (SELECT *, pr < coalesce(min(pr) OVER (PARTITION BY tx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 99999) AS led FROM b),
n AS (SELECT *, min(CASE WHEN led THEN seq END) OVER (PARTITION BY tx ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM l),
s AS (SELECT *, led AND nxt IS NULL AS lead, CASE WHEN led THEN nxt ELSE seq END AS sub_order FROM n),
g AS (SELECT account, tx, min(seq) AS first_seq, count(*) FILTER (NOT lead AND internal = 0) AS shown, count(*) FILTER (NOT lead AND internal = 1) AS hidden FROM s GROUP BY account, tx),
q AS (SELECT g.*, s.type, s.asset_in, s.raw_in, s.asset_out, s.raw_out, s.asset_out = '' OR s.raw_out = 0 OR s.type = 'contract' AND s.raw_out = 0 AS need_out, s.asset_in = '' OR s.raw_in = 0 AS need_in,
  (SELECT arg_min({{'asset': x.asset_out, 'raw': x.raw_out}}, x.sub_order) FROM s x WHERE x.tx = g.tx AND NOT x.lead AND x.asset_out <> '' AND x.raw_out <> 0 AND x.type IN ({", ".join(f"'{k}'" for k in H.FILLS_OUT)})) AS fill_out,
  (SELECT arg_min({{'asset': x.asset_in, 'raw': x.raw_in}}, x.sub_order) FROM s x WHERE x.tx = g.tx AND NOT x.lead AND x.asset_in <> '' AND x.raw_in <> 0 AND x.type IN ({", ".join(f"'{k}'" for k in H.FILLS_IN)})) AS fill_in
  FROM g JOIN s ON s.tx = g.tx AND s.lead)"""


@query(f"""WITH {_GROUPS} SELECT account, tx, first_seq, type, CASE WHEN need_in AND fill_in IS NOT NULL THEN fill_in.asset ELSE asset_in END AS asset_in, CASE WHEN need_out AND fill_out IS NOT NULL THEN fill_out.asset ELSE asset_out END AS asset_out,
CAST(CASE WHEN need_out AND fill_out IS NOT NULL THEN fill_out.raw ELSE raw_out END AS BIGINT) AS raw_out, CAST(least(5, shown) AS INTEGER) AS visible, CAST(hidden + greatest(0, shown - 5) AS INTEGER) AS internal FROM q""")
def history_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's transactions, grouped from their own view, with primaries that are filled from sub-actions."""
    known = fixed_lists.contracts(spark)
    rows = H.parse_actions(contract_actions(spark, sf_dir), known, "user")
    groups = H.grouped(rows, F.col("user"), known, ("user",))
    p = lambda c: F.col(f"primary.{c}")
    return groups.select(F.col("user").alias("account"), F.col("txID").alias("tx"), "first_seq", p("type").alias("type"), p("assetIn").alias("asset_in"), p("assetOut").alias("asset_out"), _raw("primary.rawAmountOut").alias("raw_out"), F.size("subActions").alias("visible"), F.col("internalCount").alias("internal"))
