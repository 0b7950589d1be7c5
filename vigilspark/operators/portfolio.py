"""Valuation of balances, fees and volume at pool prices, and their snapshots over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions import nested, numbers, text

# Denominations of share and receipt tokens.
RECEIPTS = r"^x/(bow-|ghost-|staking-|nami-index-|fin-)"


def merged_balances(balances: DataFrame) -> DataFrame:
    """(asset, total, amount) of (denom, amount): receipts left out, denominations merged, zeros dropped.

    Amounts are summed by denomination first, so that names are parsed once each.
    """
    rows = balances.filter(~F.coalesce("denom", F.lit("")).rlike(RECEIPTS)).select("denom", numbers.int_prefix(F.col("amount")).alias("raw")).filter("raw <> 0")
    asset = F.when(F.col("denom") == "rune", "RUNE").otherwise(text.clean_asset(F.col("denom")))
    names = rows.groupBy("denom").agg(F.sum("raw").alias("raw")).withColumn("asset", asset).filter("asset <> ''")
    merged = names.groupBy("asset").agg(F.sum("raw").cast("decimal(38,0)").alias("total"))
    return merged.withColumn("amount", numbers.format_amount(F.col("total"))).filter("amount <> '0'").orderBy(F.desc("total"), "asset")


def sum_by_asset(coins: DataFrame) -> DataFrame:
    """(asset, amount) of (denom, amount) in units, by the shorter asset rule; zeros skipped."""
    rows = coins.select(text.short_asset(F.col("denom")).alias("asset"), numbers.amount(F.col("amount")).cast("double").alias("amount")).filter("amount <> 0")
    return rows.groupBy("asset").agg(F.sum("amount").alias("amount"))


def prices(pools: DataFrame) -> DataFrame:
    """(asset, usd): the last positive price of each asset, in pool order (pos)."""
    usd = F.col("assetPriceUSD").try_cast("double")
    return pools.select(text.short_asset(F.col("asset")).alias("asset"), usd.alias("usd"), "pos").filter("usd > 0").groupBy("asset").agg(F.max_by("usd", "pos").alias("usd"))


def home_price(pools: DataFrame, reference: str = "BTC.BTC") -> DataFrame:
    """One row (usd): the home asset's price from the reference pool, else the first pool with both prices, else 0."""
    rows = pools.select("asset", "pos", F.col("assetPrice").try_cast("double").alias("p"), F.col("assetPriceUSD").try_cast("double").alias("u")).filter("p > 0 and u > 0")
    return rows.agg(F.coalesce(F.max(F.when(F.col("asset") == reference, F.col("u") / F.col("p"))), F.min_by(F.col("u") / F.col("p"), "pos"), F.lit(0.0)).alias("usd"))


def valued(amounts: DataFrame, price: DataFrame, asset: str = "asset", amount: str = "amount") -> DataFrame:
    """Amounts with `usd`; an asset without a price is worth 0."""
    return amounts.join(price, asset, "left").withColumn("usd", F.col(amount) * F.coalesce("usd", F.lit(0.0)))


def total_usd(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))


def transfers(txs: DataFrame, recipient: str | None = None, sender: str | None = None) -> DataFrame:
    """(txhash, recipient, sender, amount, denom) of transfer events; each hash counts once.

    Events stand in `events`, or in `logs` where there are none there. Attribute keys and values may be base64; of a
    repeated key the last value counts. One row for each coin. A recipient or sender filters before anything is shuffled:
    what is left is a few strings an event, told apart by hash and place, so that a transaction that was read twice gives
    its transfers once (copies of a hash are taken to hold the same events).
    """
    events = F.when(F.size(F.coalesce("events", F.array())) > 0, F.col("events")).otherwise(F.flatten(F.transform("logs", lambda x: x["events"])))
    rows = txs.select("txhash", F.posexplode(events).alias("place", "e")).filter("e.type = 'transfer'")
    attrs = F.transform("e.attributes", lambda a: F.struct(nested.maybe_base64(a["key"]).alias("key"), a["value"].alias("value")))
    rows = rows.select("txhash", "place", attrs.alias("a")).select("txhash", "place", *[nested.maybe_base64(nested.attribute(F.col("a"), k)).alias(k) for k in ("recipient", "sender", "amount")])
    for column, asked in (("recipient", recipient), ("sender", sender)):
        if asked is not None:
            rows = rows.filter(F.col(column) == asked)
    one = rows.groupBy("txhash", "place").agg(F.min(F.struct("recipient", "sender", "amount")).alias("t"))
    return one.select("txhash", "t.recipient", "t.sender", F.explode(text.coin_list(F.col("t.amount"), clean=False)).alias("c")).select("txhash", "recipient", "sender", F.col("c.amount").alias("amount"), F.col("c.asset").alias("denom"))


def incoming(rows: DataFrame, recipient: str) -> DataFrame:
    """Amounts received by an address, by asset."""
    return sum_by_asset(rows.filter(F.col("recipient") == recipient))


def sent_to_set(rows: DataFrame, sender: str, recipients: DataFrame) -> DataFrame:
    """Amounts that a sender moved to any address of a set, by asset."""
    return sum_by_asset(rows.filter(F.col("sender") == sender).join(recipients.select(F.col("address").alias("recipient")), "recipient", "left_semi"))


def locked_volume(snapshots: DataFrame, asset: str, ts: str, amount: str, price: Column) -> DataFrame:
    """Snapshot rows with `delta` (growth since the asset's previous snapshot, never negative) and `delta_usd`."""
    before = F.coalesce(F.lag(amount).over(Window.partitionBy(asset).orderBy(ts)), F.lit(0.0))
    return snapshots.withColumn("delta", F.greatest(F.lit(0.0), F.col(amount) - before)).withColumn("delta_usd", F.col("delta") * F.coalesce(price, F.lit(0.0)))


def running_total(per_time: DataFrame, ts: str, value: str, name: str = "locked_usd") -> DataFrame:
    """The running sum over time of one row per time.

    Totals of days are summed first, so that the ordered pass over all times has one row per day; each day is then
    summed within itself.
    """
    day = F.date_trunc("day", F.col(ts))
    days = per_time.groupBy(day.alias("__day")).agg(F.sum(value).alias("__d"))
    days = days.withColumn("__base", F.coalesce(F.sum("__d").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("__d")
    inner = F.sum(value).over(Window.partitionBy("__day").orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per_time.withColumn("__day", day).join(days, "__day").withColumn(name, F.col("__base") + inner).drop("__day", "__base")


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """One row of changes against a snapshot (tvl, wallets, revenue, volume); volume falls back to revenue."""
    n, b = now.alias("n"), before.alias("b")
    both = n.join(b, F.lit(True), "left")
    pct = lambda c: numbers.percent_change(F.col(f"n.{c}"), F.col(f"b.{c}"))
    volume = F.when(F.col("n.volume") > 0, pct("volume"))
    return both.select(pct("tvl").alias("tvl_change"), (F.col("n.wallets") - F.col("b.wallets")).alias("wallet_change"), pct("revenue").alias("revenue_change"), F.coalesce(volume, pct("revenue")).alias("volume_change"))


def _usd(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias(name))


def _pairs(rows: DataFrame, name: str) -> DataFrame:
    """One row: the assets as a sorted array, null where there are none."""
    return rows.agg(F.nullif(F.sort_array(F.collect_list(F.struct("asset", F.col("amount").cast("double").alias("amount")))), F.array().cast("array<struct<asset:string,amount:double>>")).alias(name))


def snapshot(tvl: DataFrame, wallets: int | Column, held_fees: DataFrame, fees: DataFrame, volume: DataFrame, price: DataFrame, snapshots: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """The next row of the snapshots, or none where there is one of the last minutes already.

    Inputs are (asset, amount): assets held, fees not yet swept, fees and volume of all time. Without fees of all time
    those held stand in. Volume in USD only grows: the growth of each asset since the last snapshot, at today's price,
    is added to that snapshot's total.
    """
    last = snapshots.agg(F.max_by(F.struct(F.col("cumulative_volume_usd").try_cast("double").alias("usd"), F.col("cumulative_volume_assets").alias("assets")), "created_at").alias("last"))
    before = last.select(F.explode("last.assets").alias("b")).groupBy("b.asset").agg(F.max("b.amount").alias("before"))
    grown = valued(volume.join(before, "asset", "left").select("asset", F.greatest(F.lit(0.0), F.col("amount") - F.coalesce("before", F.lit(0.0))).alias("amount")), price)
    all_fees = fees.unionByName(held_fees.join(F.broadcast(fees.limit(1).select(F.lit(True).alias("__any"))), F.lit(True), "left_anti"))
    parts = [_usd(valued(tvl, price), "tvl"), _usd(valued(held_fees, price), "held"), _usd(valued(all_fees, price), "fees"), _pairs(all_fees, "fee_assets"), _usd(grown, "grown"), _pairs(volume, "volume_assets"), last]
    one = parts[0]
    for p in parts[1:]:
        one = one.join(F.broadcast(p), F.lit(True))
    recent = snapshots.filter(F.col("created_at") > now - F.expr(f"INTERVAL {minutes} MINUTES")).limit(1).select(F.lit(True).alias("__recent"))
    one = one.join(F.broadcast(recent), F.lit(True), "left_anti")
    locked = F.coalesce("last.usd", F.lit(0.0)) + F.col("grown")
    return one.select(
        F.col("tvl").cast("string").alias("tvl_usd"),
        (wallets if isinstance(wallets, Column) else F.lit(wallets)).cast("int").alias("wallet_count"),
        F.col("held").cast("string").alias("revenue_usd"),
        F.col("fees").cast("string").alias("cumulative_fees_usd"),
        F.col("fee_assets").alias("cumulative_fees_assets"),
        locked.cast("string").alias("cumulative_volume_usd"),
        F.col("volume_assets").alias("cumulative_volume_assets"),
        now.alias("created_at"),
    )


def report(now_row: DataFrame, snapshots: DataFrame, now: Column, fee_points: float = 15.0) -> DataFrame:
    """The headline: values of the current snapshot and their changes against the last one at least 24 hours old.

    Without real volume, it is what the fees imply at their rate, and its change is that of the fees.
    """
    number = lambda row, c: F.col(f"{row}.{c}").try_cast("double")
    names = ["tvl_usd", "wallet_count", "revenue_usd", "cumulative_fees_usd", "cumulative_volume_usd"]
    old = snapshots.filter(F.col("created_at") <= now - F.expr("INTERVAL 24 HOURS")).agg(F.max_by(F.struct(*names), "created_at").alias("o"))
    both = now_row.select(F.struct(*names).alias("n"), F.col("cumulative_volume_assets").isNotNull().alias("volume_is_real")).join(F.broadcast(old), F.lit(True))
    change = {c: numbers.percent_change(number("n", c), number("o", c)) for c in ("tvl_usd", "cumulative_fees_usd", "cumulative_volume_usd")}
    fees_change = F.when(F.col("o.cumulative_fees_usd").isNotNull(), change["cumulative_fees_usd"]).otherwise(numbers.percent_change(number("n", "cumulative_fees_usd"), number("o", "revenue_usd")))
    locked = number("n", "cumulative_volume_usd")
    implied = numbers.volume_from_fees(number("n", "cumulative_fees_usd"), F.lit(fee_points))
    return both.select(
        number("n", "tvl_usd").alias("tvl_usd"),
        F.col("n.wallet_count").alias("wallets"),
        number("n", "cumulative_fees_usd").alias("fees_usd"),
        F.when(locked > 0, locked).otherwise(F.coalesce(implied, F.lit(0.0))).alias("volume_usd"),
        "volume_is_real",
        change["tvl_usd"].alias("tvl_change"),
        (F.col("n.wallet_count") - F.col("o.wallet_count")).alias("wallet_change"),
        fees_change.alias("revenue_change"),
        F.coalesce(F.when(locked > 0, change["cumulative_volume_usd"]), fees_change).alias("volume_change"),
    )


def thinned(snapshots: DataFrame, ts: str, minutes: int = 10) -> DataFrame:
    """The first snapshot of each interval."""
    return snapshots.withColumn("__w", F.window(ts, f"{minutes} minutes")["start"]).groupBy("__w").agg(F.min_by(F.struct(*snapshots.columns), ts).alias("s")).select("s.*")


def contract_state(models: DataFrame, schema: str, defaults: dict[str, Column], *contract: str) -> DataFrame:
    """One row of a contract's state: of base64 JSON models (pos, value) the first that decodes, with defaults; one for each
    contract where columns name it."""
    got = nested.base64_json(F.col("value"), schema)
    found = models.select(*contract, "pos", got.alias("s")).filter(F.col("s").isNotNull() & F.coalesce(*[F.col(f"s.{k}").cast("string") for k in defaults]).isNotNull())
    first = found.groupBy(*contract).agg(F.min_by("s", "pos").alias("s"))
    return first.select(*contract, *[F.coalesce(F.col(f"s.{k}"), d).alias(k) for k, d in defaults.items()])
