"""Wallet histories: actions decoded to rows, grouped into transactions, labelled and exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions import nested, numbers, text, times
from vigilspark.operators import dims, fixed_lists

# Types by how their assets are read from a contract's first funds and attributes.
IN_FUND = ("fin-order", "fin-order-inc", "fin-order-dec", "ghost-lend", "bow-deposit", "pilot-order", "nami-deposit")
OUT_AMOUNT = ("ghost-borrow", "ghost-withdraw", "fin-order-wd", "ghost-credit-borrow", "fin-range-wd", "fin-range-close")
OUT_FUND = ("bow-withdraw", "nami-withdraw")
IN_AMOUNT = ("ghost-repay", "ghost-credit-repay")
SWAP_ASK = ("bow-swap", "tc-swap")
SWAP_RETURNED = ("pilot-swap", "liquidy-swap", "liquidy-exec", "brune-swap")
TWO_FUNDS = ("fin-range", "fin-range-dep")
FEE_ONLY = ("fin-range-fee", "fin-range-claim", "fin-mm-fee")
NOTHING = ("fin-range-xfer", "ghost-credit-create")
FILLS_OUT = ("swap", "fin-trade", "tc-swap", "bow-swap", "fin-order-wd")
FILLS_IN = ("swap", "fin-trade", "tc-swap", "bow-swap")
CLAIMS = ("ruji-unstake", "ruji-claim")
# The class of each of these types; other types have none.
CLASSES = {
    kind: name
    for name, kinds in (("ask", SWAP_ASK), ("returned", SWAP_RETURNED), ("in", IN_FUND), ("out_amount", OUT_AMOUNT), ("out", OUT_FUND), ("in_amount", IN_AMOUNT), ("two", TWO_FUNDS), ("fee", FEE_ONLY), ("nothing", NOTHING), ("claim", CLAIMS))
    for kind in kinds
}
VISIBLE = 5


def _map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def _truthy(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def decoded(contract: Column) -> Column:
    """struct<type, asset_in, raw_in, asset_out, raw_out> of a contract action; null without a contract type.

    Reads a struct with contractType, funds and attributes.
    """
    types = {event: F.struct(F.lit(kind).alias("type"), F.lit(CLASSES.get(kind, kind)).alias("class")) for event, kind in dims.CONTRACT_TYPES.items()}
    mapped = nested.lookup(F.create_map(*[x for event, known in types.items() for x in (F.lit(event), known)]), contract["contractType"])
    attrs = contract["attributes"]
    attr = lambda k: _truthy(nested.lookup(attrs, F.lit(k)))

    def from_type(read: Column) -> Column:
        known, funds = read["mapped"], read["funds"]
        kind, of = F.coalesce(known["type"], F.lit("contract")), known["class"]
        f0, f1 = F.get(funds, F.lit(0)), F.get(funds, F.lit(1))
        asset, amount = F.coalesce(f0["asset"], F.lit("")), F.coalesce(f0["amount"], F.lit("0"))
        bid = F.coalesce(attr("bid"), attr("offer"), F.lit("0"))
        bid_coin = F.when(~bid.rlike(r"^\d+$"), text.coin(bid))
        ask, returned = text.coin(attr("ask")), text.coin(attr("returned"))
        swap_out = F.coalesce(returned, ask)
        fee = F.coalesce(F.nullif(attr("quote"), F.lit("0")), F.nullif(attr("base"), F.lit("0")), F.lit("0"))
        no, zero = F.lit(""), F.lit("0")

        def row(asset_in: Column = no, raw_in: Column = zero, asset_out: Column = no, raw_out: Column = zero) -> Column:
            return F.struct(kind.alias("type"), asset_in.alias("asset_in"), raw_in.alias("raw_in"), asset_out.alias("asset_out"), raw_out.alias("raw_out"))

        out = lambda c: (F.coalesce(c["asset"], no), F.coalesce(c["amount"], zero))
        return (
            F.when(known.isNull(), row(asset, amount))
            .when(of == "fin-trade", row(asset, amount, F.coalesce(bid_coin["asset"], no), F.coalesce(bid_coin["amount"], bid)))
            .when(of == "ask", row(asset, amount, *out(swap_out)))
            .when(of == "returned", row(asset, amount, *out(returned)))
            .when(of == "in", row(asset, amount))
            .when(of == "out_amount", row(asset_out=asset, raw_out=F.coalesce(attr("amount"), amount)))
            .when(of == "out", row(asset_out=asset, raw_out=amount))
            .when(of == "in_amount", row(asset, F.coalesce(attr("amount"), amount)))
            .when(of == "two", row(asset, amount, *out(f1)))
            .when(of == "fee", row(raw_out=fee))
            .when(of == "nothing", row())
            .when(of == "ruji-stake", row(text.or_default(asset, "RUJI"), amount))
            .when(of == "claim", row(asset_out=F.lit("RUJI"), raw_out=F.coalesce(attr("returned"), amount)))
            .when(of == "brune-mint", row(asset, amount, F.lit("BRUNE"), F.coalesce(attr("amount"), amount)))
            .when(of == "brune-burn", row(F.lit("BRUNE"), amount))
            .otherwise(F.when(amount != "0", row(asset, amount)).otherwise(row()))
        )

    # the type and its class are looked up once, not by every branch
    made = nested.let(F.struct(mapped.alias("mapped"), text.coin_list(contract["funds"]).alias("funds")), from_type)
    return F.when(~text.missing(F.coalesce(contract["contractType"], F.lit(""))), made)


def fees(metadata: Column) -> Column:
    """struct<amount, currency>: the first network fee, else the liquidity fee in the home asset, else empty."""
    kinds = [metadata[k] for k in ("swap", "addLiquidity", "withdraw")]
    meta_fees = F.coalesce(*[F.when(k.isNotNull(), F.coalesce(k["networkFees"], F.array().cast("array<struct<asset:string,amount:string>>"))) for k in kinds])
    first = nested.first(F.when(F.size(meta_fees) > 0, meta_fees).otherwise(metadata["withdraw"]["networkFees"]))
    liquidity = F.coalesce(*[F.when(k.isNotNull(), F.coalesce(k["liquidityFee"], F.lit(""))) for k in kinds])
    return (
        F.when(first.isNotNull(), F.struct(numbers.raw_amount(text.or_default(first["amount"], "0")).alias("amount"), text.clean_asset(F.coalesce(first["asset"], F.lit(""))).alias("currency")))
        .when(~text.missing(liquidity) & (liquidity != "0"), F.struct(numbers.raw_amount(liquidity).alias("amount"), F.lit("RUNE").alias("currency")))
        .otherwise(F.struct(F.lit("").alias("amount"), F.lit("").alias("currency")))
    )


#: Contracts up to this number are sent to the rows' tasks; more are joined by a shuffle.
FEW_CONTRACTS = 2000


def contract_names(contracts: DataFrame) -> DataFrame:
    """(address, who struct<name, category>): one row for each address, of several the smallest."""
    return contracts.groupBy("address").agg(F.min(F.struct("name", "category")).alias("who"))


def _few(contracts: DataFrame) -> bool:
    return contracts.limit(FEW_CONTRACTS + 1).count() <= FEW_CONTRACTS


def _with_contracts(actions: DataFrame, contracts: DataFrame) -> DataFrame:
    """`actions` (with __from, __to and __legs, the addresses of all legs) with the contracts of sender and recipient
    (__f, __t) and, where __open asks for it, the first among the legs (__any)."""
    names = contract_names(contracts)
    few = _few(names)
    named = actions
    for key, who in (("__from", "__f"), ("__to", "__t")):
        other = names.select(F.col("address").alias(key), F.col("who").alias(who))
        named = named.join(F.broadcast(other) if few else other, key, "left")
    if few:
        # one row of at most FEW_CONTRACTS entries: the actions aren't shuffled, and those that need it look their legs up in place
        one = names.agg(F.map_from_entries(F.collect_list(F.struct("address", "who"))).alias("__names"))
        hit = F.get(F.filter(F.transform("__legs", lambda x: F.try_element_at("__names", x)), lambda x: x.isNotNull()), F.lit(0))
        return named.join(F.broadcast(one), F.lit(True), "left").withColumn("__any", F.when(F.col("__open"), hit)).drop("__names")
    any_contract = actions.filter("__open").select("seq", F.posexplode("__legs").alias("pos", "address")).join(names, "address").groupBy("seq").agg(F.min_by("who", "pos").alias("__any"))
    return named.join(any_contract, "seq", "left")


def parse_actions(actions: DataFrame, contracts: DataFrame, *carry: str) -> DataFrame:
    """History rows of actions (seq, and the fields of schemas.ACTIONS); contracts is the dimension of known contracts.

    Names come from the sender's contract, else the recipient's; where neither is known, the first known contract among
    all senders and recipients completes a swap's missing output. `carry` names further columns to keep; seq must be
    unique among all rows.
    """
    legs = F.concat(F.coalesce(F.col("`in`"), F.array()), F.coalesce(F.col("`out`"), F.array()))
    base = actions.withColumns(
        {
            "__from": F.coalesce(nested.first(F.col("`in`"))["address"], F.lit("")),
            "__to": F.coalesce(nested.first(F.col("`out`"))["address"], F.lit("")),
            "__legs": F.filter(F.transform(legs, lambda x: x["address"]), lambda x: x.isNotNull()),
            "__d": F.when(F.col("type") == "contract", decoded(F.col("metadata.contract"))),
        }
    )
    d = F.col("__d")
    is_contract = d.isNotNull()
    base = _with_contracts(base.withColumn("__open", F.coalesce(is_contract & (d["asset_out"] == "") & (d["asset_in"] != ""), F.lit(False))), contracts)
    c_in, c_out = nested.first(nested.first(F.col("`in`"))["coins"]), nested.first(nested.first(F.col("`out`"))["coins"])
    f_name, t_name = F.col("__f.name"), F.col("__t.name")
    pair = F.coalesce(f_name, t_name, F.col("__any.name"))
    needs_pair = F.col("__open")
    asset_out = F.when(needs_pair & pair.isNotNull(), text.or_default(text.other_side(d["asset_in"], pair), "")).otherwise(d["asset_out"])
    raw_in = F.when(is_contract, d["raw_in"]).otherwise(text.or_default(c_in["amount"], "0"))
    raw_out = F.when(is_contract, d["raw_out"]).otherwise(text.or_default(c_out["amount"], "0"))
    name = F.coalesce(_truthy(f_name), _truthy(t_name), F.when(needs_pair, F.col("__any.name")), F.lit(""))
    category = F.coalesce(_truthy(F.col("__f.category")), _truthy(F.col("__t.category")), F.when(needs_pair, F.col("__any.category")), F.lit(""))
    fee = fees(F.col("metadata"))
    blank = F.lit("")
    # amounts are read once, in a step of their own
    base = base.withColumns({"__in": numbers.amount(raw_in), "__out": numbers.amount(raw_out)})
    return base.select(
        "seq",
        F.when(is_contract, d["type"]).otherwise(text.or_default(F.col("type"), "unknown")).alias("type"),
        F.coalesce(times.iso(times.from_nanos(F.col("date"))), blank).alias("date"),
        F.when(is_contract, d["asset_in"]).otherwise(text.clean_asset(c_in["asset"])).alias("assetIn"),
        numbers.shown_amount(F.col("__in")).alias("amountIn"),
        F.when(is_contract, asset_out).otherwise(text.clean_asset(c_out["asset"])).alias("assetOut"),
        F.when(is_contract & (d["type"] == "contract"), blank).otherwise(numbers.shown_amount(F.col("__out"))).alias("amountOut"),
        numbers.exact_amount(F.col("__in")).alias("rawAmountIn"),
        numbers.exact_amount(F.col("__out")).alias("rawAmountOut"),
        F.col("__from").alias("from"),
        F.col("__to").alias("to"),
        F.coalesce(f_name, blank).alias("fromLabel"),
        F.coalesce(t_name, blank).alias("toLabel"),
        F.coalesce(nested.first(F.col("`in`"))["txID"], blank).alias("txID"),
        text.or_default(F.col("status"), "unknown").alias("status"),
        fee["amount"].alias("feeAmount"),
        fee["currency"].alias("feeCurrency"),
        name.alias("contractName"),
        category.alias("contractCategory"),
        *carry,
    )


def fill_siblings(rows: DataFrame, group: str = "txID", order: str = "seq", kind: str = "type", asset: str = "assetOut", within: tuple[str, ...] = ()) -> DataFrame:
    """Trades without an output asset take that of the first swap of their group that has one."""
    # a row without a group is a group of its own, so that such rows are no hot key
    keys = [*within, group, F.when(text.missing(F.col(group)), F.col(order))]
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.first(F.when(F.col(kind).isin("tc-swap", "bow-swap") & ~text.missing(F.col(asset)), F.col(asset)), ignorenulls=True).over(by)
    return rows.withColumn("__a", found).withColumn(asset, F.when((F.col(kind) == "fin-trade") & text.missing(F.col(asset)) & ~text.missing(F.col(group)), F.coalesce("__a", asset)).otherwise(F.col(asset))).drop("__a")


def with_priority(rows: DataFrame, user: Column | None, contracts: DataFrame | None = None) -> DataFrame:
    """Rows with `priority`: the type's, raised by 100 for a recipient, 200 for strangers, 300 between contracts."""
    base = F.coalesce(nested.lookup(_map(dims.PRIORITIES), F.col("type")), F.lit(dims.OTHER_PRIORITY))
    if user is None:
        return rows.withColumn("priority", base)
    known = (contracts.select("address").distinct() if contracts is not None else rows.select(F.col("from").alias("address")).limit(0)).withColumn("__is", F.lit(True))
    known = F.broadcast(known) if contracts is None or _few(known) else known
    out = rows.join(known.toDF("from", "__fc"), "from", "left").join(known.toDF("to", "__tc"), "to", "left")
    mine, to_me = F.col("from") == user, F.col("to") == user
    tier = F.when(F.col("__fc") & F.col("__tc") & ~mine & ~to_me, 300).when(mine, 0).when(to_me, 100).otherwise(200)
    return out.withColumn("priority", base + tier).drop("__fc", "__tc")


def group_order(rows: DataFrame, group: str, order: str, priority: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each group with `is_primary` and `sub_order`.

    The primary is the first of the rows with the lowest priority. A row that was primary for a while stands where the
    row that displaced it does, before rows pushed later; others stand at their own place. A row was primary for a
    while if no row before it is as low; it is displaced by the first later row that is lower, which is the next such
    row.
    """
    by = Window.partitionBy(*within, group).orderBy(order)
    before = F.min(priority).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__led", before.isNull() | (F.col(priority) < before))
    next_led = F.min(F.when(F.col("__led"), F.col(order))).over(by.rowsBetween(1, Window.unboundedFollowing))
    marked = marked.withColumn("__next", next_led)
    return marked.withColumn("is_primary", F.col("__led") & F.col("__next").isNull()).withColumn("sub_order", F.when(F.col("__led"), F.col("__next")).otherwise(F.col(order))).drop("__led", "__next")


def grouped(rows: DataFrame, user: Column | None = None, contracts: DataFrame | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """History groups (first_seq, txID, primary, subActions, internalCount) of history rows; `within` names columns that
    part the rows further (the user of each), which come first.

    Rows without a transaction id are groups of their own. The primary's missing output or input is taken from its
    first sub-action of a trading type that has one; internal sub-actions are counted, at most VISIBLE others shown and
    the rest counted too.
    """
    keyed = with_priority(rows, user, contracts).withColumn("__g", F.when(text.missing(F.col("txID")), F.concat(F.lit("#"), F.col("seq"))).otherwise(F.col("txID")))
    ordered = group_order(keyed, "__g", "seq", "priority", within)
    columns = [c for c in rows.columns if c not in within]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    groups = ordered.groupBy(*within, "__g").agg(
        F.min("seq").alias("first_seq"),
        F.max_by(row, "is_primary").alias("primary"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_primary"), F.struct("sub_order", row.alias("row"))))), lambda x: x["row"]).alias("subs"),
    )

    def filler(side: str, kinds: tuple[str, ...]) -> Column:
        return F.get(F.filter("subs", lambda s: ~text.missing(s[f"asset{side}"]) & (s[f"amount{side}"] != "0") & s["type"].isin(*kinds)), F.lit(0))

    def filled(p: Column) -> Column:
        for side, kinds in (("Out", FILLS_OUT), ("In", FILLS_IN)):
            need, got = text.missing(p[f"asset{side}"]) | (p[f"amount{side}"] == "0"), filler(side, kinds)
            take = need & got.isNotNull()
            values = {c: F.when(take, got[c]).otherwise(p[c]) for c in (f"asset{side}", f"amount{side}", f"rawAmount{side}")}
            p = F.struct(*[(values.get(c, p[c])).alias(c) for c in columns])
        return p

    internal = F.filter("subs", lambda s: s["type"].isin(*dims.INTERNAL_TYPES))
    shown = F.filter("subs", lambda s: ~s["type"].isin(*dims.INTERNAL_TYPES))
    return groups.select(
        *within,
        "first_seq",
        F.col("primary.txID").alias("txID"),
        filled(F.col("primary")).alias("primary"),
        F.slice(shown, 1, VISIBLE).alias("subActions"),
        (F.size(internal) + F.greatest(F.size(shown) - VISIBLE, F.lit(0))).alias("internalCount"),
    )


def groups_of_types(groups: DataFrame, kinds: list[str]) -> DataFrame:
    """Groups whose primary or any visible sub-action is of one of the types."""
    return groups.filter(F.col("primary.type").isin(*kinds) | F.exists("subActions", lambda s: s["type"].isin(*kinds)))


def in_dates(rows: DataFrame, date: str, start: Column, end: Column | None) -> DataFrame:
    """Rows within dates, both ends included; rows without a date go; a live report has no upper end."""
    out = rows.filter(~text.missing(F.col(date)) & (F.col(date) >= start))
    return out if end is None else out.filter(F.col(date) <= end)


def category_counts(rows: DataFrame, kind: str = "type", mapping: dict[str, str] | None = None) -> DataFrame:
    """Rows by category; types of no category aren't counted."""
    return rows.select(nested.lookup(_map(mapping or dims.CATEGORIES), F.col(kind)).alias("category")).filter("category is not null").groupBy("category").agg(F.count("*").alias("n"))


def subtype_counts(rows: DataFrame, category: str, kind: str = "type", mapping: dict[str, str] | None = None) -> DataFrame:
    kinds = [t for t, c in (mapping or dims.CATEGORIES).items() if c == category]
    return rows.filter(F.col(kind).isin(*kinds)).groupBy(kind).agg(F.count("*").alias("n"))


def tax_label(kind: Column, mapping: dict[str, str] | None = None) -> Column:
    return nested.lookup(_map(mapping or dims.TAX_LABELS), kind, F.lit(""))


def type_label(kind: Column) -> Column:
    """The display name of a type; the type itself where it has none."""
    return nested.lookup(_map(fixed_lists.TYPE_LABELS), kind, kind)


def description(row: DataFrame | None = None) -> Column:
    """The description of a history row for tax exports."""
    kind, sent = F.col("type"), text.or_default(F.col("rawAmountIn"), F.col("amountIn"))
    base = (
        F.when(kind == "swap", F.concat(F.lit("Swap "), "assetIn", F.lit(" → "), "assetOut"))
        .when(kind == "addLiquidity", F.concat(F.lit("LP Add "), "assetIn"))
        .when(kind == "withdraw", F.concat(F.lit("Withdraw "), "assetOut"))
        .when(kind == "send", F.concat(F.lit("Send "), F.when(sent != "0", F.col("assetIn")).otherwise(F.col("assetOut"))))
        .otherwise(kind)
    )
    contract = F.coalesce(_truthy(F.col("contractName")), _truthy(F.col("fromLabel")), _truthy(F.col("toLabel")))
    return F.when(contract.isNotNull(), F.concat(base, F.lit(" ["), contract, F.lit("]"))).otherwise(base)


TAX_HEADER = ("Date", "Sent Amount", "Sent Currency", "Received Amount", "Received Currency", "Fee Amount", "Fee Currency", "Net Worth Amount", "Net Worth Currency", "Label", "Description", "TxHash")


def tax_rows(rows: DataFrame) -> DataFrame:
    """The twelve columns of the tax export; amounts of 0 and their currencies are blank."""
    sent, got = text.or_default(F.col("rawAmountIn"), F.col("amountIn")), text.or_default(F.col("rawAmountOut"), F.col("amountOut"))
    blank = F.lit("")
    cells = ["date", F.when(sent != "0", sent).otherwise(blank), F.when(sent != "0", F.col("assetIn")).otherwise(blank), F.when(got != "0", got).otherwise(blank), F.when(got != "0", F.col("assetOut")).otherwise(blank), F.coalesce("feeAmount", blank), F.coalesce("feeCurrency", blank), blank, blank, tax_label(F.col("type")), description(), F.coalesce("txID", blank)]
    return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(cells, TAX_HEADER, strict=True)])


def live_actions(actions: DataFrame) -> DataFrame:
    """The live feed's rows: dust of the home asset and actions without a sender are left out."""
    # Short names of types.
    short = {"swap": "SWAP", "addLiquidity": "ADD", "withdraw": "WD", "send": "SEND", "refund": "REFUND"}
    leg_in, leg_out = nested.first(F.col("`in`")), nested.first(F.col("`out`"))
    coin_in, coin_out = nested.first(leg_in["coins"]), nested.first(leg_out["coins"])
    sender = F.coalesce(leg_in["address"], F.lit(""))
    receiver = text.or_default(leg_out["address"], sender)
    asset_in, asset_out = F.coalesce(coin_in["asset"], F.lit("")), F.coalesce(coin_out["asset"], F.lit(""))
    amount = F.coalesce(numbers.amount(coin_in["amount"]), F.lit(0).cast("decimal(30,8)"))
    kind = F.coalesce(nested.lookup(_map(short), F.col("type")), F.upper(_truthy(F.col("type"))), F.lit("?"))
    return actions.filter((sender != "") & ~((amount < F.lit("0.01").cast("decimal(10,8)")) & asset_in.contains("RUNE"))).select(
        F.when((kind == "SWAP") & F.coalesce(F.col("metadata.swap.isStreamingSwap"), F.lit(False)), "STREAM").otherwise(kind).alias("type"),
        text.middle_cut(sender, 8, 4, 20).alias("from"),
        text.middle_cut(receiver, 8, 4, 20).alias("to"),
        sender.alias("from_full"),
        receiver.alias("to_full"),
        text.short_asset(asset_in).alias("assetIn"),
        text.short_asset(asset_out).alias("assetOut"),
        numbers.live_amount(amount).alias("amount"),
        times.iso(times.from_nanos(F.col("date"))).alias("time"),
        F.coalesce(leg_in["txID"], F.lit("")).alias("txID"),
    )
