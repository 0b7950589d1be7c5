"""Address screening: edges against listed entries, flags and their reasons, links from actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import codecs, nested, text
from vigilspark.operators import relational as R

UNKNOWN_ENTITY = "Unknown"


def one_entry_per_address(entries: DataFrame, address: str = "address", order: list[str] | None = None) -> DataFrame:
    """The build side of bulk screening: the last entry of each address."""
    return R.first_wins(entries, [address], [F.desc(c) for c in (order or ["id"])])


def screen_edges(edges: DataFrame, entries: DataFrame, lower: tuple[str, ...] = text.LOWER_SCREENING, oracle: DataFrame | None = None) -> DataFrame:
    """Edges with their match: (user, address, chain, source, entity_name, reason).

    One match for each edge. `oracle` (address, entity_name; of several names the first by `pos`, or the smallest) is asked for edges on chains with one form of address that
    have no listed match.
    """
    listed = one_entry_per_address(entries.withColumn("__key", text.normalize_address(F.col("address"), F.col("chain"), lower)), "__key")
    keyed = edges.withColumn("__key", text.normalize_address(F.col("l1_address"), F.col("chain"), lower))
    hits = keyed.join(listed.select("__key", "source", "entity_name", "reason"), "__key", "left" if oracle is not None else "inner")
    if oracle is not None:
        asked = oracle.groupBy(F.lower("address").alias("__key")).agg((F.min_by("entity_name", "pos") if "pos" in oracle.columns else F.min("entity_name")).alias("__name"))
        hits = hits.join(asked, "__key", "left").withColumns(
            {
                "entity_name": F.coalesce("entity_name", F.when(F.col("chain").isin(*lower), F.col("__name"))),
                "source": F.coalesce("source", F.when(F.col("chain").isin(*lower) & F.col("__name").isNotNull(), "ORACLE")),
            }
        )
        hits = hits.filter("source is not null").drop("__name")
    return hits.drop("__key")


def reasons(matches: DataFrame, user: str, label: Column, order: list[str]) -> DataFrame:
    """(user, matches, reason): the labels of each user joined by "; " in order."""
    return matches.groupBy(user).agg(F.count("*").alias("matches"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, label.alias("label")))), lambda x: x["label"]), "; ").alias("reason"))


def refresh_flags(users: DataFrame, flagged: DataFrame, user: str) -> DataFrame:
    """All users with `flagged` and `flag_reason` set anew: a pure function of edges and entries."""
    return users.drop("flagged", "flag_reason").join(flagged.select(user, F.col("reason").alias("flag_reason")), user, "left").withColumn("flagged", F.col("flag_reason").isNotNull())


def screen_address(entries: DataFrame, address: str) -> DataFrame:
    """Entries of one address, whatever the case; linked addresses aren't looked at."""
    return entries.filter(F.lower("address") == F.lower(F.lit(address)))


def screen_address_with_links(entries: DataFrame, edges: DataFrame, address: str) -> DataFrame:
    """Entries of an address and of the addresses linked to it."""
    linked = edges.filter(F.lower("thor_address") == F.lower(F.lit(address))).select(F.lower("l1_address").alias("__key"))
    keys = linked.union(entries.sparkSession.createDataFrame([(address.lower(),)], "__key string")).distinct()
    return entries.withColumn("__key", F.lower("address")).join(keys, "__key", "left_semi").drop("__key")


def detail(flagged: DataFrame, edges: DataFrame, entries: DataFrame, user: str, address: str) -> DataFrame:
    """One row for each flagged user, edge and entry of that edge's address; users without a match keep one row."""
    hits = edges.join(entries, address, "inner")
    return flagged.join(hits, user, "left")


def propagate_flag(users: DataFrame, edges: DataFrame, flags: DataFrame, user: str, address: str) -> DataFrame:
    """Users named by manual flags, directly or by one of their addresses."""
    by_edge = edges.join(flags.select(address), address, "left_semi").select(user)
    direct = users.join(flags.select(F.col(address).alias(user)), user, "left_semi").select(user)
    return by_edge.union(direct).distinct()


def links_of_actions(actions: DataFrame, user: str = "user") -> DataFrame:
    """(user, l1_address, chain, pool, affiliate, seq) from actions (seq, user, in, out).

    A user among the senders links all legs; a recipient beside other home-chain recipients links all legs as
    affiliate; a sole recipient links the senders. The last action decides `affiliate`.
    """
    ins, outs, me = F.col("`in`"), F.col("`out`"), F.col(user)
    sends = F.exists(ins, lambda x: x["address"] == me)
    receives = F.exists(outs, lambda x: x["address"] == me)
    shared = F.exists(outs, lambda x: (x["address"] != me) & x["address"].startswith("thor"))
    legs = F.when(sends | (receives & shared), F.concat(F.coalesce(ins, F.array()), F.coalesce(outs, F.array()))).when(receives, ins)
    rows = actions.select("seq", user, (~sends & shared).alias("affiliate"), F.posexplode(legs).alias("leg_no", "leg"))
    asset = F.coalesce(nested.first(F.col("leg.coins"))["asset"], F.lit(""))
    address = F.col("leg.address")
    chain = F.coalesce(text.chain_of_address(address), F.when(asset != "", text.chain_of_asset(asset)))
    rows = rows.filter(~text.missing(address) & ~address.startswith("thor")).select("seq", "leg_no", user, text.lower_hex(address).alias("l1_address"), chain.alias("chain"), text.or_default(asset, F.concat(chain, F.lit(".unknown"))).alias("pool"), "affiliate")
    rows = rows.filter(F.col("chain").isNotNull() & (F.col("chain") != "UNKNOWN"))
    last = F.struct("seq", "leg_no")
    return rows.groupBy(user, "l1_address", "chain").agg(F.min_by("pool", last).alias("pool"), F.max_by("affiliate", last).alias("affiliate"), F.max("seq").alias("seq"))


def links_of_pools(members: DataFrame, user: str = "user") -> DataFrame:
    """Links of liquidity providers (user, pools array<struct<pool, assetAddress>>)."""
    rows = members.select(user, F.explode("pools").alias("p")).filter(~text.missing(F.col("p.assetAddress")))
    chain = F.coalesce(text.chain_of_address(F.col("p.assetAddress")), text.chain_of_asset(F.col("p.pool")))
    return rows.select(user, text.lower_hex(F.col("p.assetAddress")).alias("l1_address"), chain.alias("chain"), F.col("p.pool").alias("pool")).distinct()


def member_sync(members: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New users and shared-key edges from a member list (address).

    Home-chain members are users themselves; members of chains with the same keys give the home address and an edge;
    every user known before, and every converted one, gets the edge of the shared-key hub.
    """
    known = users.select("thor_address").distinct()
    native = members.filter(F.col("address").startswith("thor")).select(F.col("address").alias("thor_address")).distinct()
    foreign = members.filter(~F.col("address").startswith("thor")).select("address").distinct().withColumn("thor_address", codecs.to_home_address("address")).filter("thor_address is not null")
    fresh = R.unseen(native.unionByName(foreign.select("thor_address")).distinct(), known, ["thor_address"])
    hub = known.unionByName(foreign.select("thor_address")).distinct().select("thor_address", codecs.to_cosmos_address("thor_address").alias("l1_address"), F.lit("GAIA").alias("chain")).filter("l1_address is not null")
    direct = foreign.select("thor_address", F.col("address").alias("l1_address"), text.chain_of_address(F.col("address")).alias("chain")).filter("chain is not null")
    return fresh, direct.unionByName(hub).distinct()


def merge_frozen(existing: DataFrame, baseline: DataFrame, *feeds: DataFrame, removed: DataFrame | None = None, source: str = "TETHER", now: Column | None = None) -> DataFrame:
    """The frozen-address list (address, chain, source, reason, last_seen; entity_name and added_at if there) after a sync.

    Feeds are joined and deduplicated by chain and address whatever the case; listed rows are touched, new rows added.
    Rows named in `removed` (address), whatever the case, keep their place with a reason that says so. Nothing is ever
    deleted, and a feed that gives no rows unfreezes nothing.
    """
    now = now if now is not None else F.current_timestamp()
    all_ = R.bag_union(baseline.withColumn("__o", F.lit(0)), *[f.withColumn("__o", F.lit(i + 1)) for i, f in enumerate(feeds)]).withColumn("__k", F.lower("address"))
    frozen = R.first_wins(all_, ["chain", "__k"], ["__o", "address"])
    address = text.normalize_address(F.col("address"), F.col("chain"), text.LOWER_FEEDS)
    cells = {"address": address, "chain": F.col("chain"), "source": F.lit(source), "entity_name": F.lit("Tether Frozen"), "reason": F.concat(F.lit("USDT blacklisted address ("), "chain", F.lit(")")), "added_at": now, "last_seen": now}
    fresh = R.first_wins(frozen.select(*[cells[c].alias(c) for c in existing.columns]), ["address", "source"], ["chain"])
    merged = R.upsert(existing, fresh, ["address", "source"], ["last_seen"])
    if removed is None:
        return merged
    gone = merged.filter(F.col("source") == source).withColumn("__k", F.lower("address")).join(removed.select(F.lower("address").alias("__k")), "__k", "left_semi")
    return R.update_by_key(merged, gone.select("address", "source", F.lit("USDT address (unfrozen by Tether)").alias("reason"), now.alias("last_seen")), ["address", "source"], ["reason", "last_seen"])


def append_only(before: DataFrame, after: DataFrame) -> None:
    """Raises where a list that must only grow has shrunk."""
    b, a = before.count(), after.count()
    if a < b:
        raise ValueError(f"the list shrank from {b} to {a} rows")


def flag_rate(users: DataFrame, flagged: str = "flagged") -> DataFrame:
    return users.agg(F.count("*").alias("total"), F.count_if(flagged).alias("flagged"), (F.count("*") - F.count_if(flagged)).alias("clean"))
