"""List syncs, bulk screening and the requests that are served from the tables.

Each sync takes the listed entries as they are and gives them as they are after it; `exports.audited` runs one and
makes its audit row. Requests take tables and give the rows of their answer. "Now" is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import nested, numbers, text
from vigilspark.operators import dashboards, dims, history, portfolio, relational, screening
from vigilspark.sources import exports, feeds, storage

#: What a sync changes in an entry that is listed already, by source.
UPDATES = {"OFAC": ("last_seen", "entity_name", "chain"), "EU": ("last_seen",), "HACK": ("last_seen", "entity_name", "reason"), "TETHER": ("last_seen",)}

ENTRY = ("address", "chain", "source", "entity_name", "reason", "added_at", "last_seen")


def merge_source(entries: DataFrame, rows: DataFrame, source: str, now: Column) -> DataFrame:
    """The entries after a sync of one source; `rows` are (address, chain, entity_name, reason); of an address the first
    by `pos` counts where there is one, else the smallest."""
    order = F.col("pos") if "pos" in rows.columns else F.struct("chain", "entity_name", "reason")
    fresh = relational.first_wins(rows, ["address"], [order]).select("address", "chain", F.lit(source).alias("source"), "entity_name", "reason", now.alias("added_at"), now.alias("last_seen"))
    return relational.upsert(entries.select(*ENTRY), fresh, ["address", "source"], UPDATES[source])


def sync_sanctions(entries: DataFrame, parties: DataFrame, now: Column) -> DataFrame:
    """Digital-currency addresses of a sanctions document (see feeds.read_sanctions)."""
    return merge_source(entries, feeds.sanctioned_addresses(parties), "OFAC", now)


def sync_texts(entries: DataFrame, texts: DataFrame, now: Column) -> DataFrame:
    """Addresses found in free text (value)."""
    return merge_source(entries, feeds.text_addresses(texts).withColumn("reason", F.lit("EU Consolidated Sanctions List")), "EU", now)


def sync_incidents(entries: DataFrame, incidents: DataFrame, now: Column) -> DataFrame:
    """Addresses of known incidents; the reason of a new entry tells the estimated loss, that of a listed one doesn't."""
    rows = incidents.withColumn("address", text.normalize_address(F.col("address"), F.col("chain"), text.LOWER_FEEDS))
    known = entries.filter("source = 'HACK'").select("address", F.lit(True).alias("__known"))
    loss = F.concat(F.col("incident"), F.lit(" — est. $"), numbers.thousands(F.col("estimated_usd")), F.lit(" ("), F.col("source"), F.lit(")"))
    short = F.concat(F.col("incident"), F.lit(" ("), F.col("source"), F.lit(")"))
    named = rows.join(known, "address", "left").select("address", "chain", F.col("incident").alias("entity_name"), F.when(F.col("__known"), short).otherwise(loss).alias("reason"))
    return merge_source(entries, named, "HACK", now)


def sync_frozen(entries: DataFrame, baseline: DataFrame, frozen: list[DataFrame], removed: list[DataFrame], now: Column) -> DataFrame:
    """The frozen-address list after a sync (see screening.merge_frozen)."""
    return screening.merge_frozen(entries.select(*ENTRY), baseline, *frozen, removed=relational.bag_union(*removed) if removed else None, now=now)


def screen_users(users: DataFrame, edges: DataFrame, entries: DataFrame, now: Column, oracle: DataFrame | None = None) -> DataFrame:
    """All users with flags and the time of the screening set anew, from their addresses alone.

    Edges are (id, thor_address, l1_address, chain), entries as in the table. The last listed entry of an address counts.
    """
    matches = screening.screen_edges(edges, entries, oracle=oracle)
    label = F.concat("source", F.lit(": "), F.coalesce("entity_name", F.lit(screening.UNKNOWN_ENTITY)), F.lit(" ("), "l1_address", F.lit(")"))
    flagged = screening.refresh_flags(users, screening.reasons(matches, "thor_address", label, ["id"]), "thor_address")
    return flagged.withColumn("screened_at", now).select(*users.columns)


def stats(users: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of counts: users, flagged users, and the entries of the three published lists with their total."""
    people = dashboards.counts(users, {"flagged_users": F.coalesce("flagged", F.lit(False))}).withColumnRenamed("total", "total_users")
    names = ("OFAC", "EU", "HACK")
    lists = entries.agg(*[F.count_if(F.col("source") == s).alias(f"{s.lower()}_entries") for s in names])
    lists = lists.withColumn("total_list_entries", sum((F.col(f"{s.lower()}_entries") for s in names[1:]), F.col("ofac_entries")))
    return people.join(F.broadcast(lists), F.lit(True))


def overview(users: DataFrame, entries: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """One row of the start page's counts, of all time and of the last 24 hours: one scan of each table."""
    day = lambda c: F.col(c) > now - F.expr("INTERVAL 24 HOURS")
    is_flagged = F.coalesce("flagged", F.lit(False))
    people = dashboards.counts(users, {"flagged": is_flagged, "users_24h": day("first_seen"), "flagged_24h": is_flagged & day("screened_at")}).withColumnRenamed("total", "users")
    lists = dashboards.counts(entries, {s.lower(): F.col("source") == s for s in dims.SOURCES} | {"entries_24h": day("added_at")}).withColumnRenamed("total", "entries")
    pairs = edges.agg(dashboards.distinct_pairs(edges, "l1_address", "chain").alias("links"), dashboards.distinct_pairs(edges, "l1_address", "chain", day("discovered_at")).alias("links_24h"))
    return people.join(F.broadcast(lists), F.lit(True)).join(F.broadcast(pairs), F.lit(True))


def flagged_users(users: DataFrame, edges: DataFrame) -> DataFrame:
    """Flagged users with their addresses as `links`, for `exports.json_rows` and `exports.flagged_lines`."""
    return relational.nested_left(users.filter("flagged").select("thor_address", "flag_reason", "screened_at"), edges.select("thor_address", "chain", "l1_address"), "thor_address", ["chain", "l1_address"], "links")


def certificate(entries: DataFrame, address: str, now: Column) -> DataFrame:
    """One certificate of an address: whether it is listed, and how many sources were asked. Its id follows from both."""
    found = screening.screen_address(entries, address).agg(F.count("*").alias("n"))
    return found.select(exports.public_id(F.lit(address.lower()), now.cast("string"), size=8, prefix="OZ-").alias("cert_id"), F.lit(address).alias("address"), (F.col("n") > 0).alias("flagged"), F.lit(len(dims.SOURCES)).alias("sources_checked"), now.alias("issued_at"))


def by_public_id(rows: DataFrame, column: str, asked: str) -> DataFrame:
    """The row of a public identifier, whatever the case it is asked in."""
    return rows.filter(F.col(column) == asked.upper())


def history_report(actions: DataFrame, balances: DataFrame, contracts: DataFrame, user: str, start: str | None = None, end: str | None = None, live: bool = False, reveal: bool = False, now: Column | None = None) -> DataFrame:
    """One stored report of a user's history: (report_id, address, ..., tx_count, tx_data), tx_data being JSON of its
    transactions, balances and groups. A live report has no upper date."""
    now = now if now is not None else F.current_timestamp()
    rows = history.fill_siblings(history.parse_actions(actions, contracts))
    if start:
        rows = history.in_dates(rows, "date", F.lit(start), None)
    if end and not live:
        rows = rows.filter(~text.missing(F.col("date")) & (F.col("date") <= end))
    cells = [c for c in rows.columns if c != "seq"]
    listed = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*[F.col(f"`{c}`") for c in cells]).alias("t")))), lambda x: x["t"]).alias("transactions"), F.count("*").cast("int").alias("tx_count"))
    groups = history.grouped(rows, F.lit(user), contracts)
    grouped = groups.agg(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", F.struct("primary", "subActions", "internalCount", "txID").alias("g")))), lambda x: x["g"]).alias("groups"))
    held = portfolio.merged_balances(balances).agg(F.collect_list(F.struct("asset", "amount")).alias("balances"))
    one = listed.join(F.broadcast(grouped), F.lit(True)).join(F.broadcast(held), F.lit(True))
    when = lambda x: F.lit(x).cast("timestamp")
    return one.select(
        exports.public_id(F.lit(user), now.cast("string")).alias("report_id"),
        F.lit(user).alias("address"),
        when(start).alias("date_from"),
        when(end).alias("date_to"),
        F.lit(live).alias("include_new"),
        F.lit(reveal).alias("reveal_wallet"),
        "tx_count",
        F.to_json(F.struct("transactions", "balances", "groups"), {"ignoreNullFields": "false"}).alias("tx_data"),
        now.alias("created_at"),
    )


#: Transactions or groups of one page of a report.
PAGE = 500


def history_reports(actions: DataFrame, contracts: DataFrame, user: str = "user", start: str | None = None, end: str | None = None, live: bool = False, reveal: bool = False, now: Column | None = None, size: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """Reports of all users at once, from actions with the column `user`: the reports (report_id, address, ..., tx_count,
    group_count, pages) and their pages (address, kind, page, rows, data), data being JSON of at most `size` transactions or
    groups in order. No task holds more of a history than a page, however long it is."""
    now = now if now is not None else F.current_timestamp()
    rows = history.fill_siblings(history.parse_actions(actions, contracts, user), within=(user,))
    if start:
        rows = history.in_dates(rows, "date", F.lit(start), None)
    if end and not live:
        rows = rows.filter(~text.missing(F.col("date")) & (F.col("date") <= end))
    rows = storage.stored(rows, "report-rows")
    # numbering reads its rows twice, to find the ranges and to deal them
    groups = storage.stored(history.grouped(rows, F.col(user), contracts, (user,)), "report-groups")
    cells = [c for c in rows.columns if c not in ("seq", user)]
    kinds = (("transactions", rows, "seq", F.struct(*[F.col(f"`{c}`") for c in cells])), ("groups", groups, "first_seq", F.struct("primary", "subActions", "internalCount", "txID")))
    pages = None
    for kind, part, order, cell in kinds:
        made = relational.numbered(part.select(user, order, cell.alias("cell")), [order], (user,))
        made = made.groupBy(F.col(user).alias("address"), F.floor(F.col("index") / size).cast("int").alias("page")).agg(F.count("*").alias("rows"), F.transform(F.sort_array(F.collect_list(F.struct(order, "cell"))), lambda x: x["cell"]).alias("cells"))
        made = made.select("address", F.lit(kind).alias("kind"), "page", "rows", F.to_json("cells", {"ignoreNullFields": "false"}).alias("data"))
        pages = made if pages is None else pages.unionByName(made)
    pages = storage.stored(pages, "report-pages")
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rows"))), F.lit(0))
    when = lambda x: F.lit(x).cast("timestamp")
    reports = pages.groupBy("address").agg(count("transactions").alias("tx_count"), count("groups").alias("group_count"), F.count("*").alias("pages"))
    reports = reports.select(exports.public_id(F.col("address"), now.cast("string")).alias("report_id"), "address", when(start).alias("date_from"), when(end).alias("date_to"), F.lit(live).alias("include_new"), F.lit(reveal).alias("reveal_wallet"), "tx_count", "group_count", "pages", now.alias("created_at"))
    return reports, pages


def shown_report(reports: DataFrame, asked: str) -> DataFrame:
    """A stored report as it is shown: the address only where it may be, the transactions and groups of its JSON."""
    tx = "struct<type:string,date:string,assetIn:string,amountIn:string,assetOut:string,amountOut:string,txID:string>"
    return by_public_id(reports, "report_id", asked).select("report_id", F.when(F.col("reveal_wallet"), F.col("address")).alias("address"), "tx_count", nested.report_payload(F.col("tx_data"), tx).alias("data"), "created_at")


def add_manual_flag(flags: DataFrame, entries: DataFrame, users: DataFrame, edges: DataFrame, address: str, chain: str | None, reason: str, by: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flags, entries and users after a manual flag: users with that address, or of that name, are flagged at once."""
    listed = address.lower() if chain in text.LOWER_MANUAL else address
    one = flags.sparkSession.range(1).select(F.lit(listed).alias("address"), F.lit(chain).cast("string").alias("chain"), F.lit(reason).alias("reason"), F.lit(by).alias("added_by"), now.alias("added_at"), F.lit(True).alias("active"))
    made = relational.with_new_ids(flags, one, ["address"])
    entry = one.select("address", "chain", F.lit("MANUAL").alias("source"), F.lit(reason).alias("entity_name"), F.lit(f"Manual flag by {by}").alias("reason"), now.alias("added_at"), now.alias("last_seen"))
    linked = edges.filter(F.col("l1_address") == listed).select("thor_address").distinct().withColumn("__linked", F.lit(f"MANUAL: {reason} ({listed[:16]}...)"))
    why = F.coalesce(F.when(F.col("thor_address") == listed, f"MANUAL: {reason}"), F.col("__linked"))
    hit = users.join(linked, "thor_address", "left")
    marked = hit.withColumns({"flagged": F.when(why.isNotNull(), True).otherwise(F.col("flagged")), "flag_reason": F.coalesce(why, "flag_reason"), "screened_at": F.when(why.isNotNull(), now).otherwise(F.col("screened_at"))})
    return flags.unionByName(made.select(*flags.columns)), entries.select(*ENTRY).unionByName(entry), marked.select(*users.columns)


def remove_manual_flag(flags: DataFrame, entries: DataFrame, flag_id: int) -> tuple[DataFrame, DataFrame]:
    """Flags and entries after one flag was taken back: the flag stays, inactive; its entry goes."""
    gone = flags.filter(F.col("id") == flag_id).select("address", F.lit("MANUAL").alias("source"))
    return relational.soft_delete(flags, F.col("id") == flag_id), relational.delete_keys(entries, gone, ["address", "source"])


def recent_transactions(transactions: DataFrame, limit: int = 50, memo_type: str | None = None) -> DataFrame:
    """The newest transactions, of one kind if asked for."""
    return relational.newest(relational.where_all(transactions, [None if memo_type is None else F.col("memo_type") == memo_type]), ["timestamp", "id"], limit)
