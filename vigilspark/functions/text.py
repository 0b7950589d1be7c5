"""Text functions on columns: assets, chains, addresses, coin lists, flag reasons, truncation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark.functions import nested

# Chains that prefix an asset in the two-part form.
ASSET_CHAINS = ("ETH", "BTC", "AVAX", "BSC", "BASE", "GAIA", "TRON", "DOGE", "LTC", "BCH", "XRP", "SOL", "TERRA", "BNB", "THOR")

# The chains whose addresses ignore case, for each of the places that normalise one.
LOWER_SCREENING = ("ETH", "BSC", "ARB")
LOWER_SANCTIONS = ("ETH", "USDT", "USDC", "ARB", "BSC")
LOWER_FEEDS = ("ETH",)
LOWER_MANUAL = ("ETH", "BSC", "ARB", "BASE", "AVAX")

# Addresses in free text.
ADDRESS_PATTERNS = {
    "ETH": r"\b0x[a-fA-F0-9]{40}\b",
    "BTC": r"\b(?:bc1[a-zA-HJ-NP-Z0-9]{25,39}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b",
    "TRX": r"\bT[a-zA-Z0-9]{33}\b",
}


def missing(x: Column) -> Column:
    """Whether a value is null or the empty string."""
    return x.isNull() | (x.cast("string") == "")


def or_default(x: Column, default: Column | str) -> Column:
    """The value, or a default for null and the empty string."""
    return F.coalesce(F.nullif(x, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def _last(x: Column, separator: str) -> Column:
    return F.substring_index(x, separator, -1)


def clean_asset(asset: Column) -> Column:
    """The ticker of an asset or denomination, in upper case (history rule)."""
    bare = _last(_last(_last(F.regexp_replace(asset, "^[xX]/", ""), "/"), "~"), ".")

    def ticker(part: Column) -> Column:
        one, two, n = F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.size(part)
        head, tail = F.upper(one), F.upper(two)
        ticker_second = (F.length(two) <= 6) & ~two.rlike("^[0-9a-fA-F]+$")
        pair = F.when((F.length(two) > 6) | two.rlike("^0[xX]"), head).when(head.isin(*ASSET_CHAINS) & (head != tail), tail).otherwise(head)
        junk = head.startswith("0X") | (head.startswith("THOR1") & (F.length(head) > 10)) | head.rlike("^[A-F0-9]{21,}$")
        return F.when(n >= 3, F.when(ticker_second, tail).otherwise(head)).when(n == 2, pair).otherwise(F.when(junk, "").otherwise(head))

    return F.when(missing(asset), "").when(F.lower(asset).isin("rune", "thor.rune"), "RUNE").otherwise(nested.let(F.split(bare, "-"), ticker))


def short_asset(asset: Column) -> Column:
    """The ticker by the shorter rule (valuation and live feed): the second part after the first separator kind found."""
    bare = F.coalesce(*[F.when(asset.contains(s), F.get(F.split(asset, p), F.lit(1))) for s, p in (("~", "~"), ("/", "/"), (".", r"\."))], asset)
    part = F.split(bare, "-")
    one, two, n = F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.size(part)
    return F.when(missing(asset), "").when(n >= 3, two).when((n == 2) & (F.length(two) <= 6) & (one != two), two).otherwise(one)


def chain_of_asset(asset: Column) -> Column:
    """The chain that an asset names; UNKNOWN where there is none."""
    separator = F.when(asset.contains("."), ".").when(asset.contains("~"), "~").when(asset.contains("/"), "/").otherwise("-")
    return F.when(missing(asset), "UNKNOWN").otherwise(or_default(F.split_part(asset, separator, F.lit(1)), "UNKNOWN"))


def chain_of_address(address: Column, terra: bool = True) -> Column:
    """The chain of an address by prefix, alphabet and length; null where none fits. Some callers don't know terra."""
    size = F.length(address)
    rules = [
        ("THOR", address.startswith("thor")),
        ("GAIA", address.startswith("cosmos")),
        *([("TERRA", address.startswith("terra"))] if terra else []),
        ("BTC", address.startswith("bc1") | address.rlike("^[13][a-km-zA-HJ-NP-Z1-9]{25,}$")),
        ("LTC", address.startswith("ltc1") | address.rlike("^[LM][a-km-zA-HJ-NP-Z1-9]{25,}$")),
        ("BNB", address.startswith("bnb")),
        ("ETH", address.startswith("0x") & (size == 42)),
        ("XRP", address.startswith("r") & size.between(25, 35)),
        ("DOGE", address.startswith("D") & (size == 34)),
        ("BCH", address.startswith("bitcoincash:") | (address.startswith("q") & (size >= 42))),
        ("TRX", address.startswith("T") & (size == 34)),
    ]
    return F.coalesce(*[F.when(test, chain) for chain, test in rules])


def normalize_address(address: Column, chain: Column, lower: Iterable[str] = LOWER_SCREENING) -> Column:
    """Lower case for the chains whose addresses ignore it."""
    return F.when(chain.isin(*lower), F.lower(address)).otherwise(address)


def lower_hex(address: Column) -> Column:
    """Lower case for 0x addresses, whatever the chain."""
    return F.when(address.startswith("0x"), F.lower(address)).otherwise(address)


def addresses_in(text: Column, patterns: dict[str, str] = ADDRESS_PATTERNS) -> Column:
    """array<struct<chain, address>>: every address in free text, pattern by pattern."""

    def of(chain: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a: F.struct(F.lit(chain).alias("chain"), a.alias("address")))

    return F.flatten(F.array(*[of(chain, p) for chain, p in patterns.items()]))


COIN = r"^(\d+)(.+)$"


def coin_list(text: Column, clean: bool = True) -> Column:
    """array<struct<amount, asset>> of "123denom,45x"; parts that aren't a number and a name are left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p.rlike(COIN))
    asset = (lambda p: clean_asset(F.regexp_extract(p, COIN, 2))) if clean else (lambda p: F.regexp_extract(p, COIN, 2))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, COIN, 1).alias("amount"), asset(p).alias("asset")))


def coin(text: Column) -> Column:
    """struct<amount, asset> of one "123denom"; null where the text isn't one."""
    t = F.trim(text)
    return F.when(t.rlike(COIN), F.struct(F.regexp_extract(t, COIN, 1).alias("amount"), clean_asset(F.regexp_extract(t, COIN, 2)).alias("asset")))


# What the names of pair contracts start with.
PAIR_PREFIXES = r"^(?:RUJI Trade |XYK Pool: )"


def other_side(asset_in: Column, contract_name: Column) -> Column:
    """The other asset of a pair contract's name; empty where the asset isn't of the pair."""
    pair = F.regexp_replace(contract_name, PAIR_PREFIXES, "")
    side = lambda k: F.when(pair.contains("/"), F.regexp_extract(pair, r"^(.+)/([^/]*)$", k)).otherwise(F.regexp_extract(pair, r"^(.+)-([^-]*)$", k))
    ticker = lambda x: F.upper(F.regexp_replace(x, r"^([^.]+)\..*$", "$1"))
    base, quote = ticker(side(1)), ticker(side(2))
    named = contract_name.rlike(PAIR_PREFIXES) & pair.rlike("^.+[-/]")
    return F.when(named & (F.upper(asset_in) == base), quote).when(named & (F.upper(asset_in) == quote), base).otherwise("")


def middle_cut(address: Column, head: int, tail: int, over: int = 0) -> Column:
    """Head and tail of a long text around "..."."""
    return F.when(F.length(address) > max(over, 0), F.concat(F.left(address, F.lit(head)), F.lit("..."), F.right(address, F.lit(tail)))).otherwise(address)


def end_cut(text: Column, most: int) -> Column:
    """The first characters, with "..." where there are more."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def flag_reasons(reason: Column) -> Column:
    """array<struct<source, address, text>> of "SRC: entity (addr); ..."."""
    parts = F.filter(F.transform(F.split(F.coalesce(reason, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")

    def parsed(p: Column) -> Column:
        source = F.when(p.contains(":"), F.trim(F.split_part(p, F.lit(":"), F.lit(1)))).otherwise("UNKNOWN")
        return F.struct(or_default(source, "UNKNOWN").alias("source"), F.regexp_extract(p, r"\(([^)]+)\)\s*$", 1).alias("address"), p.alias("text"))

    return F.transform(parts, parsed)


def flagged_addresses(reason: Column) -> Column:
    """The distinct addresses of a flag's reasons, in lower case."""
    return F.array_distinct(F.filter(F.transform(flag_reasons(reason), lambda r: F.lower(r["address"])), lambda a: a != ""))


def quoted(x: Column) -> Column:
    """A CSV cell, always in quotes."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


# Places of incidents and entities, by what the name contains, first match first.
INCIDENT_PLACES = (
    ("Lazarus Group", 39.0392, 125.7625),
    ("Bybit Hack", 39.0392, 125.7625),
    ("Ronin Bridge", 39.0392, 125.7625),
    ("Harmony Horizon", 39.0392, 125.7625),
    ("KuCoin Hack", 39.0392, 125.7625),
    ("Atomic Wallet", 39.0392, 125.7625),
    ("Stake.com", 39.0392, 125.7625),
    ("Nomad Bridge", 37.7749, -122.4194),
    ("WazirX", 19.076, 72.8777),
    ("Tornado Cash", 52.3676, 4.9041),
    ("Iran", 35.6892, 51.389),
    ("Syria", 33.5138, 36.2765),
    ("Cuba", 23.1136, -82.3666),
    ("North Korea", 39.0392, 125.7625),
    ("Russia", 55.7558, 37.6173),
    ("Venezuela", 10.4806, -66.9036),
)


def incident_place(name: Column, places: Iterable[tuple[str, float, float]] = INCIDENT_PLACES) -> Column:
    """struct<lat, lng> of the first place whose key the name contains, whatever the case; null where there is none."""
    return F.coalesce(*[F.when(F.lower(name).contains(k.lower()), F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng"))) for k, a, b in places])
