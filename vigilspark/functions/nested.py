"""Functions on arrays, maps, JSON and binary text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first(xs: Column, default: Column | None = None) -> Column:
    """The first element, or a default where there is none."""
    got = F.get(xs, F.lit(0))
    return got if default is None else F.coalesce(got, default)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` over a value that is computed once, however often `then` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lookup(mapping: Column, key: Column, default: Column | None = None) -> Column:
    got = F.try_element_at(mapping, key)
    return got if default is None else F.coalesce(got, default)


def attribute(attributes: Column, key: str) -> Column:
    """The value of a key in array<struct<key, value>>; the last one wins."""
    return F.try_element_at(F.filter(attributes, lambda a: a["key"] == key), F.lit(-1))["value"]


BASE64 = r"^[A-Za-z0-9+/]+={0,2}$"
PRINTABLE = r"^[\x20-\x7E]+$"


def maybe_base64(text: Column) -> Column:
    """Decoded base64 where the text has its alphabet and length and decodes to printable text; else the text itself."""
    decoded = F.decode(F.try_to_binary(text, F.lit("base64")), "ISO-8859-1")
    printable = let(decoded, lambda d: F.when(d.rlike(PRINTABLE), d))
    return F.coalesce(F.when((F.length(text) % 4 == 0) & text.rlike(BASE64), printable), text)


def base64_json(text: Column, schema: str) -> Column:
    """A struct from base64 JSON; null where it isn't that."""
    return F.from_json(F.try_to_binary(text, F.lit("base64")).cast("string"), schema)


def event_address(data: Column) -> Column:
    """The address in the first word of an event log's data (0x and 64 hex digits); null where it is zero or short."""
    word = F.lower(F.substring(data, 27, 40))
    return F.when((F.length(data) >= 66) & (word != "0" * 40), F.concat(F.lit("0x"), word))


def report_payload(text: Column, tx: str) -> Column:
    """struct<transactions, groups> of a stored report, which is an object or, in old reports, a bare array."""
    whole = F.from_json(text, f"struct<transactions:array<{tx}>,groups:array<struct<primary:{tx},subActions:array<{tx}>,internalCount:int,txID:string>>>")
    bare = F.struct(F.from_json(text, f"array<{tx}>").alias("transactions"), F.lit(None).cast(f"array<struct<primary:{tx},subActions:array<{tx}>,internalCount:int,txID:string>>").alias("groups"))
    return F.when(F.ltrim(text).startswith("["), bare).otherwise(whole)


def payload(text: Column) -> Column:
    """A JSON text as a variant, whatever its shape; null where it is no JSON."""
    return F.try_parse_json(text)


def at(value: Column, path: str, kind: str) -> Column:
    """What a variant holds at a path; null where there is nothing or something that isn't of the kind."""
    return F.try_variant_get(value, path, kind)


def report_parts(value: Column) -> Column:
    """struct<transactions, groups, balances> (arrays of variants) of a report of either format, an object or a bare array
    of transactions, without a schema of what they hold."""
    bare = F.schema_of_variant(value).startswith("ARRAY")
    part = lambda name: at(value, f"$.{name}", "array<variant>")
    return F.struct(F.when(bare, at(value, "$", "array<variant>")).otherwise(part("transactions")).alias("transactions"), part("groups").alias("groups"), part("balances").alias("balances"))
