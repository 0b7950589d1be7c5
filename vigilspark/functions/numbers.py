"""Number functions on columns: fixed-point amounts, display forms, prices.

Fixed decimals are rounded half up on exact decimals, so a tie may differ by one unit in the last place from a display
that rounds the binary value.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT = 100_000_000  # amounts are integers of 1e-8


def int_prefix(text: Column) -> Column:
    """The integer that a text starts with (decimal(38,0)); null where there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("decimal(38,0)")


def amount(raw: Column) -> Column:
    """A fixed-point amount as decimal(37,8); text counts up to its first non-digit."""
    return (int_prefix(raw.cast("string")).try_cast("decimal(29,0)") * F.lit(f"{1 / UNIT:.8f}").cast("decimal(8,8)")).cast("decimal(37,8)")


def fixed(x: Column, places: int) -> Column:
    """Text with a fixed number of decimals."""
    return x.cast(f"decimal(38,{places})").cast("string") if places else x.cast("decimal(38,0)").cast("string")


def scaled(x: Column, digits: int, places: int) -> Column:
    """Text of a decimal over 10**digits with a fixed number of decimals, rounded once: the quotient itself would be rounded
    to what its type holds before."""
    return fixed(F.round(x, places - digits) / 10**digits, places)


def without_zeros(x: Column) -> Column:
    """Decimal text without trailing zeros or dot."""
    return F.when(x.contains("."), F.rtrim(F.rtrim(x, F.lit("0")), F.lit("."))).otherwise(x)


def raw_amount(raw: Column) -> Column:
    """A fixed-point amount as exact text of up to 8 decimals; 0 where there is none."""
    return exact_amount(amount(raw))


def exact_amount(x: Column) -> Column:
    """raw_amount of an amount that is read already."""
    return F.coalesce(without_zeros(fixed(x, 8)), F.lit("0"))


def format_amount(raw: Column) -> Column:
    """The display form of a fixed-point amount: k over 10000, then 2, 4, 6 or 8 decimals by size."""
    return shown_amount(amount(raw))


def shown_amount(x: Column) -> Column:
    """format_amount of an amount that is read already."""
    return (
        F.when(x.isNull() | (x == 0), "0")
        .when(x > 10000, F.concat(scaled(x, 3, 1), F.lit("k")))
        .when(x > 1, fixed(x, 2))
        .when(x > F.lit("0.001").cast("decimal(10,8)"), fixed(x, 4))
        .when(x > F.lit("0.000001").cast("decimal(10,8)"), fixed(x, 6))
        .otherwise(without_zeros(fixed(x, 8)))
    )


def compact(x: Column, separators: bool = True) -> Column:
    """Millions and thousands with one decimal, smaller numbers in full."""
    d = x.cast("decimal(38,8)")
    small = F.format_number(x.cast("bigint"), 0) if separators else x.cast("bigint").cast("string")
    return F.when(d >= 1_000_000, F.concat(scaled(d, 6, 1), F.lit("M"))).when(d >= 1000, F.concat(scaled(d, 3, 1), F.lit("k"))).otherwise(small)


def usd(x: Column) -> Column:
    """$0, millions and thousands with one decimal, else two decimals."""
    d = x.cast("decimal(38,8)")
    short = F.when(d >= 1_000_000, F.concat(scaled(d, 6, 2), F.lit("M"))).when(d >= 1000, F.concat(scaled(d, 3, 1), F.lit("k"))).otherwise(fixed(d, 2))
    return F.when(x.isNull() | (x == 0), "$0").otherwise(F.concat(F.lit("$"), short))


def significant(x: Column, places: int = 2) -> Column:
    """A fixed number of decimals; below 0.01 as many as show three significant digits."""
    need = F.greatest(F.lit(places), -F.floor(F.log10(x)).cast("int") + 2)
    small = F.coalesce(*[F.when(need == n, fixed(x.cast("decimal(38,18)"), n)) for n in range(places, 19)], fixed(x.cast("decimal(38,18)"), 18))
    return F.when((x > 0) & (x < 0.01), small).otherwise(fixed(x.cast("decimal(38,18)"), places))


def live_amount(x: Column) -> Column:
    """The live feed's display form; empty for dust."""
    d = x.cast("decimal(38,8)")
    k = lambda n: F.concat(scaled(d, 3, n), F.lit("k"))
    return F.when(d > 10000, k(0)).when(d > 1000, k(1)).when(d > 1, fixed(d, 1)).when(d > F.lit("0.01").cast("decimal(10,8)"), fixed(d, 3)).otherwise("")


def duration(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with one decimal."""
    return F.when(ms.isNull() | (ms == 0), "-").when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms"))).otherwise(F.concat(fixed(ms.cast("decimal(20,3)") / 1000, 1), F.lit("s")))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def percent_change(now: Column, before: Column) -> Column:
    """Null where there is no positive base."""
    return F.when(before > 0, (now - before) / before * 100)


def volume_from_fees(fees: Column, points: Column) -> Column:
    """The volume that fees at a rate in basis points imply; null at rate 0."""
    return F.when(points > 0, fees / (points / 10000))


def pages(total: Column, size: int) -> Column:
    return F.ceil(total / size)


def round_half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


@F.pandas_udf(StringType())
def to_fixed(x: pd.Series, places: pd.Series) -> pd.Series:
    """Fixed decimals of the exact binary value, ties away from zero: for byte parity with displays that round so."""
    return pd.Series([None if v is None or v != v else str(Decimal(float(v)).quantize(Decimal(1).scaleb(-int(n)), rounding=ROUND_HALF_UP)) for v, n in zip(x, places, strict=True)])
