"""Date and time functions on columns. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Milliseconds on either side of the epoch that dates reach.
MOST_MS = 8_640_000_000_000_000


def from_nanos(text: Column) -> Column:
    """The timestamp of an epoch-nanosecond text, to the millisecond; null where it isn't a whole number or no time has it."""
    nanos = F.when(F.length(text) <= 18, text.try_cast("bigint"))
    short = F.call_function("div", nanos - F.pmod(nanos, F.lit(1_000_000)), F.lit(1_000_000))
    wide = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("decimal(38,0)"))
    far = F.floor(wide / 1_000_000).try_cast("bigint")
    millis = F.coalesce(short, far)
    return F.timestamp_millis(F.when(F.abs(millis) <= MOST_MS, millis))


def iso(ts: Column) -> Column:
    """yyyy-mm-ddThh:mm:ss.mmmZ, in UTC sessions; a year beyond 9999 has as many digits as it needs, and no sign."""
    return F.ltrim(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("+"))


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def long_day(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def seconds_between(ts: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", ts, now)


def time_ago(ts: Column, now: Column, style: str = "full") -> Column:
    """A coarse age. full: seconds to days; plain: "Just now" below a minute; hours: no days; short: now, s, m, h."""
    s = seconds_between(ts, now)
    unit = lambda by, name: F.concat(F.floor(s / by).cast("string"), F.lit(name))
    if style == "short":
        return F.when(s < 5, "now").when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).otherwise(unit(3600, "h"))
    first = F.when(s < 60, unit(1, "s ago")) if style == "full" else F.when(s < 60, "Just now")
    rest = first.when(s < 3600, unit(60, "m ago"))
    return rest.otherwise(unit(3600, "h ago")) if style == "hours" else rest.when(s < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def within(ts: Column, now: Column, interval: str) -> Column:
    """Whether a time lies after now minus an interval such as "24 HOURS"."""
    return ts > now - F.expr(f"INTERVAL {interval}")
