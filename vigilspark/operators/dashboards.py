"""Counts, status summaries and listings behind dashboards. The reference time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import times


def counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row of filtered counts, from one scan."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def recent(df: DataFrame, ts: str, now: Column, windows: dict[str, str]) -> DataFrame:
    """Rows newer than each interval before `now`."""
    return counts(df, {name: times.within(F.col(ts), now, interval) for name, interval in windows.items()})


def distinct_pairs(df: DataFrame, a: str, b: str, condition: Column | None = None) -> Column:
    """Distinct "a:b" pairs; a pair with a null part doesn't count."""
    pair = F.concat(F.col(a).cast("string"), F.lit(":"), F.col(b).cast("string"))
    return F.count_distinct(pair if condition is None else F.when(condition, pair))


def by_group(df: DataFrame, key: str, default: str | None = None, name: str = "n") -> DataFrame:
    """Rows by group, the largest first; null keys under a default name."""
    k = F.col(key) if default is None else F.coalesce(F.col(key), F.lit(default))
    return df.groupBy(k.alias(key)).agg(F.count("*").alias(name)).orderBy(F.desc(name), key)


def as_map(groups: DataFrame, key: str, value: str) -> DataFrame:
    """One row with the groups as a map."""
    return groups.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("counts"))


def status(log: DataFrame, key: str, ts: str, tiebreak: str, latest: list[str]) -> DataFrame:
    """For each type the runs, the last time, and columns of the last run; one aggregate."""
    order = F.struct(ts, tiebreak)
    return log.groupBy(key).agg(F.count("*").alias("runs"), F.max(ts).alias("last_at"), *[F.max_by(c, order).alias(f"last_{c}") for c in latest])


def with_totals(page: DataFrame, all_rows: DataFrame) -> DataFrame:
    """A page with the filtered total beside it; the total is one row."""
    return page.join(F.broadcast(all_rows.agg(F.count("*").alias("total"))), F.lit(True), "left")


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total + 0.5).cast("int")).otherwise(0)


def minutes_left(rows: Column, batch: int = 100, minutes: int = 10) -> Column:
    return (F.ceil(rows / batch) * minutes).cast("bigint")
