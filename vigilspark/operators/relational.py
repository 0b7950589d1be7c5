"""Relational building blocks: merges, deduplication, lookups, paging, as-of joins.

Each function takes and returns DataFrames and stays lazy. Keys meet through hash-partitioned joins or aggregates with
map-side combining; where one side is small Spark broadcasts it by its own size estimate.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.sources import storage


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. The order should be total."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, nulls first among the latest."""
    return first_wins(df, keys, [F.desc_nulls_first(c) for c in order])


def last_value(df: DataFrame, keys: list[str], value: str, order: list[str], name: str | None = None) -> DataFrame:
    """The value of the row with the greatest order for each key (last writer wins); one aggregate, no sort."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name or value))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """The target and those rows whose key it lacks; of several new rows with one key, the first."""
    fresh = first_wins(rows, keys, order) if order else rows.dropDuplicates(keys)
    return target.unionByName(fresh.join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: Iterable[str]) -> DataFrame:
    """Merges `rows` (one for each key) into `target`: on a match only the `update` columns change."""
    change = set(update)
    old, new = target.alias("old"), rows.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    joined = old.withColumn("__old", F.lit(True)).alias("old").join(new.withColumn("__new", F.lit(True)).alias("new"), on, "full_outer")
    is_new, is_old = F.col("new.__new").isNotNull(), F.col("old.__old").isNotNull()
    return joined.select(*[F.when(is_new & (~is_old | F.lit(c in change)), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in target.columns])


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_by_key(target: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sets `values` in the target rows whose key is in `rows` (one for each key)."""
    new = rows.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__hit"))
    joined = target.join(new, keys, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def delete_keys(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(rows.select(*keys), keys, "left_anti")


def soft_delete(target: DataFrame, condition: Column, flag: str = "active") -> DataFrame:
    return update_where(target, condition, {flag: F.lit(False)})


def numbered(rows: DataFrame, order: list[Column | str], keys: tuple[str, ...] = (), name: str = "index") -> DataFrame:
    """Rows with their place (from 0) among those of their keys, without a gap.

    Rows are dealt by ranges of keys and order, sorted and written with their place in their part; a row's number is that
    place and the sizes of its key's parts before. Counting and numbering read the same files, so neither another sample
    of the ranges nor adaptive execution can part them differently. A hot key takes many parts, and so do equal rows.
    """
    spare = F.xxhash64(F.monotonically_increasing_id())
    by = [*keys, *order, "__spare"]
    dealt = rows.withColumn("__spare", spare).repartitionByRange(*by).sortWithinPartitions(*by).drop("__spare")
    held = storage.stored(dealt.withColumn("__place", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__place", 33))
    # one row for each part and key
    before = F.sum("__n").over((Window.partitionBy(*keys) if keys else Window).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = held.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    parts = storage.stored(parts.select(*keys, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift")), "numbered-parts")
    on = F.col("l.__part") == F.col("r.__part")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    met = held.alias("l").join(parts.alias("r"), on)
    return met.select(*[F.col(f"l.`{c}`") for c in rows.columns], (F.col("l.__place") + F.col("r.__shift")).alias(name))


def with_new_ids(target: DataFrame, rows: DataFrame, order: list[Column | str], name: str = "id") -> DataFrame:
    """Rows numbered on from the target's greatest id, without a gap."""
    start = target.agg(F.coalesce(F.max(name), F.lit(0)).cast("bigint")).first()[0]
    return numbered(rows, order, (), "__index").withColumn(name, F.col("__index") + F.lit(start + 1)).drop("__index")


def holders(rows: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    """The rows that have at least one partner."""
    return rows.join(others.select(F.col(other_key).alias(key)), key, "left_semi")


def unseen(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(known.select(*keys), keys, "left_anti")


def with_fallback(first_choice: DataFrame, second_choice: DataFrame) -> DataFrame:
    """The second result where the first is empty; one plan, decided when it runs."""
    any_first = first_choice.select(F.lit(1).alias("__any")).limit(1)
    return first_choice.unionByName(second_choice.join(F.broadcast(any_first), F.col("__any") == F.lit(1), "left_anti"))


def nested_left(rows: DataFrame, others: DataFrame, key: str, fields: list[str], name: str, order: list[str] | None = None) -> DataFrame:
    """Rows with the sorted array of their partners' fields; an empty array where there is none."""
    made = others.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(*(order or fields), *[f for f in fields if order and f not in order]))).alias(name))
    kind = made.schema[name].dataType.simpleString()
    return rows.join(made, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def page(df: DataFrame, order: list[Column | str], number: int, size: int = 50) -> DataFrame:
    """Page `number` (from 1)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def newest(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The k latest rows, nulls first as a descending sort in PostgreSQL has them."""
    return df.orderBy(*[F.desc_nulls_first(c) for c in order]).limit(k)


def search_filter(pattern: str) -> str:
    """A LIKE pattern for a substring; wildcards in the input keep their meaning."""
    return f"%{pattern}%"


def where_all(df: DataFrame, conditions: Iterable[Column | None]) -> DataFrame:
    """Filters by those conditions that are given."""
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def as_of(rows: DataFrame, history: DataFrame, keys: list[str], at: str, ts: str, values: list[str], span: int = 3600) -> DataFrame:
    """Each row with the values of its key's last history row at or before `at` (of equal times, the greatest values).

    Time is cut into buckets of `span` seconds, so that a key with most of the rows is dealt over many tasks. Each key's
    buckets are summed up to their last history row; what is last before a bucket is carried into it as a row at its
    start, and inside a bucket the last history row is carried forward. A null key has no history.
    """
    bucket = lambda c: F.floor(F.col(c).cast("timestamp").cast("double") / span)
    left = rows.withColumns({"__t": F.col(at), "__side": F.lit(2), "__row": F.struct(*rows.columns)})
    right = where_all(history, [F.col(c).isNotNull() for c in [*keys, ts]]).withColumns({"__t": F.col(ts), "__side": F.lit(1), "__value": F.struct(*values)})
    both = left.select(*keys, "__t", "__side", "__row").unionByName(right.select(*keys, "__t", "__side", "__value"), allowMissingColumns=True).withColumn("__bucket", bucket("__t"))
    order = F.struct("__t", "__value")
    ends = both.groupBy(*keys, "__bucket").agg(F.max_by("__value", F.when(F.col("__side") == 1, order)).alias("__value"))
    carried = ends.withColumn("__value", F.last("__value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).filter("__value is not null")
    whole = both.unionByName(carried.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy(*keys, "__bucket").orderBy(F.col("__side") > 0, "__t", "__side", *[F.col(f"__value.{v}") for v in values]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return whole.withColumn("__last", F.last("__value", ignorenulls=True).over(by)).filter("__side = 2").select("__row.*", *[F.col(f"__last.{v}").alias(f"asof_{v}") for v in values])


def bag_union(first_: DataFrame, *more: DataFrame) -> DataFrame:
    for m in more:
        first_ = first_.unionByName(m)
    return first_


def count_of(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))
