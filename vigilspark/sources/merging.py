"""Merges into stored tables that read and rewrite only what they touch.

A table is partitioned by a hash of its keys and, within, bucketed and sorted by them. A merge reads the partitions that its
rows fall into (their numbers are at most the table's number of parts), joins them with the rows bucket by bucket, so that
only the rows are shuffled, and replaces those partitions; the others aren't read. New files are staged and moved at the end,
so a merge that fails before leaves the table as it was. One merge at a time; merges may run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.operators import relational
from vigilspark.sources import storage

PART = "part_"
#: The most rows on average that a bucket has over all partitions when a table is made: a merge's task holds one bucket.
BUCKET_ROWS = 1_000_000
_MODE = "spark.sql.sources.partitionOverwriteMode"


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias(PART)


class StoredTable:
    """A keyed table in the session's catalog, stored in a folder that all executors share."""

    def __init__(self, spark: SparkSession, name: str, keys: list[str], parts: int = 64, buckets: int = 8) -> None:
        self.spark, self.name, self.keys, self.parts, self.buckets = spark, name, keys, parts, buckets

    def create(self, rows: DataFrame, path: str | None = None) -> StoredTable:
        """Stores `rows`, one for each key. parts and buckets fix how finely later merges can touch the table; there are
        more buckets than asked for where a bucket would have more than BUCKET_ROWS rows."""
        self.buckets = max(self.buckets, -(-rows.count() // BUCKET_ROWS))
        path = path or storage.fresh_folder(self.spark, self.name)
        dealt = rows.select(*rows.columns, part_of(self.keys, self.parts)).repartition(self.buckets, *self.keys)
        dealt.write.partitionBy(PART).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", path).saveAsTable(self.name)
        return self

    def read(self, parts: list[int] | None = None) -> DataFrame:
        rows = self.spark.table(self.name)
        return (rows if parts is None else rows.filter(F.col(PART).isin(parts))).drop(PART)

    def rewrite(self, rows: DataFrame, made: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the partitions that `rows` fall into by what `made` makes of them and the rows; their numbers."""
        rows = storage.stored(rows, "merged-rows")
        touched = sorted(r[0] for r in rows.select(part_of(self.keys, self.parts)).distinct().collect())
        if not touched:
            return touched
        old = self.read(touched)
        new = made(old, rows).select(*old.columns).withColumn(PART, part_of(self.keys, self.parts))
        before = self.spark.conf.get(_MODE, "static")
        self.spark.conf.set(_MODE, "dynamic")
        try:
            new.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(_MODE, before)
        return touched

    def upsert(self, rows: DataFrame, update: Iterable[str]) -> list[int]:
        """Merges rows (one for each key): of known keys only the `update` columns change."""
        update = list(update)
        return self.rewrite(rows, lambda old, new: relational.upsert(old, new, self.keys, update))

    def insert_ignore(self, rows: DataFrame, order: list[Column | str]) -> list[int]:
        """Adds the rows of unknown keys; of several new rows with one key, the first by `order`."""
        return self.rewrite(rows, lambda old, new: relational.insert_ignore(old, new, self.keys, order))

    def update(self, rows: DataFrame, values: list[str]) -> list[int]:
        """Sets `values` in the table's rows whose key is in `rows` (one for each key)."""
        return self.rewrite(rows, lambda old, new: relational.update_by_key(old, new, self.keys, values))

    def delete(self, rows: DataFrame) -> list[int]:
        """Removes the rows of these keys; partitions that this empties are dropped, as no row would replace them."""
        left = lambda old, new: relational.delete_keys(old, new, self.keys)
        emptied = self._emptied(rows, left)
        touched = self.rewrite(rows, left)
        for p in emptied:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({PART} = {p})")
        return touched

    def _emptied(self, rows: DataFrame, left: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        touched = [r[0] for r in rows.select(part_of(self.keys, self.parts)).distinct().collect()]
        kept = {r[0] for r in left(self.read(touched), rows).select(part_of(self.keys, self.parts)).distinct().collect()}
        return [p for p in touched if p not in kept]
