"""Structured Streaming: live transactions, deduplication, windows, work queues."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DoubleType, StructField, StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType, ts: str = "ts", files: int = 10) -> DataFrame:
    """A stream of Parquet files; the event time becomes a timestamp, as watermarks ask."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def unseen(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Each key once while its watermark lasts: bounded state in place of a set of all keys seen."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, ts: str, keys: list[str], size: str, delay: str | None = "1 hour", value: str | None = None) -> DataFrame:
    """Rows (and the sum of a value) by event-time window and keys. No delay: the stream has its watermark already."""
    sums = [F.sum(value).alias("total")] if value else []
    grouped = (stream.withWatermark(ts, delay) if delay else stream).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), *sums)
    return grouped.select(F.col("window.start").alias("start"), *keys, "n", *[F.col("total") for _ in sums])


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything there is now, in micro-batches, into a table in memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Everything there is now, appended as Parquet, exactly once."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def newest_rows(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, order: list[str], keep: int = 30, every: str = "8 seconds") -> StreamingQuery:
    """Polls and hands the newest rows of each micro-batch to a sink."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(batch.orderBy(*[F.desc(c) for c in order]).limit(keep), n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def work_queue(users: DataFrame, done_at: str, key: str, batch: int = 100) -> DataFrame:
    """The next users to be fetched: never fetched, in key order."""
    return users.filter(F.col(done_at).isNull()).orderBy(key).limit(batch)


def mark_done(users: DataFrame, done: DataFrame, key: str, done_at: str, now) -> DataFrame:
    hit = done.select(key).distinct().withColumn("__d", F.lit(True))
    return users.join(hit, key, "left").withColumn(done_at, F.when(F.col("__d"), now).otherwise(F.col(done_at))).drop("__d").select(*users.columns)


def remaining(users: DataFrame, done_at: str) -> DataFrame:
    return users.agg(F.count_if(F.col(done_at).isNull()).alias("remaining"))


def reset(users: DataFrame, key: str, done_at: str, prefix: str) -> DataFrame:
    """Forgets the progress of users whose key starts with a prefix."""
    return users.withColumn(done_at, F.when(F.col(key).startswith(prefix), F.lit(None)).otherwise(F.col(done_at)))


def with_progress(rows: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation | None]:
    """The rows, and counters that Spark fills as they pass, without a pass of their own (rows counts them all).

    A stream has no Observation: its counters come with each batch's progress, under `name` in observedMetrics.
    """
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counters.items()]]
    if rows.isStreaming:
        return rows.observe(name, *counts), None
    seen = Observation(name)
    return rows.observe(seen, *counts), seen


#: Keeps state on the executors' disks and in the checkpoint instead of in their memory.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started within hold their state in RocksDB, with changes alone going to the checkpoint."""
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_batch_folders(folder: str, made: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: batch n replaces folder/batch=n, so that a batch that runs again leaves its rows once."""
    return lambda batch, n: made(batch).write.mode("overwrite").parquet(f"{folder}/batch={n}")


def latest_of(folder: str, order: list[str], keep: int) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: folder/batch=n holds the newest rows of all batches up to n.

    A batch adds its newest rows to those that the batch before left and replaces its own folder, so the folder of the
    last batch is the answer, whatever ran twice; older folders may go.
    """

    def write(batch: DataFrame, n: int) -> None:
        rows = batch
        if n:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/batch={n - 1}"))
        rows.orderBy(*[F.desc(c) for c in order]).limit(keep).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return write


def last_batch(query: StreamingQuery) -> int | None:
    """The number of the last batch that a query's progress tells."""
    done = [p["batchId"] for p in query.recentProgress]
    return max(done) if done else None


class SnapshotGuard(StatefulProcessor):
    """Lets the first snapshot of each interval of a subject pass, whichever batch or run it comes in, with the total that
    its amount has grown by since the first one (`locked`, which never falls)."""

    def __init__(self, ts: str, amount: str, seconds: int, keep_ms: int | None, columns: list[str]) -> None:
        self.ts, self.amount, self.seconds, self.keep_ms, self.columns = ts, amount, seconds, keep_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getMapState("taken", "interval long", "at timestamp", self.keep_ms)
        self.total = handle.getValueState("total", "amount double, locked double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # one row for each interval is held, however many come
        first: dict[int, pd.Series] = {}
        for part in rows:
            part = part.assign(__interval=part[self.ts].astype("datetime64[us]").astype("int64") // (1_000_000 * self.seconds))
            for interval, row in part.sort_values(self.ts, kind="stable").drop_duplicates("__interval").set_index("__interval").iterrows():
                if interval not in first or row[self.ts] < first[interval][self.ts]:
                    first[interval] = row
        before = self.total.get() if self.total.exists() else None
        amount, locked = (before[0], before[1]) if before is not None else (0.0, 0.0)
        out = []
        for interval in sorted(first):
            if self.taken.containsKey((int(interval),)):
                continue
            row = first[interval]
            now = float(row[self.amount]) if pd.notna(row[self.amount]) else amount
            locked += max(0.0, now - amount)
            amount = now
            self.taken.updateValue((int(interval),), (row[self.ts],))
            out.append([*[row[c] for c in self.columns], locked])
        self.total.update((amount, locked))
        if out:
            yield pd.DataFrame(out, columns=[*self.columns, "locked"])

    def close(self) -> None:
        pass


def guarded_snapshots(stream: DataFrame, subject: list[str], ts: str, amount: str, minutes: int = 10, keep_days: int | None = None) -> DataFrame:
    """At most one snapshot an interval and subject, across batches and runs, with `locked`: the growth of the amount from
    one such snapshot to the next, added up. Start the query within `state_on_disk`.

    keep_days: after so long (of the clock) an interval is forgotten, which bounds the state; None keeps all.
    """
    columns = stream.columns
    schema = StructType([*stream.schema.fields, StructField("locked", DoubleType())])
    guard = SnapshotGuard(ts, amount, 60 * minutes, None if keep_days is None else keep_days * 86_400_000, columns)
    return stream.groupBy(*subject).transformWithStateInPandas(guard, schema, "Append", "None" if keep_days is None else "ProcessingTime")
