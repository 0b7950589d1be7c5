"""Streaming queries, run to the end of what there is; they give what a batch over the same rows gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark import schemas
from vigilspark.operators import fixed_lists, jobs, portfolio
from vigilspark.plans.catalog import query, table
from vigilspark.sources import endpoints, feeds, storage
from vigilspark.streaming import live


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """A folder for results and one for progress, where the cluster shares files."""
    root = storage.fresh_folder(spark, name)
    return f"{root}/rows", f"{root}/progress"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    return live.file_stream(spark, f"{sf_dir}/events.parquet*", schema)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_dedupe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once each, counted by day and type; the result is read back from the sink's folder.

    The run is bounded and its files may come in any order of time, so all ids are held and no row is late.
    """
    rows, progress = _folders(spark, "windows")
    with live.state_on_disk(spark):
        counted = live.counts_by_window(_events(spark, sf_dir).dropDuplicates(["event_id"]), "ts", ["event_type"], "1 day", None)
        schema = counted.schema
        counted.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(rows)).outputMode("complete").option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(rows).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 30")
def stream_live_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30 rows after each micro-batch, kept in a folder by batch."""
    rows, progress = _folders(spark, "newest")
    newest = live.latest_of(rows, ["event_id"], 30)
    query_ = _events(spark, sf_dir).select("event_id", "event_type").writeStream.foreachBatch(newest).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query_.awaitTermination()
    last = live.last_batch(query_)
    return spark.read.schema("event_id bigint, event_type string").parquet(f"{rows}/batch={last or 0}")


@query("""WITH s AS (SELECT event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 10 MINUTES, ts) ORDER BY ts, event_id) = 1),
g AS (SELECT *, greatest(0, value - coalesce(lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0)) AS grown FROM s)
SELECT event_type, event_id, round(sum(grown) OVER (PARTITION BY event_type ORDER BY ts, event_id), 4) AS locked FROM g""")
def snapshots_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots of their type: one in ten minutes passes, with the growth locked so far, from state."""
    rows, progress = _folders(spark, "guarded")
    with live.state_on_disk(spark):
        passed = live.guarded_snapshots(_events(spark, sf_dir).select("event_type", "event_id", "ts", "value"), ["event_type"], "ts", "value", 10)
        schema = passed.schema
        passed.writeStream.foreachBatch(live.to_batch_folders(rows)).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{rows}/batch=*").select("event_type", "event_id", F.round("locked", 4).alias("locked"))


def _pages(rows: DataFrame, number: Column, kinds: list[str], item: str) -> DataFrame:
    """Pages (address, cursor, body) of rows (address, and what `item` names as a struct) by their page's number; each page
    but the last names the next one, and one without rows is empty."""
    last = rows.agg(F.max(number)).first()[0] or 0
    items = rows.groupBy("address", number.alias("page")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    every = rows.sparkSession.createDataFrame([(k,) for k in kinds], "address string").select("address", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(int(last)).cast("bigint"))).alias("page"))
    following = F.when(F.col("page") < last, (F.col("page") + 1).cast("string"))
    met = every.join(items, ["address", "page"], "left")
    body = F.to_json(F.struct(F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"), following.alias("next")))
    return met.select("address", F.col("page").cast("string").alias("cursor"), body.alias("body"))


def _read_pages(spark: SparkSession, kinds: list[str], progress: str, **options: object) -> DataFrame:
    """All that an endpoint has, by one query of its stream, in rounds that grow as long as there are pages left."""
    query_ = endpoints.stream(spark, kinds, progress, growth=4, **options).writeStream.foreachBatch(live.to_batch_folders(f"{progress}-read")).option("checkpointLocation", f"{progress}-query").start()
    try:
        query_.processAllAvailable()
    finally:
        query_.stop()
    return spark.read.schema(endpoints.SCHEMA).parquet(f"{progress}-read/batch=*")


@query("SELECT event_type AS address, CAST(event_id // 1000 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY event_type, event_id // 1000 ORDER BY event_id) - 1 AS INTEGER) AS pos, event_id, value FROM events")
def paged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's events, served as pages of an endpoint of their own and read back as a stream that follows cursors."""
    events = table(spark, sf_dir, "events").withColumn("item", F.struct("event_id", "value"))
    folder, progress = _folders(spark, "pages")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of types
    pages = _pages(events.withColumnRenamed("event_type", "address"), F.floor(F.col("event_id") / 1000), kinds, "item")
    endpoints.write_pages(pages, folder)
    read = _read_pages(spark, kinds, progress, folder=folder, pages=50).withColumn("i", F.from_json("item", "event_id bigint, value double"))
    return read.select("address", "page", "pos", "i.event_id", "i.value")


@query(f"""WITH b AS (SELECT * FROM (VALUES {", ".join(str(r) for r in fixed_lists.FROZEN)}) v(address, chain)), s AS (SELECT '0x' || md5(CAST(s_suppkey AS VARCHAR)) || md5(CAST(s_suppkey AS VARCHAR))[1:8] AS address, s_suppkey % 3 = 0 AS freed FROM supplier)
SELECT address, chain, 'USDT blacklisted address (' || chain || ')' AS reason FROM b UNION ALL SELECT address, 'ETH', CASE WHEN freed THEN 'USDT address (unfrozen by Tether)' ELSE 'USDT blacklisted address (ETH)' END FROM s""")
def frozen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen list after a sync from event logs: suppliers as logs of two topics, in pages that one endpoint has in part
    and a second one whole; every third supplier is in the logs of removals too."""
    key = F.col("s_suppkey").cast("string")
    data = F.concat(F.lit("0x" + "0" * 24), F.md5(key), F.left(F.md5(key), F.lit(8)))
    logs = table(spark, sf_dir, "supplier").select("s_suppkey", F.struct("s_suppkey", data.alias("data")).alias("item"), F.lit("added").alias("address"))
    logs = logs.unionByName(logs.filter("s_suppkey % 3 = 0").withColumn("address", F.lit("removed")))
    folder, progress = _folders(spark, "logs")
    pages = storage.stored(_pages(logs, F.floor(F.col("s_suppkey") / 20), ["added", "removed"], "item"), "log-pages")
    endpoints.write_pages(pages.filter("cast(cursor as bigint) % 2 = 0"), f"{folder}/first")
    endpoints.write_pages(pages, f"{folder}/second")
    read = _read_pages(spark, ["added", "removed"], progress, folder=[f"{folder}/first", f"{folder}/second"], pages=7, wait=0)
    found = read.select("address", F.from_json("item", "data string")["data"].alias("data"))
    frozen, removed = (feeds.frozen_from_logs(found.filter(F.col("address") == topic)) for topic in ("added", "removed"))
    entries = spark.createDataFrame([], schemas.COMPLIANCE_ENTRIES).select(*jobs.ENTRY)
    got = jobs.sync_frozen(entries, fixed_lists.frozen_baseline(spark), [frozen], [removed], F.expr("TIMESTAMP '2024-01-30 00:00:00'"))
    return got.select("address", "chain", "reason")


@query("""SELECT 'K' || p_partkey AS asset, CAST(p_size * 2 AS DOUBLE) AS amount, round(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE CAST(p_size * 2 AS DOUBLE) * p_retailprice END, 4) AS usd FROM part WHERE p_size > 0""")
def paged_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as balances and as pools, each in pages of an endpoint: what is held at the pools' prices, some of which have none."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    usd = F.when(k % 7 == 0, "0").otherwise(F.col("p_retailprice").cast("string"))
    pool = F.struct(k.alias("n"), F.concat(F.lit("THOR.K"), k).alias("asset"), F.lit("1").alias("assetPrice"), usd.alias("assetPriceUSD"))
    coin = F.struct(k.alias("n"), F.concat(F.lit("THOR.K"), k).alias("denom"), (F.col("p_size").cast("bigint") * 200_000_000).cast("string").alias("amount"))
    page = F.floor(k / 200)
    folder, progress = _folders(spark, "money")
    for name, item in (("pools", pool), ("balances", coin)):
        endpoints.write_pages(_pages(part.select(k, item.alias("item"), F.lit(name).alias("address")), page, [name], "item"), folder)
    read = _read_pages(spark, ["pools", "balances"], progress, folder=folder, pages=40)
    pools = endpoints.parsed(read.filter("address = 'pools'"), schemas.POOLS).withColumn("pos", F.col("page") * 1000 + F.col("pos"))
    held = portfolio.sum_by_asset(endpoints.parsed(read.filter("address = 'balances'"), schemas.BALANCES))
    return portfolio.valued(held, portfolio.prices(pools)).select("asset", "amount", F.round("usd", 4).alias("usd"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_custkey LIMIT 100")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next users that were never fetched, after those with an order were marked as done."""
    users = table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("timestamp").alias("fetched_at"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return live.work_queue(live.mark_done(users, done, "c_custkey", "fetched_at", F.expr("TIMESTAMP '2024-01-01 00:00:00'")), "fetched_at", "c_custkey").select("c_custkey")
