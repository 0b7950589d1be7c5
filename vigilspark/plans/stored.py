"""Merges into stored tables, audited writes, and reports of all users at once."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import nested
from vigilspark.operators import fixed_lists, jobs
from vigilspark.plans import histories, relations
from vigilspark.plans.catalog import ORACLES, query, table
from vigilspark.sources import exports, merging, storage


@query(ORACLES["upsert_entries"])
def merge_entries_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge of `upsert_entries`, in two batches into a stored table that rewrites the partitions it touches."""
    old, new = relations.entry_versions(spark, sf_dir)
    target = merging.StoredTable(spark, f"entries_{uuid.uuid4().hex}", ["l_orderkey", "l_linenumber"], parts=16, buckets=4).create(old)
    for batch in (0, 1):
        target.upsert(new.filter(F.col("l_orderkey") % 2 == batch), ["l_quantity", "entity"])
    return target.read()


@query("""SELECT 'users' AS type, 'success' AS status, count(*) AS records_processed, count(*) FILTER (c_acctbal < 0) AS flags_found, NULL AS error FROM customer
UNION ALL SELECT 'orders', 'success', count(*), NULL, NULL FROM orders""")
def audited_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of two writes, counted as the rows pass to their sinks."""
    folder, clock = storage.fresh_folder(spark, "audited"), lambda: datetime(2024, 1, 1)
    users = exports.audited("users", table(spark, sf_dir, "customer"), lambda rows: rows.write.parquet(f"{folder}/users"), clock, F.col("c_acctbal") < 0)
    orders = exports.audited("orders", table(spark, sf_dir, "orders"), lambda rows: rows.write.parquet(f"{folder}/orders"), clock)
    return users.unionByName(orders).select("type", "status", "records_processed", "flags_found", "error")


@query(f"""WITH {histories._GROUPS}, t AS (SELECT account, 'transactions' AS kind, (row_number() OVER (PARTITION BY account ORDER BY seq) - 1) // 4 AS page, seq AS k FROM h UNION ALL SELECT account, 'groups', (row_number() OVER (PARTITION BY account ORDER BY first_seq) - 1) // 4, first_seq FROM q),
r AS (SELECT account, count(*) FILTER (kind = 'transactions') AS tx_count, count(*) FILTER (kind = 'groups') AS group_count FROM t GROUP BY account),
i AS (SELECT account, (row_number() OVER (PARTITION BY account ORDER BY seq) - 1) // 4 AS page, sum(CAST(raw_out AS BIGINT)) AS raw_out FROM h GROUP BY account, seq, raw_out)
SELECT account, kind, CAST(page AS INTEGER) AS page, count(*) AS n, any_value(tx_count) AS tx_count, any_value(group_count) AS group_count, CASE WHEN kind = 'transactions' THEN (SELECT sum(raw_out) FROM i WHERE i.account = t.account AND i.page = t.page) END AS raw_out FROM t JOIN r USING (account) GROUP BY account, kind, page""")
def customer_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored report of every customer in one job, in pages of four; amounts are read back from the pages' JSON."""
    actions = histories.contract_actions(spark, sf_dir)
    reports, pages = jobs.history_reports(actions, fixed_lists.contracts(spark), now=F.expr("TIMESTAMP '2024-01-01 00:00:00'"), size=4)
    items = nested.at(nested.payload(F.col("data")), "$", "array<variant>")
    total = F.aggregate(items, F.lit(0).cast("bigint"), lambda s, t: s + (nested.at(t, "$.rawAmountOut", "decimal(30,8)") * 100_000_000).cast("bigint"))
    held = pages.select(F.col("address").alias("account"), "kind", "page", F.col("rows").alias("n"), F.when(F.col("kind") == "transactions", total).alias("raw_out"))
    counts = reports.select(F.col("address").alias("account"), "tx_count", "group_count")
    return held.join(counts, "account").select("account", "kind", "page", "n", "tx_count", "group_count", "raw_out")
