"""Merges into stored tables, audits of writes and streams, payloads of any shape."""

from __future__ import annotations

import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import nested
from vigilspark.sources import exports, feeds, merging
from vigilspark.streaming import live


@pytest.fixture
def target(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("j"), F.col("id").cast("string").alias("v"), F.lit("old").alias("w"))
    name = f"merge_{time.time_ns()}"
    yield merging.StoredTable(spark, name, ["k", "j"], parts=16, buckets=2).create(rows)
    spark.sql(f"DROP TABLE {name}")


def held(table):
    return {(r["k"], r["j"]): (r["v"], r["w"]) for r in table.read().collect()}


def test_merges_touch_only_their_partitions(spark, target):
    want = held(target)
    files = set(spark.table(target.name).inputFiles())
    new = spark.createDataFrame([(7, 1, "seven", "new"), (9, 9, "nine", "new")], "k long, j long, v string, w string")
    for _ in range(2):  # a merge that runs again changes nothing
        touched = target.upsert(new, ["v"])
        want |= {(7, 1): ("seven", "old"), (9, 9): ("nine", "new")}
        assert held(target) == want and 1 <= len(touched) <= 2
    assert len(set(spark.table(target.name).inputFiles()) & files) >= len(files) * 13 // 16
    assert target.upsert(new.limit(0), ["v"]) == [] and held(target) == want


def test_merges_equal_a_dictionary(spark, target):
    rng, want = random.Random(1), held(target)
    schema = "k long, j long, v string, w string"
    for n in range(3):
        rows = {(k := rng.randrange(5200), rng.choice([k % 3, 7])): (f"n{n}", "w") for _ in range(40)}
        df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], schema)
        if n == 0:
            target.insert_ignore(df, ["v"])
            want = rows | want
        elif n == 1:
            target.update(df.drop("w"), ["v"])
            want = {k: (rows[k][0], v[1]) if k in rows else v for k, v in want.items()}
        else:
            target.delete(df)
            want = {k: v for k, v in want.items() if k not in rows}
        assert held(target) == want


def test_a_partition_that_is_emptied_goes(spark):
    one = merging.StoredTable(spark, f"merge_{time.time_ns()}", ["k"], parts=4, buckets=1).create(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k long, v string"))
    one.delete(spark.createDataFrame([(1,), (2,)], "k long"))
    assert sorted(r["k"] for r in one.read().collect()) == [3, 4]
    one.delete(spark.createDataFrame([(3,), (4,)], "k long"))
    assert one.read().count() == 0
    spark.sql(f"DROP TABLE {one.name}")


def test_the_target_is_not_shuffled(spark, target):
    from vigilspark.operators import relational

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(7, 1, "seven", "new")], "k long, j long, v string, w string")
        plan = relational.upsert(target.read([1, 2]), rows, ["k", "j"], ["v"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert plan.index("FileScan") < plan.index("Exchange")


def test_buckets_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(merging, "BUCKET_ROWS", 700)
    rows = spark.range(5000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    one = merging.StoredTable(spark, f"merge_{time.time_ns()}", ["k"], parts=3, buckets=2).create(rows)
    spec = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {one.name}").collect()}
    assert spec["Num Buckets"] == "8"
    one.upsert(spark.range(4990, 5010).select(F.col("id").alias("k"), F.lit("new").alias("v")), ["v"])
    assert {r["k"]: r["v"] for r in one.read().collect()} == {k: "old" if k < 4990 else "new" for k in range(5010)}
    spark.sql(f"DROP TABLE {one.name}")


def test_a_failing_sink_leaves_an_error_row(spark, tmp_path):
    clock = lambda: datetime(2024, 1, 1)
    rows = spark.range(100)
    good = exports.audited("job", rows, lambda df: df.write.parquet(f"{tmp_path}/good"), clock, F.col("id") < 7).first()
    assert tuple(good)[:5] == ("job", "success", 100, 7, None) and spark.read.parquet(f"{tmp_path}/good").count() == 100
    full = F.when(F.col("id") == 50, F.raise_error(F.lit("the sink is full"))).otherwise(F.col("id"))
    bad = exports.audited("job", rows, lambda df: df.select(full.alias("id")).write.parquet(f"{tmp_path}/bad"), clock).first()
    assert tuple(bad)[:4] == ("job", "error", None, None) and "the sink is full" in bad["error"]


def test_streams_leave_an_audit_row_for_each_batch(spark, tmp_path):
    for n in range(3):
        spark.range(10 * n, 10 * n + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = exports.StreamAudit(spark, f"{tmp_path}/audit", ("audited",))
    spark.streams.addListener(listener)
    try:
        for fails in (False, True):
            rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            watched, _ = live.with_progress(rows, f"seen{fails}", flags=F.col("id") % 2 == 0)
            if fails:
                watched = watched.select(F.when(F.col("id") >= 0, F.raise_error(F.lit("no more"))).otherwise(F.col("id")).alias("id"))
            query = watched.writeStream.queryName("audited").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out{n}")).option("checkpointLocation", f"{tmp_path}/c{fails}").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except Exception:
                assert fails
        deadline = time.time() + 60
        while time.time() < deadline:
            got = spark.read.schema(exports.AUDIT).parquet(f"{tmp_path}/audit").collect() if (tmp_path / "audit").exists() else []
            if len(got) >= 4:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert sorted((r["type"], r["status"], r["records_processed"], r["flags_found"]) for r in got if r["status"] == "success") == [("audited", "success", 10, 5)] * 3
    assert [bool(r["error"]) for r in got if r["status"] == "error"] == [True]


def test_reports_of_either_format(spark):
    texts = ['{"transactions": [{"a": 1}, {"a": "x"}], "groups": []}', '[{"a": 1}]', "no json", None, "7", '{"balances": [1]}', "[]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("r", nested.report_parts(nested.payload(F.col("t"))))
    got = {r["i"]: (r["n"], r["g"], r["b"]) for r in rows.select("i", *[F.when(F.col(f"r.{c}").isNotNull(), F.size(f"r.{c}")).alias(c[0] if c != "transactions" else "n") for c in ("transactions", "groups", "balances")]).collect()}
    assert got == {0: (2, 0, None), 1: (1, None, None), 2: (None,) * 3, 3: (None,) * 3, 4: (None,) * 3, 5: (None, None, 1), 6: (0, None, None)}


def test_parties_of_damaged_xml_are_nulls(spark):
    rows = spark.createDataFrame([(1, "<DistinctParty><Profile ID='4'/></DistinctParty>"), (2, "<DistinctParty><Pro"), (3, None)], "k int, xml string")
    got = {r["k"]: r["Profile"] for r in feeds.parse_parties(rows).collect()}
    assert got[1][0]["_ID"] == "4" and got[2] is None and got[3] is None


def test_parties_are_parsed_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def fetched(text):
        read.add(1)
        return text

    feature = "<Feature FeatureTypeID='344'><FeatureVersion><VersionDetail>a{0}</VersionDetail></FeatureVersion><IdentityReference IdentityID='{1}'/></Feature>"
    name = "<Identity ID='{0}'><Alias><DocumentedName><DocumentedNamePart><NamePartValue>n{0}</NamePartValue></DocumentedNamePart></DocumentedName></Alias></Identity>"
    texts = [f"<DistinctParty><Profile ID='{i}'>{feature.format(i, (i + 1) % 20)}{name.format(i)}</Profile></DistinctParty>" for i in range(20)]  # names stand in other parties
    rows = spark.createDataFrame([(t,) for t in [*texts, "<DistinctParty><Pro", None, "<DistinctParty/>"]], "xml string").select(fetched("xml").alias("xml"))
    got = feeds.sanctioned_addresses(feeds.parse_parties(rows)).collect()
    assert sorted((r["address"], r["entity_name"]) for r in got) == sorted((f"a{i}", f"n{(i + 1) % 20}") for i in range(20))
    assert read.value == 23
