"""Syncs, screening runs, flags, certificates and reports from end to end on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vigilspark import schemas
from vigilspark.operators import fixed_lists, geo, history, jobs
from vigilspark.plans import histories
from vigilspark.sources import exports, feeds
from vigilspark.streaming import live

@pytest.fixture
def now(spark):
    return F.expr("timestamp '2024-03-01 00:00:00'")


@pytest.fixture
def entries(spark):
    return spark.createDataFrame([], schemas.COMPLIANCE_ENTRIES).select(*jobs.ENTRY)


def test_fixed_lists_are_whole():
    assert (len(fixed_lists.INCIDENTS), len(fixed_lists.FROZEN), len(fixed_lists.CONTRACTS), len(fixed_lists.TYPE_LABELS)) == (21, 17, 101, 69)
    assert len({r[0] for r in fixed_lists.CONTRACTS}) == 101


def test_syncs_then_screening_then_flags(spark, entries, now):
    listed = jobs.sync_incidents(entries, fixed_lists.incidents(spark), now)
    listed = jobs.sync_frozen(listed, fixed_lists.frozen_baseline(spark), [], [], now)
    listed = jobs.sync_texts(listed, spark.createDataFrame([("x" * 100 + " 0x" + "AB" * 20 + " ",)], ["value"]), now)
    assert {r["source"]: r["count"] for r in listed.groupBy("source").count().collect()} == {"HACK": 21, "TETHER": 17, "EU": 1}
    again = jobs.sync_incidents(listed, fixed_lists.incidents(spark), now)
    assert again.count() == listed.count() and again.filter("source = 'HACK' and reason like '%est.%'").count() == 0
    users = spark.createDataFrame([(1, "thor1a", None, None, None, None, None, None), (2, "thor1b", None, None, None, None, True, "old")], schemas.USERS)
    edges = spark.createDataFrame([(1, "thor1a", "0x" + "ab" * 20, "ETH", None, False, None), (2, "thor1b", "bc1clean", "BTC", None, False, None)], schemas.L1_ADDRESSES)
    screened = {r["thor_address"]: r for r in jobs.screen_users(users, edges, listed.withColumn("id", F.monotonically_increasing_id()), now).collect()}
    assert screened["thor1a"]["flagged"] and screened["thor1a"]["flag_reason"] == "EU: EU Sanctioned Entity (0x" + "ab" * 20 + ")"
    assert not screened["thor1b"]["flagged"] and screened["thor1b"]["flag_reason"] is None and screened["thor1b"]["screened_at"] is not None
    flags = spark.createDataFrame([(7, "q", None, "r", "me", None, True)], schemas.MANUAL_FLAGS)
    flags, more, marked = jobs.add_manual_flag(flags, listed, users, edges, "bc1clean", "BTC", "fraud", "me", now)
    assert sorted(r["id"] for r in flags.collect()) == [7, 8] and more.count() == listed.count() + 1
    assert {r["thor_address"]: r["flag_reason"] for r in marked.collect()} == {"thor1a": None, "thor1b": "MANUAL: fraud (bc1clean...)"}
    flags, fewer = jobs.remove_manual_flag(flags, more, 8)
    assert {r["id"]: r["active"] for r in flags.collect()} == {7: True, 8: False} and fewer.count() == listed.count()
    lines = [r["line"] for r in exports.flagged_lines(jobs.flagged_users(users, edges)).collect()]
    assert lines == ['"thor1b","old","BTC:bc1clean",""']


def test_certificates(spark, entries, now):
    listed = jobs.sync_incidents(entries, fixed_lists.incidents(spark), now)
    bad, good = (jobs.certificate(listed, a, now) for a in ("3HMHpWQPRGCCg1VGwreiSjEtaqLW8kNbMF", "clean"))
    both = bad.union(good)
    got = {r["address"]: r for r in both.collect()}
    assert got["3HMHpWQPRGCCg1VGwreiSjEtaqLW8kNbMF"]["flagged"] and not got["clean"]["flagged"] and got["clean"]["sources_checked"] == 8
    assert jobs.by_public_id(both, "cert_id", got["clean"]["cert_id"].lower()).count() == 1


def test_stored_reports_read_back(spark, now):
    leg = lambda a, c, n: [(a, "tx1", [(c, n)])]
    empty = (None, None, None, None)
    rows = [(1, "1700000000000000000", "swap", "success", leg("thor1u", "THOR.RUNE", "200000000"), leg("bc1x", "BTC.BTC", "100000"), empty), (2, "1600000000000000000", "send", "success", leg("thor1u", "THOR.RUNE", "1"), [], empty)]
    actions = spark.createDataFrame(rows, "seq bigint, " + schemas.ACTIONS)
    balances = spark.createDataFrame([("rune", "300000000"), ("x/bow-a-b", "5")], schemas.BALANCES)
    made = jobs.history_report(actions, balances, fixed_lists.contracts(spark), "thor1u", start="2021-01-01", reveal=False, now=now)
    (row,) = made.collect()
    data = json.loads(row["tx_data"])
    assert row["tx_count"] == 1 and [t["assetOut"] for t in data["transactions"]] == ["BTC"] and data["balances"] == [{"asset": "RUNE", "amount": "3.00"}] and len(data["groups"]) == 1
    (shown,) = jobs.shown_report(made, row["report_id"].lower()).collect()
    assert shown["address"] is None and shown["data"]["groups"][0]["primary"]["type"] == "swap"


def test_polygons_of_a_document(spark, tmp_path):
    square = lambda x, r: [[x - r, -r], [x + r, -r], [x + r, r], [x - r, r], [x - r, -r]]
    doc = {"features": [{"geometry": {"type": "Polygon", "coordinates": [square(0, 5), square(0, 1)]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[square(40, 5)], [square(80, 5)]]}}, {"geometry": {"type": "Polygon", "coordinates": []}}]}
    (tmp_path / "land.json").write_text(json.dumps(doc))
    points = spark.createDataFrame([("hole", 0.5, 0.5), ("ring", 3.0, 3.0), ("part", 82.0, 1.0), ("sea", 20.0, 0.0), ("none", None, 0.0)], "name string, lon double, lat double")
    got = {(r["name"], r["polygon"]) for r in geo.within(points, feeds.read_polygons(spark, str(tmp_path / "land.json"))).collect()}
    assert got == {("ring", "0.0"), ("part", "1.1")}


def test_counters_fill_as_rows_pass(spark):
    rows, seen = live.with_progress(spark.range(10).withColumnRenamed("id", "k"), "progress", even=F.col("k") % 2 == 0)
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}


def test_reports_deal_actions_and_make_groups_once(spark, small, monkeypatch):
    actions = histories.contract_actions(spark, small)
    assert actions.rdd.getNumPartitions() == histories._actions(spark, small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    made, whole = spark.sparkContext.accumulator(0), history.grouped

    @F.udf("int")
    def counted(n):
        made.add(1)
        return n

    monkeypatch.setattr(history, "grouped", lambda *args: whole(*args).withColumn("internalCount", counted("internalCount")))
    reports, _ = jobs.history_reports(actions, fixed_lists.contracts(spark), now=F.expr("TIMESTAMP '2024-01-01 00:00:00'"), size=4)
    assert made.value == reports.agg(F.sum("group_count")).first()[0] > 0


def test_few_and_many_contracts_name_alike(spark, small, monkeypatch):
    actions, known = histories.contract_actions(spark, small), fixed_lists.contracts(spark)

    def named():
        rows = history.with_priority(history.parse_actions(actions, known, "user"), F.col("user"), known)
        return sorted(map(tuple, rows.collect()))

    few = named()
    monkeypatch.setattr(history, "FEW_CONTRACTS", 100)
    assert named() == few
