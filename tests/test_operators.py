"""Operators that no table of the driver exercises: decoders, feeds, sinks, codecs, and properties of merges."""

from __future__ import annotations

import bisect
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import codecs, nested, numbers, text, times
from vigilspark.operators import history, portfolio, relational, screening
from vigilspark.sources import exports, feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_group_order_equals_a_loop(spark):
    rng = random.Random(3)
    groups = {g: [rng.randrange(4) for _ in range(rng.randrange(1, 9))] for g in range(300)}
    want = {}
    for g, priorities in groups.items():
        first, subs = 0, []
        for i in range(1, len(priorities)):
            if priorities[i] < priorities[first]:
                subs.append(first)
                first = i
            else:
                subs.append(i)
        want[g] = (first, subs)
    rows = spark.createDataFrame([(g, i, p) for g, ps in groups.items() for i, p in enumerate(ps)], "g int, seq int, priority int").repartition(7)
    got: dict[int, list] = {}
    for r in history.group_order(rows, "g", "seq", "priority").collect():
        got.setdefault(r["g"], []).append(r)
    for g, rs in got.items():
        assert want[g] == (next(r["seq"] for r in rs if r["is_primary"]), [r["seq"] for r in sorted((r for r in rs if not r["is_primary"]), key=lambda r: (r["sub_order"], r["seq"]))])


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 7), (3, "d", 8)], "k int, v string, n int")
    once = relational.upsert(old, new, ["k"], ["v"])
    twice = relational.upsert(once, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 5), (2, "c", 6), (3, "d", 8)]
    kept = relational.insert_ignore(old, new, ["k"])
    assert sorted(map(tuple, relational.insert_ignore(kept, new, ["k"]).collect())) == [(1, "a", 5), (2, "b", 6), (3, "d", 8)]


def test_screening_grows_with_the_lists(spark):
    edges = spark.createDataFrame([("u", "0xAB", "ETH"), ("v", "bc1x", "BTC"), ("w", "0xCD", "ETH")], "user string, l1_address string, chain string")
    entries = spark.createDataFrame([(1, "0xab", "ETH", "OFAC", "n", "r"), (2, "0xAb", "ETH", "EU", "m", "s")], "id int, address string, chain string, source string, entity_name string, reason string")
    assert [(r["user"], r["source"]) for r in screening.screen_edges(edges, entries).collect()] == [("u", "EU")]
    oracle = spark.createDataFrame([("0xcd", "Named")], "address string, entity_name string")
    assert {(r["user"], r["source"]) for r in screening.screen_edges(edges, entries, oracle=oracle).collect()} == {("u", "EU"), ("w", "ORACLE")}


def test_frozen_list_never_shrinks(spark):
    now = F.expr("timestamp '2024-01-01'")
    schema = "address string, chain string, source string, reason string, last_seen timestamp"
    old = spark.createDataFrame([("0xaa", "ETH", "TETHER", "first", None), ("Tgone", "TRX", "TETHER", "first", None), ("Tstays", "TRX", "TETHER", "first", None), ("0xbb", "ETH", "OFAC", "kept", None)], schema)
    base = spark.createDataFrame([("0xAA", "ETH")], "address string, chain string")
    feed = spark.createDataFrame([("0xaa", "ETH"), ("Tnew", "TRX")], "address string, chain string")
    gone = spark.createDataFrame([("tGONE",), ("0xbb",)], "address string")
    got = screening.merge_frozen(old, base, feed, removed=gone, now=now)
    want = {("0xaa", "TETHER", "first"), ("Tgone", "TETHER", "USDT address (unfrozen by Tether)"), ("Tstays", "TETHER", "first"), ("0xbb", "OFAC", "kept"), ("Tnew", "TETHER", "USDT blacklisted address (TRX)")}
    assert {(r["address"], r["source"], r["reason"]) for r in got.collect()} == want
    screening.append_only(old, got)


def test_codecs_of_public_vectors():
    assert codecs.bech32_decode("A12UEL5L") == ("a", []) and codecs.bech32_decode("a12uel5m") is None
    prefix, words = codecs.bech32_decode("abcdef1qpzry9x8gf2tvdw0s3jn54khce6mua7lmqqqxw")
    assert words == list(range(32)) and codecs.bech32_encode(prefix, words) == "abcdef1qpzry9x8gf2tvdw0s3jn54khce6mua7lmqqqxw"
    assert codecs.tron_address("a614f803b6fd780986a42c78ec9c7f77e6ded13c") == "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t"
    home = codecs.bech32_encode("thor", words)
    assert codecs.home_address(codecs.bech32_encode("cosmos", words)) == home and codecs.home_address(codecs.bech32_encode("bc", words)) is None


def test_scalars(spark):
    cases = {
        numbers.format_amount: {"0": "0", "": "0", "100000000": "1.0000", "150000000": "1.50", "1000000000000": "10000.00", "2000000000000": "20.0k", "100000": "0.001000", "12": "0.00000012", "7x": "0.00000007"},
        numbers.raw_amount: {"123456789012": "1234.56789012", "100": "0.000001", "": "0"},
        text.clean_asset: {"ETH.USDC-0XA0B86991C6218B36": "USDC", "x/ruji": "RUJI", "thor.rune": "RUNE", "": "", "GAIA-ATOM": "ATOM"},
        text.short_asset: {"ETH.USDC-0xA0B86991": "USDC", "BTC~BTC": "BTC", "rune": "rune"},
        nested.maybe_base64: {"cmVjaXBpZW50": "recipient", "1234rune": "1234rune", "abc": "abc"},
    }
    for f, values in cases.items():
        df = spark.createDataFrame(list(values), "string")
        assert {r[0]: r[1] for r in df.select("value", f(F.col("value"))).collect()} == values, f
    assert one(spark, times.iso(times.from_nanos(F.lit("1700000000123456789")))) == "2023-11-14T22:13:20.123Z"
    assert one(spark, F.to_json(text.coin_list(F.lit("12abc, 7x,bad,123456"), clean=False))) == '[{"amount":"12","asset":"abc"},{"amount":"7","asset":"x"},{"amount":"12345","asset":"6"}]'
    assert one(spark, text.other_side(F.lit("BTC"), F.lit("RUJI Trade BTC/USDC.eth"))) == "USDC"
    assert one(spark, numbers.to_fixed(F.lit(2.5), F.lit(0))) == "3" and one(spark, numbers.to_fixed(F.lit(1.005), F.lit(2))) == "1.00"


def test_transfers_count_a_hash_once_and_read_logs(spark):
    attrs = [{"key": "cmVjaXBpZW50", "value": "me"}, {"key": "sender", "value": "you"}, {"key": "amount", "value": "100000000rune,5x/ruji"}]
    event = {"type": "transfer", "attributes": attrs}
    rows = [json.dumps({"txhash": "a", "events": [event]}), json.dumps({"txhash": "a", "events": [event]}), json.dumps({"txhash": "b", "events": [], "logs": [{"events": [event]}]})]
    from vigilspark.schemas import COSMOS_TXS

    txs = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", COSMOS_TXS).alias("t")).select("t.*")
    got = portfolio.incoming(portfolio.transfers(txs), "me").collect()
    assert {(r["asset"], round(r["amount"], 8)) for r in got} == {("rune", 2.0), ("ruji", 1e-7)}


SDN = """<?xml version="1.0"?><Sanctions><DistinctParties>
<DistinctParty FixedRef="1"><Profile ID="p1"><Feature ID="f1" FeatureTypeID="345"><FeatureVersion><VersionDetail DetailTypeID="1">0xABCDEF</VersionDetail></FeatureVersion><IdentityReference IdentityID="i1"/></Feature>
<Feature ID="f2" FeatureTypeID="999"><FeatureVersion><VersionDetail>skip</VersionDetail></FeatureVersion></Feature>
<Identity ID="i1"><Alias><DocumentedName><DocumentedNamePart><NamePartValue>Jane</NamePartValue></DocumentedNamePart><DocumentedNamePart><NamePartValue>Doe</NamePartValue></DocumentedNamePart></DocumentedName></Alias></Identity></Profile></DistinctParty>
<DistinctParty FixedRef="2"><Profile ID="p2"><Identity ID="i2"/><Feature ID="f3" FeatureTypeID="344"><FeatureVersion><VersionDetail>1BtcAddr</VersionDetail></FeatureVersion></Feature></Profile></DistinctParty>
</DistinctParties></Sanctions>"""


def test_sanctions_xml(spark, tmp_path):
    (tmp_path / "sdn.xml").write_text(SDN)
    got = feeds.sanctioned_addresses(feeds.read_sanctions(spark, str(tmp_path / "sdn.xml"))).collect()
    assert {(r["address"], r["chain"], r["entity_name"]) for r in got} == {("0xabcdef", "ETH", "Jane Doe"), ("1BtcAddr", "BTC", "Unknown OFAC Entity")}


def test_paged_source_follows_cursors(spark, tmp_path):
    folder = tmp_path / "addr"
    folder.mkdir()
    (folder / "0.json").write_text(json.dumps({"items": [{"n": 1}, {"n": 2}], "next": "c"}))
    (folder / "c.json").write_text(json.dumps({"items": [{"n": 3}]}))
    rows = feeds.read_pages(spark, str(tmp_path), ["addr", "absent"], "n int", pagesize="2", partial="true").collect()
    assert sorted((r["address"], r["page"], r["n"]) for r in rows if r["error"] is None) == [("addr", 0, 1), ("addr", 0, 2), ("addr", 1, 3)]
    assert [(r["address"], r["page"], r["n"]) for r in rows if r["error"]] == [("absent", 0, None)]
    short = feeds.read_pages(spark, str(tmp_path), ["addr"], "n int", pagesize="2", maxpages="1", partial="true").collect()
    assert [r["n"] for r in short] == [1, 2, None] and "beyond the limit of 1" in short[-1]["error"]
    with pytest.raises(Exception, match="beyond the limit of 1"):
        feeds.read_pages(spark, str(tmp_path), ["addr"], "n int", pagesize="2", maxpages="1").collect()


def test_csv_and_json_sinks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([('a"b', "x,y", None), ("", "line", "z")], "p string, q string, r string")
    exports.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).na.fill("")
    assert sorted(map(tuple, back.collect())) == [("", "line", "z"), ('a"b', "x,y", "")]
    assert sorted(r["line"] for r in exports.csv_lines(rows).collect()) == ['"","line","z"', '"a""b","x,y",""']
    exports.write_json(rows, str(tmp_path / "json"))
    assert sorted(map(str, spark.read.schema(rows.schema).json(str(tmp_path / "json")).collect())) == sorted(map(str, rows.collect()))
    assert {json.loads(r["json"])["r"] for r in exports.json_rows(rows).collect()} == {None, "z"}


def test_new_ids_are_dense_over_many_wide_rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = spark.range(3_000_000).select((F.col("id") * 7919 % 3_000_000).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("wide"))
    got = relational.with_new_ids(spark.createDataFrame([(10,)], "id long"), rows, ["k"])
    assert tuple(got.agg(F.count("*"), F.count_distinct("id"), F.max("id"), F.count_if(F.col("id") != F.col("k") + 11)).first()) == (3_000_000, 3_000_000, 3_000_010, 0)


def test_new_ids_of_equal_and_no_rows(spark):
    target = spark.createDataFrame([], "id long")
    same = spark.range(5000).select(F.lit(1).alias("k"))
    assert sorted(r["id"] for r in relational.with_new_ids(target, same, ["k"]).collect()) == list(range(1, 5001))
    assert relational.with_new_ids(target, same.limit(0), ["k"]).count() == 0


def test_as_of_splits_a_hot_key(spark):
    at = lambda s: F.timestamp_seconds(s)
    ids = spark.range(20_000).select("id", F.when(F.col("id") % 50 == 4, None).when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 7).alias("user"), (F.pmod(F.hash("id"), F.lit(400_000))).alias("s"))
    rows, history = ids.filter("id % 2 = 0").withColumn("at", at("s")), ids.filter("id % 2 = 1 and id % 31 <> 5").select("user", at("s").alias("ts"), F.col("id").alias("v"), "s")
    got = {r["id"]: r["asof_v"] for r in relational.as_of(rows, history, ["user"], "at", "ts", ["v"]).collect()}
    held: dict = {}
    for r in history.collect():
        held.setdefault(r["user"], []).append((r["s"], r["v"]))
    for v in held.values():
        v.sort()
    want = {}
    for r in rows.collect():
        mine = held.get(r["user"], []) if r["user"] is not None else []
        k = bisect.bisect_right(mine, (r["s"], math.inf))
        want[r["id"]] = mine[k - 1][1] if k else None
    assert got == want and sum(v is None for v in want.values()) > 50
    parts = relational.as_of(rows, history, ["user"], "at", "ts", ["v"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
