"""Display forms at the ends of their ranges."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from vigilspark.functions import numbers, times
from vigilspark.plans import registry


def test_times_beyond_longs_and_four_digit_years(spark, tmp_path):
    want = {
        "1700000000123456789": "2023-11-14T22:13:20.123Z",
        "518765919538999000000": "18409-01-14T04:18:58.999Z",
        "-1": "1969-12-31T23:59:59.999Z",
        "-9223372036854775808": "1677-09-21T00:12:43.145Z",
        "8640000000000000000000": "275760-09-13T00:00:00.000Z",
        "8640000000001000000000": None,
        "9" * 38: None,
        "9" * 60: None,
        "1.5": None,
        "": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", times.iso(times.from_nanos(F.col("t"))).alias("iso"))
    assert {r["t"]: r["iso"] for r in rows.collect()} == want
    spark.createDataFrame([(7,), (5999999,), (100000000,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["ns_to_iso"](spark, str(tmp_path)).collect()
    assert {r["event_id"]: r["iso"] for r in got} == {7: "1970-01-08T00:07:07.007Z", 5999999: "18409-01-14T04:18:58.999Z"}


def test_amounts_are_rounded_once(spark, tmp_path):
    spark.createDataFrame([(5270222,), (3000,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["shown"] for r in registry.QUERIES["format_amounts"](spark, str(tmp_path)).collect()}
    assert got == {5270222: "2199521.2k", 3000: "712.71"}


def test_feed_and_compact_forms_are_rounded_once(spark):
    values = ["104999.99999996", "12345.67890123", "10499.99999999", "10500", "1049.99999999", "1999949.99999999", "1005000", "999999999999999999999.99999999"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.col("v").cast("decimal(38,8)").alias("d"))
    once = lambda d, by, n: str((d / by).quantize(Decimal(1).scaleb(-n), rounding=ROUND_HALF_UP))
    for r in rows.select("v", "d", numbers.live_amount(F.col("d")).alias("live"), numbers.compact(F.col("d")).alias("compact"), numbers.usd(F.col("d")).alias("usd")).collect():
        d = Decimal(r["v"])
        assert r["live"] == once(d, 1000, 0 if d > 10000 else 1) + "k", r
        million = d >= 1_000_000
        assert r["compact"] == (once(d, 1_000_000, 1) + "M" if million else once(d, 1000, 1) + "k"), r
        assert r["usd"] == "$" + (once(d, 1_000_000, 2) + "M" if million else once(d, 1000, 1) + "k"), r
