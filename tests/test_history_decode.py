"""Every order is decoded, of all decode classes."""

from __future__ import annotations

from vigilspark.plans import registry


def test_no_order_is_left_out(spark, small):
    got = registry.QUERIES["history_decode"](spark, small)
    keys = spark.read.parquet(f"{small}/orders.parquet").selectExpr("o_orderkey AS seq")
    assert sorted(got.select("seq").collect()) == sorted(keys.collect())
    claims = got.filter("type = 'ruji-claim'").select("seq", "raw_out").collect()
    assert claims and all(r["raw_out"] == r["seq"] + 9 for r in claims)
