"""Streams over many files in no order of time."""

from __future__ import annotations

import random
import time
from collections import Counter
from datetime import datetime, timedelta

from vigilspark.operators import portfolio
from vigilspark.plans import registry
from vigilspark.streaming import live


def test_dedupe_over_shuffled_files_equals_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=i), ("click", "view", "error")[i % 3]) for i in range(720)]
    # copies in later files; those of the first ten ids stand in the last file
    for part in range(24):
        held = rows[part::24] + (rows[part - 1 : 720 : 48] if part else []) + (rows[:10] if part == 23 else [])
        spark.createDataFrame(held, "event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {(r["day"], r["event_type"]): r["n"] for r in registry.QUERIES["stream_dedupe_window"](spark, str(tmp_path)).collect()}
    assert got == Counter((ts.strftime("%Y-%m-%d"), kind) for _, ts, kind in rows)


def in_files(spark, folder, parts):
    """One file for each part, in order of time of writing."""
    for part in parts:
        spark.createDataFrame(part, "event_type string, event_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)


def run(spark, made, sink, checkpoint):
    with live.state_on_disk(spark):
        query = made.writeStream.foreachBatch(sink).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_guarded_snapshots_over_files_and_runs(spark, tmp_path):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), i, start + timedelta(minutes=3 * i), float(rng.randrange(100))) for i in range(240)]
    parts = [rows[i : i + 30] for i in range(0, 240, 30)]
    parts[5] = [*parts[5], *parts[2]]  # polled again, long after
    for these in (parts[:4], parts[4:]):  # two runs
        in_files(spark, tmp_path / "in", these)
        stream = live.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "event_type string, event_id long, ts timestamp, value double").schema, files=1)
        query = run(spark, live.guarded_snapshots(stream, ["event_type"], "ts", "value"), live.to_batch_folders(f"{tmp_path}/out"), tmp_path / "checkpoint")
        assert len(query.recentProgress) >= 4
    got = spark.read.parquet(f"{tmp_path}/out/batch=*")
    want, locked, last = {}, {"a": 0.0, "b": 0.0}, {"a": 0.0, "b": 0.0}
    for kind, i, ts, value in rows:
        if (key := (kind, (ts - start) // timedelta(minutes=10))) not in want:
            locked[kind] += max(0.0, value - last[kind])
            last[kind] = value
            want[key] = (i, locked[kind])
    assert sorted((r["event_id"], r["locked"]) for r in got.collect()) == sorted(want.values())
    thinned = portfolio.thinned(spark.createDataFrame([r for r in rows if r[0] == "a"], "event_type string, event_id long, ts timestamp, value double"), "ts", 10)
    assert sorted(r["event_id"] for r in got.filter("event_type = 'a'").collect()) == sorted(r["event_id"] for r in thinned.collect())


def test_sinks_by_batch_take_a_batch_twice(spark, tmp_path):
    batches = [spark.createDataFrame([(n * 10 + i, "x") for i in range(10)], "event_id long, event_type string") for n in (2, 0, 1)]
    newest, every = live.latest_of(f"{tmp_path}/newest", ["event_id"], 15), live.to_batch_folders(f"{tmp_path}/every")
    for n, batch in enumerate(batches):
        for _ in range(2):
            newest(batch, n)
            every(batch, n)
    assert [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/newest/batch=2").orderBy("event_id").collect()] == list(range(15, 30))
    assert spark.read.parquet(f"{tmp_path}/every/batch=*").count() == 30


def test_unseen_forgets_what_its_watermark_has_passed(spark, tmp_path):
    start = datetime(2024, 1, 1)
    in_files(spark, tmp_path / "in", [[("x", 100 * n + i // 2, start + timedelta(days=n, minutes=i), 0.0) for i in range(100)] for n in range(12)])
    stream = live.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "event_type string, event_id long, ts timestamp, value double").schema, files=1)
    query = run(spark, live.unseen(stream, "event_id", "ts", "1 day"), live.to_batch_folders(f"{tmp_path}/out"), tmp_path / "checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out/batch=*").select("event_id").collect()
    assert len(got) == len(set(got)) == 600
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) <= 200 and all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in query.recentProgress)
    assert "rocksdb" in str(query.recentProgress[-1]["stateOperators"][0])
