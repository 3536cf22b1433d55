"""Tracks with state: a stream of out-of-order files against the table of the same fixes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orbweave.streaming import tracks, windows

SCHEMA = "ts timestamp, device string, lat double, lng double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def run(spark, make, files, tmp_path, mode="append"):
    """Writes files one after another, reads each as a batch of its own, and returns the sink's rows and the last progress."""
    src = tmp_path / "in"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src / f"part={k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName("sink").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table("sink").collect(), q.recentProgress


def at(minute):
    return dt.datetime(2024, 5, 1, 8) + dt.timedelta(minutes=minute)


def test_stream_equals_table(spark, tmp_path, rocks):
    rand = random.Random(1)
    rows = [(at(m), f"d{m % 3}", 30 + rand.uniform(-1, 1), 120 + rand.uniform(-1, 1)) for m in range(60)]
    files = [sorted(rows[k : k + 12], key=lambda r: rand.random()) for k in range(0, 60, 12)]
    files[1], files[2] = files[1][:8] + files[2][:4], files[1][8:] + files[2][4:]  # some come a file late, within the delay
    files.append([(at(600), "z", 0.0, 0.0)])  # moves the watermark past all of them
    files.append([(at(20), "d1", 0.0, 0.0), (at(601), "z", 0.0, 0.1)])  # too late: dropped
    inside = F.col("lat") > 30
    got, progress = run(spark, lambda s: tracks.tracks(s, "device", "ts", "lat", "lng", inside, "30 minutes"), files, tmp_path)
    want = tracks.tracks(spark.createDataFrame(rows, SCHEMA), "device", "ts", "lat", "lng", inside).collect()
    form = lambda r: (r.device, r.time, r.fixes, round(r.metres, 3), None if r.heading is None else round(r.heading, 6), r.exited)
    assert sorted(map(form, got), key=repr) == sorted(map(form, want), key=repr)
    assert any(r.exited for r in got)


def test_idle_state_is_dropped(spark, tmp_path, rocks):
    hour = 3_600_000
    files = [[(at(0), "a", 1.0, 1.0), (at(5), "a", 1.0, 1.1)], [(at(400), "b", 1.0, 1.0)], [(at(800), "a", 2.0, 2.0)], [(at(1600), "c", 1.0, 1.0)], [(at(2400), "c", 1.0, 1.0)]]
    got, progress = run(spark, lambda s: tracks.tracks(s, "device", "ts", "lat", "lng", F.lit(True), "1 minute", hour), files, tmp_path)
    assert sorted((r.device, r.time, r.fixes) for r in got) == [("a", at(0), 1), ("a", at(5), 2), ("a", at(800), 1), ("b", at(400), 1), ("c", at(1600), 1)]
    table = tracks.tracks(spark.createDataFrame([r for f in files for r in f], SCHEMA), "device", "ts", "lat", "lng", F.lit(True), idle_ms=hour)
    assert {(r.device, r.time, r.fixes) for r in table.collect()} == {(r.device, r.time, r.fixes) for r in got} | {("c", at(2400), 1)}


def test_table_edge_cases(spark):
    df = spark.createDataFrame([(at(0), None, 1.0, 1.0), (None, "a", 1.0, 1.0), (at(1), "a", None, 1.0), (at(2), "a", 1.0, 1.0)], SCHEMA)
    assert [(r.fixes, r.metres, r.heading, r.exited) for r in tracks.tracks(df, "device", "ts", "lat", "lng", F.lit(None).cast("boolean")).collect()] == [(1, 0.0, None, False)]
    assert tracks.tracks(df.limit(0), "device", "ts", "lat", "lng", F.lit(True)).count() == 0


def test_sliding_and_sessions_on_a_stream_with_late_rows(spark, tmp_path):
    files = [[(at(1), "a", 1.0, 0.0), (at(12), "a", 2.0, 0.0)], [(at(8), "a", 4.0, 0.0), (at(100), "b", 8.0, 0.0)], [(at(150), "b", 1.0, 0.0)], [(at(2), "a", 16.0, 0.0), (at(300), "c", 1.0, 0.0)]]
    got, _ = run(spark, lambda s: windows.sliding(s, "ts", "20 minutes", "10 minutes", "lat", "15 minutes"), files, tmp_path / "w")
    done = {r.start: (r.n, r.total) for r in got if r.start < at(100)}
    assert done[at(0)] == (3, 7.0) and done[at(10)] == (1, 2.0) and (8, 1) not in done.values()  # the row of minute 2 came after its windows had gone
    got, _ = run(spark, lambda s: windows.sessions(s, "ts", "10 minutes", "device", "15 minutes"), files, tmp_path / "s")
    assert {(r.device, r.start): r.n for r in got if r.device == "a"} == {("a", at(1)): 3}
