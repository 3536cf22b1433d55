"""Events matched by time, tracks held against places, columns of times."""

import datetime
import random

from orbweave.operators import temporal

START = datetime.datetime(2024, 1, 1)


def events(spark, times):
    rows = [(i, None if t is None else START + datetime.timedelta(microseconds=t)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "id long, ts timestamp")


def brute_matches(left, right, reach):
    """Closest pairs of times first; of times as near the earlier; events of one time by their ids."""
    a, b = ({i: t for i, t in enumerate(x) if t is not None} for x in (left, right))
    done = set()
    while True:
        def near(t, others):
            inside = [u for u in others if abs(u - t) <= reach]
            return min(inside, key=lambda u: (abs(u - t), u)) if inside else None

        ts, us = set(a.values()), set(b.values())
        best, back = {t: near(t, us) for t in ts}, {u: near(u, ts) for u in us}
        mutual = [(t, u) for t, u in best.items() if u is not None and back[u] == t]
        if not mutual:
            return done
        for t, u in mutual:
            for i, j in zip(sorted(k for k in a if a[k] == t), sorted(k for k in b if b[k] == u)):
                done.add((i, j, abs(t - u) / 1e6))
                del a[i], b[j]


def test_as_of_of_a_hot_key(spark):
    rand = random.Random(9)
    kind = "k long, ts timestamp, v double"
    at = lambda t: START + datetime.timedelta(seconds=t)
    right = [(rand.choice([1, 1, 1, 2, None]), t, None if rand.random() < 0.3 else float(i)) for i, t in enumerate(rand.sample(range(4000), 600))]
    left = [(i, rand.choice([1, 1, 1, 2, 3, None]), rand.randrange(4000)) for i in range(500)]
    got = temporal.as_of(spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "id long, k long, ts timestamp"), spark.createDataFrame([(k, at(t), v) for k, t, v in right], kind), ["k"], "ts", "v")
    assert got.columns == ["id", "k", "ts", "asof_v"]
    want = {}
    for i, k, t in left:
        past = [(u, v) for j, u, v in right if j == k and u <= t and v is not None]
        want[i] = max(past)[1] if past else None
    assert {r.id: r.asof_v for r in got.collect()} == want
    assert temporal.as_of(got.select("k", "ts").limit(0), spark.createDataFrame([], kind), ["k"], "ts", "v").count() == 0


def test_matched_times(spark):
    rand = random.Random(5)
    for n, m, spread in ((40, 50, 400), (60, 20, 60), (30, 30, 5), (0, 5, 5), (5, 0, 5)):
        left = [rand.randrange(spread) * 100_000 for _ in range(n)] + [None]
        right = [rand.randrange(spread) * 100_000 for _ in range(m)] + [None]
        got = {(r.left_id, r.right_id, r.gap_s) for r in temporal.matched_times(events(spark, left), events(spark, right), "ts", "id", 1.5).collect()}
        assert got == brute_matches(left, right, 1_500_000)


def test_a_busy_time_takes_one_round(spark):
    left, right = events(spark, [7] * 300), events(spark, [7] * 200 + [9] * 200)
    got = temporal.matched_times(left, right, "ts", "id", 1).collect()
    assert sorted(r.left_id for r in got) == list(range(300)) and len({r.right_id for r in got}) == 300
    assert sum(r.gap_s == 0 for r in got) == 200


def test_event_pairs_of_busy_and_missing_times(spark):
    left, right = events(spark, [0, 10, 10, None, 5_000_000]), events(spark, [10, 10, None, 0, 20])
    got = {(r.left_id, r.right_id, r.gap_s) for r in temporal.event_pairs(left, right, "ts", "id", 2).collect()}
    assert got == {(0, 3, 0.0), (1, 0, 0.0), (2, 0, 0.0)}
    tied = temporal.event_pairs(events(spark, [100]), events(spark, [200, 0]), "ts", "id", 1).collect()
    assert [tuple(r) for r in tied] == [(0, 0, 0.0001)]


def test_aligned_events(spark):
    def source(name, times):
        return events(spark, times).withColumnRenamed("id", name)

    a, b, c = source("a", [0, 10_000_000, None]), source("b", [400_000, 30_000_000]), source("c", [30_100_000, 10_900_000, 60_000_000])
    got = temporal.aligned_events([a, b, c], "ts", ["a", "b", "c"], 1.0)
    assert got.columns == ["ts", "src0_a", "src1_b", "src2_c"]
    rows = {(None if r.ts is None else (r.ts - START).total_seconds(), r.src0_a, r.src1_b, r.src2_c) for r in got.collect()}
    assert rows == {(0.0, 0, 0, None), (10.0, 1, None, 1), (None, 2, None, None), (30.0, None, 1, 0), (60.0, None, None, 2)}
    assert temporal.aligned_events([a], "ts", ["a"], 1.0).count() == 3
    assert temporal.aligned_events([a.limit(0), b], "ts", ["a", "b"], 1.0).count() == 2


def test_track_to_places(spark):
    track = spark.createDataFrame([(1, 0.0, 0.0, START), (2, 9.0, 0.0, START), (3, None, 0.0, START)], "id long, x double, y double, ts timestamp")
    places = spark.createDataFrame([(7, 1.0, 0.0, START + datetime.timedelta(seconds=30)), (8, 9.0, 1.0, START + datetime.timedelta(hours=1))], "place long, x double, y double, ts timestamp")
    got = temporal.track_to_places(track, places, "id", "ts", 60, 4.0).collect()
    assert [(r.id, r.r_place, r.distance) for r in got] == [(1, 7, 1.0)]
    timeless = temporal.track_to_places(track, places.drop("ts"), "id", "ts", 60, 4.0).where("r_place IS NOT NULL")
    assert sorted((r.id, r.r_place) for r in timeless.collect()) == [(1, 7), (2, 8)]


def test_temporal_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "x", START, "2024"), ("2024-02-03 04:05:06", "y", START, "soon"), (None, None, None, "later")], "`start date` string, birthdate string, seen timestamp, kind string")
    assert temporal.temporal_columns(df) == ["start date", "seen"]
    assert temporal.temporal_columns(df.limit(0)) == ["seen"]


def test_tables_columns_and_queries_to_files(spark, tmp_path):
    import pytest

    from orbweave.sources import io

    spark.range(3).createOrReplaceTempView("seen_ids")
    spark.sql("SELECT 1 AS a, 'x' AS `b c`").createOrReplaceTempView("seen_pair")
    assert {(r.table, r.temporary) for r in io.tables(spark, "seen_*").collect()} == {("seen_ids", True), ("seen_pair", True)}
    assert [(r.table, r.position, r.column, r.type) for r in io.columns(spark, "seen_*").collect()] == [("seen_ids", 1, "id", "bigint"), ("seen_pair", 1, "a", "int"), ("seen_pair", 2, "b c", "string")]
    assert io.columns(spark, "nothing_like_it").count() == 0
    io.query_to(spark, "SELECT id FROM seen_ids WHERE id > :least", f"{tmp_path}/out.parquet", least=0)
    assert spark.read.parquet(f"{tmp_path}/out.parquet").count() == 2
    with pytest.raises(PermissionError):
        io.query_to(spark, "DROP VIEW seen_ids", f"{tmp_path}/no.parquet")


def test_stretches_of_times_settle_what_nothing_outside_can_undo(spark, monkeypatch):
    """Stretches of a few times, whose ends cut through runs of ties and of ever closer neighbours, give what one pass over all pairs gives."""
    import datetime
    import random

    monkeypatch.setattr(temporal, "CHUNK", 7)
    rng = random.Random(4)
    for spread, window in ((40, 3), (400, 50)):
        sides = [[(100 * k + s, rng.randrange(spread)) for k in range(n)] for s, n in ((0, 60), (1, 45))]
        base = datetime.datetime(2024, 1, 1)
        dfs = [spark.createDataFrame([(k, base + datetime.timedelta(seconds=t)) for k, t in rows], "id long, ts timestamp") for rows in sides]
        pairs = sorted((abs(t - u), min(t, u), k, m) for k, t in sides[0] for m, u in sides[1] if abs(t - u) <= window)
        want, gone = set(), set()
        for d, _, k, m in pairs:
            if k not in gone and m not in gone:
                gone |= {k, m}
                want.add((k, m, float(d)))
        assert {tuple(r) for r in temporal.matched_times(*dfs, "ts", "id", window).collect()} == want


def test_no_window_frame_ends_at_the_last_row(spark):
    """A frame from a row to the last one is gone through anew for each row: the square of a bucket."""
    e = spark.range(10).selectExpr("id", "timestamp_seconds(id) AS ts")
    plan = temporal.event_pairs(e, e, "ts", "id", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
