"""Edge cases of operators on small literal tables: nulls, ties, empty tables, clashing names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orbweave.functions import expressions as X
from orbweave.operators import charts, graph, privacy, quality, rasters, relational as R, spatial, statistics, temporal
from orbweave.sources import io
from orbweave.streaming import windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_distances(spark):
    d = spark.range(1).select(X.haversine(F.lit(39.9), F.lit(116.4), F.lit(31.23), F.lit(121.47)).alias("d"), X.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("n"), X.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("e")).first()
    assert abs(d.d / 1000 - 1068) < 50
    assert d.n == pytest.approx(0) and d.e == pytest.approx(90)


def test_summary_leaves_out_null_cases(spark):
    df = spark.createDataFrame([("X", 10), ("X", 20), (None, 30)], "category string, value int")
    assert rows(R.summary_statistics(df, "value SUM;value COUNT", "category")) == [("X", 30, 2)]
    assert rows(R.summary_statistics(df, "value MEAN;value MAX")) == [("ALL", 20.0, 30)]
    with pytest.raises(ValueError):
        R.summary_statistics(df, "value FIRST", "category")


def test_attribute_join_meets_nulls_and_renames(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    assert rows(R.attribute_join(a, b, "k")) == [(1, "a", "x"), (3, "c", None), (None, "b", "y")]
    assert R.join_key(a, b) == "k"


def test_cast_and_fill(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ("x",), (None,)], "v string")
    assert rows(R.cast_failures(df, "v", "integer")) == [(2,)]
    assert [r.v for r in R.cast_field(df, "v", "float").orderBy("v").collect()] == [None, None, 1.0, 1.5]
    n = spark.createDataFrame([(1.0,), (1.0,), (4.0,), (None,)], "v double")
    assert rows(R.fill_nulls(n, "v", "mode")) == [(1.0,), (1.0,), (1.0,), (4.0,)]
    assert rows(R.fill_nulls(n, "v", "mean"))[-1] == (4.0,)


def test_changes(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "fid int, area double")
    b = spark.createDataFrame([(2, 20.0), (3, 35.0), (4, 40.0)], "fid int, area double")
    assert rows(R.classify_changes(a, b, "fid", ["area"])) == [(1, "removed"), (2, "unchanged"), (3, "modified"), (4, "added")]
    assert rows(R.classify_changes(a.limit(0), b.limit(0), "fid", ["area"])) == []


def test_spatial_joins(spark):
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 0.0, 2.0, 1.0), (2, 9.0, 9.0, 10.0, 10.0)], "zone_id int, minx double, miny double, maxx double, maxy double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 5.0, 5.0)], "id int, x double, y double")
    assert rows(spatial.points_in_boxes(points, boxes, 0.7).select("id", "zone_id")) == [(1, 0), (2, 1)]
    assert rows(spatial.summarize_within(boxes, points, 0.7, "x")) == [(0, 1, 0.5), (1, 1, 1.0), (2, 0, 0.0)]
    assert rows(spatial.box_pairs(boxes, 0.7, "zone_id")) == [(0, 1, 0.0, 1.0)]
    assert rows(spatial.within_distance(points, points.where("id = 3"), 1.0, "beyond").select("id")) == [(1,), (2,)]


def test_nearest_keeps_ties_and_far_rows(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0)], "id int, x double, y double")
    b = spark.createDataFrame([(7, 1.0, 0.0), (8, -1.0, 0.0)], "id int, x double, y double")
    assert rows(spatial.nearest(a, b, "id", 2.0).select("id", "r_id", "distance")) == [(1, 7, 1.0), (1, 8, 1.0), (2, 7, 999.0)]
    assert rows(spatial.nearest(a, b.limit(0), "id", 2.0)) == []


def test_as_of_prefers_equal_times(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    a = spark.createDataFrame([(1, "u", at(5)), (2, "u", at(1)), (3, "v", at(9))], "id int, k string, ts timestamp")
    b = spark.createDataFrame([("u", at(2), 10.0), ("u", at(5), 20.0)], "k string, ts timestamp, x double")
    assert rows(temporal.as_of(a, b, ["k"], "ts", "x").select("id", "asof_x")) == [(1, 20.0), (2, None), (3, None)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4)], "src int, dst int")
    assert rows(graph.triangles(e)) == [(1, 1), (2, 1), (3, 1)]
    assert rows(graph.hops(e, spark.createDataFrame([(1,)], "id int"), 2)) == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_quality(spark):
    df = spark.createDataFrame([("a@b.org", None, "x"), ("", "y", "y"), (None, None, None)], "a string, b string, c string")
    assert rows(quality.completeness(df, ["a"])) == [("a", pytest.approx(100 / 3), "fail")]
    assert dict(rows(quality.pii(df, "a")))["email"] == 1
    assert rows(quality.resolve(df, ["b", "c"], "v").select("v", "v_source")) == [("x", "c"), ("y", "b"), (None, None)]
    assert rows(quality.conflicts(df, ["b", "c"])) == []


def test_effects(spark):
    panel = spark.createDataFrame([(r, p, 50.0 + 5 * r + 2 * p - 8 * r * p) for r in (0, 1) for p in (0, 1) for _ in range(3)], "region int, post int, pm double")
    assert statistics.diff_in_diff(panel, "region", "post", "pm").first().effect == pytest.approx(-8)
    assert rows(charts.shares(panel, "region")) == [(0, 6, 50.0), (1, 6, 50.0)]


def test_personal_data(spark):
    texts = [
        "mail a.b@c.example.org, card 4111111111111111 (not 4111111111111112), phone +8613912345678.", "ids 11010519491231002X and 110105194912310021, ip 10.0.0.255 but 10.0.0.256, at 116.3974, 399.1234",
        None, "", "x" * 300_000 + "@", "a@" * 50_000, "....@....", "order 1234567",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.kind, r.value) for r in privacy.personal(df, "id", "text").collect())
    assert got == [(0, "bank_card", "4111111111111111"), (0, "email", "a.b@c.example.org"), (0, "phone", "8613912345678"), (1, "coordinate", "116.3974"), (1, "id_card", "11010519491231002X"), (1, "ip", "10.0.0.255")]
    clean = {r.id: r.c for r in df.select("id", privacy.redacted(F.col("text")).alias("c")).collect()}
    assert clean[0] == "mail [EMAIL], card [BANK_CARD] (not 4111111111111112), phone +[PHONE]." and clean[2] is None and [clean[k] for k in range(3, 8)] == texts[3:]
    levels = {r["column"]: (r.email, r.bank_card, r.id_card, r.level) for r in privacy.sensitivity(df, ["text", "id"]).collect()}
    assert levels == {"text": (1, 1, 1, "restricted"), "id": (0, 0, 0, "public")}
    assert privacy.personal(df.limit(0), "id", "text").count() == 0


def test_io_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 116.4, 39.9)], "id int, lng double, lat double")
    io.save(df, str(tmp_path / "x.csv"))
    back = io.with_point(io.load(spark, str(tmp_path / "x.csv")))
    assert back.first().geometry.x == 116.4 and back.schema["geometry"].metadata["crs"] == "EPSG:4326"
    with pytest.raises(PermissionError):
        io.read_only(spark, "DROP TABLE IF EXISTS nothing")
    df.createOrReplaceTempView("one")
    assert io.read_only(spark, "SELECT id FROM one WHERE id = :n", n=1).count() == 1


def test_windows_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "d", float(m)) for m in (1, 2, 31, 59)], "ts timestamp, device string, value double").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, device string, value double").parquet(src)
    q = windows.tumbling(stream, "ts", "30 minutes", "value", "device").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("w").collect()) == [2, 2]


@pytest.mark.parametrize("sql", [
    "WITH a AS (SELECT 1 AS x) INSERT INTO kept SELECT x FROM a", "FROM kept INSERT INTO kept SELECT a INSERT INTO kept SELECT a + 1", "USE default", "CACHE TABLE c AS SELECT 1",
    "DROP TABLE kept", "INSERT INTO kept VALUES (1)", "CREATE TABLE u AS SELECT 1", "SET x = 1", "TRUNCATE TABLE kept", "CREATE TEMP VIEW v AS SELECT 1", "DELETE FROM kept",
    "SELECT reflect('java.lang.System', 'setProperty', 'orbweave.x', '1')", "SELECT 1 FROM range(2) WHERE java_method('java.util.UUID', 'randomUUID') > ''", "SELECT a FROM kept ORDER BY try_reflect('java.lang.System', 'nanoTime')",
    "SELECT (SELECT max(reflect('java.util.UUID', 'randomUUID'))) AS x", "WITH w AS (SELECT reflect('java.util.UUID', 'randomUUID') AS x) SELECT * FROM w", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM parquet.`/tmp`", "SELECT own_function(1)", "SELECT 1 AS x WHERE EXISTS (SELECT * FROM csv.`/etc/passwd`)",
])
def test_read_only_refuses(spark, sql):
    spark.sql("CREATE TABLE IF NOT EXISTS kept (a INT) USING parquet")
    with pytest.raises(PermissionError):
        io.read_only(spark, sql)
    assert spark.table("kept").count() == 0


def test_read_only_reads(spark):
    assert io.read_only(spark, "SELECT 'xCommand; DROP TABLE y' AS c, :v AS v", v=3).collect()[0].v == 3
    assert io.read_only(spark, "WITH a AS (SELECT 1 AS x UNION ALL SELECT 2) SELECT count(*) AS n FROM a WHERE x IN (SELECT max(x) FROM a)").collect()[0].n == 1
    spark.sql("CREATE TABLE IF NOT EXISTS kept (a INT) USING parquet")
    assert io.read_only(spark, "SELECT upper('a') AS u, explode(array(1, 2)) AS e, sum(id) OVER (PARTITION BY id % 2) AS s FROM range(3) LEFT JOIN default.kept ON a = id").count() == 6


def test_nearest_keeps_every_left_row(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 1e6, 1e6)], "id int, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0), (8, -3.0, -4.0), (9, None, None)], "rid int, x double, y double")
    got = sorted((r.id, r.r_rid, r.distance) for r in spatial.nearest(left, right, "id", 2.0).where("id = 1").collect())
    assert got == [(1, 7, 5.0), (1, 8, 5.0)]
    rest = {r.id: r for r in spatial.nearest(left, right, "id", 2.0).where("id > 1").collect()}
    assert rest[2].distance is None and rest[3].r_rid == 7 and len(rest) == 2


def test_moran_z(spark):
    n = 6
    df = spark.createDataFrame([(i * n + j, float(i)) for i in range(n) for j in range(n)], "k int, v double")
    near = [(i * n + j, a * n + b) for i in range(n) for j in range(n) for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if 0 <= a < n and 0 <= b < n]
    r = spatial.moran(df, spark.createDataFrame(near, "a int, b int"), "k", "v").first()
    w = {}
    for a, b in near:
        w[a, b] = 1 / sum(1 for x, _ in near if x == a)
    s0, s1 = sum(w.values()), sum((w.get((a, b), 0) + w.get((b, a), 0)) ** 2 for a in range(36) for b in range(36)) / 2
    s2 = sum((sum(w.get((a, b), 0) for b in range(36)) + sum(w.get((b, a), 0) for b in range(36))) ** 2 for a in range(36))
    e = -1 / 35
    var = (36**2 * s1 - 36 * s2 + 3 * s0**2) / ((36**2 - 1) * s0**2) - e * e
    assert r.z == pytest.approx((r.moran_i - e) / var**0.5) and r.z > 2 and r.p < 0.01


def test_terrain_does_not_reach_over_holes(spark):
    p = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 3, 9.0)], "row int, col int, v double")
    got = {r.col: (round(r.slope, 6), r.aspect) for r in rasters.terrain(p, "v").collect()}
    assert got == {0: (45.0, 270.0), 1: (45.0, 270.0), 3: (0.0, None)}


def test_rings(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    shapes = spark.createDataFrame([(1, ring), (2, [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)])], "z int, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 2.0), (2, 3.5, 3.0), (3, 9.2, 9.2), (4, None, 1.0)], "id int, x double, y double")
    assert sorted((r.id, r.z) for r in spatial.points_in_rings(pts, shapes, 1.5).collect()) == [(0, 1), (2, 1), (3, 2)]
    assert sorted(r.id for r in spatial.points_in_rings(pts, shapes, 1.5, how="left_anti").collect()) == [1, 4]
    cut = shapes.where("z = 2").withColumn("ring", spatial.clip("ring", (9.25, 0.0, 20.0, 20.0))).select(spatial.ring_area("ring").alias("a")).first()
    assert cut.a == pytest.approx(0.75 * 0.75 / 2)
    assert spatial.ring_area("ring") is not None and shapes.withColumn("ring", spatial.clip("ring", (50.0, 50.0, 60.0, 60.0))).select(F.size("ring").alias("n")).first().n == 0


def test_two_sided(spark):
    import math

    for z in (-3.0, -1.0, 0.0, 0.5, 1.96, 4.0):
        assert spark.range(1).select(F.lit(z).alias("z")).select(spatial.two_sided("z").alias("p")).first().p == pytest.approx(math.erfc(abs(z) / 2**0.5), abs=3e-7)
