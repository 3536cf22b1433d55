"""Queries over time, graphs, vectors and effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import expressions as X
from orbweave.operators import graph, statistics, temporal
from orbweave.plans.catalog import Catalog
from orbweave.streaming import windows

FOUND = Catalog()
add = FOUND.add

_EDGES = "SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey % 500 AS dst FROM lineitem WHERE l_quantity > 49"


def _edges(t):
    return t("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("src"), (1_000_000 + F.col("l_partkey") % 500).alias("dst")).distinct()


@add("""SELECT o_orderkey, (SELECT arg_max(value, ts) FROM events e WHERE e.user_id = o.o_custkey AND e.ts <= o.o_orderdate) AS asof_value FROM orders o""")
def d10_as_of_join(t):
    left = t("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    return temporal.as_of(left, t("events").select("user_id", "ts", "value"), ["user_id"], "ts", "value").select("o_orderkey", "asof_value")


@add("""WITH p AS (SELECT a.event_id AS left_id, b.event_id AS right_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 AS gap_s FROM events a JOIN events b ON a.event_type = 'purchase' AND b.event_type = 'click' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 30000000)
SELECT left_id, right_id, gap_s FROM p QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY gap_s, right_id) = 1""")
def d11_event_pairs(t):
    e = t("events")
    return temporal.event_pairs(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "ts", "event_id", 30)


@add("""WITH s AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS step FROM events), m AS (SELECT user_id, quantile_cont(step, 0.5) AS median_s, count(*) FILTER (step = 0) AS repeats FROM s GROUP BY 1)
SELECT user_id, round(median_s, 6) AS median_s, repeats, count(*) FILTER (step > 3 * median_s) AS n_gaps FROM s JOIN m USING (user_id) GROUP BY ALL""")
def f04_gaps(t):
    return temporal.gaps(t("events"), ["user_id"], "ts", 3.0).withColumn("median_s", F.round("median_s", 6))


@add("""WITH g AS (SELECT user_id, max(ts) FILTER (ts <= TIMESTAMP '2024-01-15') AS t0, arg_max(value, ts) FILTER (ts <= TIMESTAMP '2024-01-15') AS v0, min(ts) FILTER (ts >= TIMESTAMP '2024-01-15') AS t1, arg_min(value, ts) FILTER (ts >= TIMESTAMP '2024-01-15') AS v1 FROM events GROUP BY 1)
SELECT user_id, round(coalesce(v0 + (v1 - v0) * coalesce((epoch_us(TIMESTAMP '2024-01-15') - epoch_us(t0))::DOUBLE / nullif(epoch_us(t1) - epoch_us(t0), 0), 0), v0, v1), 6) AS value FROM g""")
def f05_interpolate(t):
    return temporal.interpolate(t("events"), ["user_id"], "ts", "2024-01-15", "value").withColumn("value", F.round("value", 6))


@add("""SELECT user_id, arg_min(value, epoch_us(ts) % 1) AS value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')), ts) = 1) GROUP BY 1""")
def f06_nearest_in_time(t):
    return temporal.nearest_in_time(t("events"), ["user_id"], "ts", "2024-01-15", "value")


@add("""WITH p AS (SELECT user_id, ts, event_id, value % 90 AS lat, event_id % 180 AS lng FROM events), s AS (SELECT user_id, lat, lng, lag(lat) OVER w AS a, lag(lng) OVER w AS b FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, count(*) AS fixes, round(coalesce(sum(2 * 6371000 * asin(sqrt(least(1, sin(radians(lat - a) / 2) ** 2 + cos(radians(a)) * cos(radians(lat)) * sin(radians(lng - b) / 2) ** 2)))) FILTER (a IS NOT NULL), 0), 2) AS metres FROM s GROUP BY 1""")
def m01_trajectories(t):
    e = t("events").select("user_id", "ts", (F.col("value") % 90).alias("lat"), (F.col("event_id") % 180).cast("double").alias("lng"))
    return temporal.trajectories(e, "user_id", "ts", "lat", "lng").select("user_id", "fixes", F.round("metres", 2).alias("metres"))


@add("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, count(DISTINCT user_id) AS devices, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread FROM events GROUP BY 1""")
def m02_tumbling(t):
    w = windows.tumbling(t("events"), "ts", "1 hour", "value", "user_id")
    return w.withColumns({c: F.round(c, 6) for c in ("mean", "spread")})


@add("""SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) GROUP BY 1""")
def m03_sliding(t):
    return windows.sliding(t("events"), "ts", "1 hour", "30 minutes", "value").withColumn("total", F.round("total", 4))


@add("""WITH s AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def m04_sessions(t):
    return windows.sessions(t("events"), "ts", "1 hour", "user_id")


@add("SELECT event_id FROM events WHERE NOT (value > 10 AND value < 60 AND user_id > 5 AND user_id < 100)")
def m05_geofence(t):
    inside = (F.col("value") > 10) & (F.col("value") < 60) & (F.col("user_id") > 5) & (F.col("user_id") < 100)
    return windows.geofence_alerts(t("events"), inside).select("event_id")


@add(f"""WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), u AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT u.dst, hop + 1 FROM r JOIN u ON u.src = r.id WHERE hop < 2)
SELECT id, min(hop) AS hop FROM r GROUP BY 1""")
def k03_hops(t):
    e = _edges(t)
    return graph.hops(e, e.sparkSession.range(1, 2), 2)


@add(f"WITH e AS ({_EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS id, count(*) AS degree FROM u GROUP BY 1")
def k04_degrees(t):
    return graph.degrees(_edges(t))


_TRIPLES = "SELECT DISTINCT l_suppkey % 40 AS src, l_partkey % 60 AS dst FROM lineitem WHERE l_quantity > 45 AND l_suppkey % 40 <> l_partkey % 60"


@add(f"""WITH e AS ({_TRIPLES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM u a JOIN u b ON a.dst = b.src AND a.src < a.dst AND b.src < b.dst JOIN u c ON c.src = a.src AND c.dst = b.dst)
SELECT id, count(*) AS triangles FROM (SELECT unnest([x, y, z]) AS id FROM t) GROUP BY 1""")
def k05_triangles(t):
    e = t("lineitem").where("l_quantity > 45").select((F.col("l_suppkey") % 40).alias("src"), (F.col("l_partkey") % 60).alias("dst")).distinct()
    return graph.triangles(e)


@add("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 4) AS similarity FROM embeddings, q WHERE vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 10""")
def k06_similar_vectors(t):
    return statistics.similar(t("embeddings"), t("embeddings").where("vec_id = 0"), "vec_id", "embedding")


@add("SELECT 'o_totalprice' AS covariate, round((avg(o_totalprice) FILTER (h) - avg(o_totalprice) FILTER (NOT h)) / sqrt((var_pop(o_totalprice) FILTER (h) + var_pop(o_totalprice) FILTER (NOT h)) / 2), 6) AS smd FROM (SELECT *, o_orderpriority = '1-URGENT' AS h FROM orders)")
def k07_balance(t):
    o = t("orders").withColumn("treated", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    return statistics.balance(o, "treated", ["o_totalprice"]).withColumn("smd", F.round("smd", 6))


@add("""WITH d AS (SELECT o_totalprice AS y, o_orderpriority = '1-URGENT' AS a, o_orderdate >= TIMESTAMP '1995-01-01' AS b FROM orders)
SELECT round((avg(y) FILTER (a AND b) - avg(y) FILTER (a AND NOT b)) - (avg(y) FILTER (NOT a AND b) - avg(y) FILTER (NOT a AND NOT b)), 6) AS effect, count(*) AS n FROM d""")
def k08_diff_in_diff(t):
    d = t("orders").select(F.col("o_totalprice").alias("y"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("a"), (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")).cast("int").alias("b"))
    return statistics.diff_in_diff(d, "a", "b", "y").withColumn("effect", F.round("effect", 6))


@add("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem")
def k09_trend(t):
    r = statistics.trend(t("lineitem"), "l_quantity", "l_extendedprice")
    return r.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 4), "r2": F.round("r2", 6)})


@add("""SELECT scenario, round(b, 4) AS base, round(b * m, 4) AS mean, round((m - 1) * 100, 6) AS percent, row_number() OVER (ORDER BY m DESC)::INT AS rank FROM (SELECT avg(o_totalprice) AS b FROM orders), (VALUES ('low', 0.8), ('high', 1.3), ('same', 1.0)) v(scenario, m)""")
def k10_what_if(t):
    w = statistics.what_if(t("orders"), "o_totalprice", {"low": 0.8, "high": 1.3, "same": 1.0})
    return w.withColumns({"base": F.round("base", 4), "mean": F.round("mean", 4), "percent": F.round("percent", 6)})


@add("""SELECT c_custkey, round(CASE WHEN hi > lo THEN 1 - greatest(0, least(1, (c_acctbal - lo) / (hi - lo))) END, 9) AS cost FROM customer, (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer)""")
def k11_min_max(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    edge = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return c.crossJoin(F.broadcast(edge)).select("c_custkey", F.round(X.min_max(F.col("c_acctbal"), F.col("lo"), F.col("hi"), invert=True), 9).alias("cost"))  # one row
