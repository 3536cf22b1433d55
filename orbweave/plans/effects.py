"""Queries over effects, forecasts, precision of places, aligned events and classes of pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import causality, effects, forecasts, precision, rasters, temporal
from orbweave.plans.catalog import Catalog
from orbweave.plans.fields import _POINTS, _points
from orbweave.plans.more import _BANDS, _bands

FOUND = Catalog()
add = FOUND.add


#: Distances of places along two axes, and neighbours' values as the states of a place.
@add(f"""WITH {_POINTS},
n AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) - 1 AS rank
  FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= 600 AND abs(a.y - b.y) <= 600 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 600 QUALIFY rank < 2),
s AS (SELECT p.id, any_value(p.u) AS cause, coalesce(max(q.v) FILTER (rank = 0), any_value(p.v)) AS e0, coalesce(max(q.v) FILTER (rank = 1), any_value(p.v)) AS e1 FROM p LEFT JOIN n ON src = p.id LEFT JOIN p q ON q.id = dst GROUP BY p.id),
l AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || id), id) AS pos FROM s),
d AS (SELECT size, s.id, s.cause AS t, l.cause AS c, sqrt((s.e0 - l.e0) ** 2 + (s.e1 - l.e1) ** 2) AS d FROM (SELECT unnest([40, 100]) AS size) JOIN l ON pos <= size JOIN s ON s.id <> l.id
  QUALIFY row_number() OVER (PARTITION BY size, s.id ORDER BY d, l.id) <= 3),
w AS (SELECT *, exp(-d / greatest(min(d) OVER (PARTITION BY size, id), 1e-10)) AS w FROM d),
g AS (SELECT size, id, any_value(t) AS t, sum(w * c) / sum(w) AS g FROM w GROUP BY 1, 2)
SELECT size, 0 AS repeat, count(*) AS n, round(corr(t, g), 7) AS rho FROM g GROUP BY 1""")
def k28_cross_map(t):
    p = _points(t)
    near = causality.ranked_neighbours(p, "id", 2, 600.0)
    return causality.cross_map(p, near, "id", "u", "v", [40, 100], 2).withColumn("rho", F.round("rho", 7))


#: Exposure, outcome and one confounder, so that the regression has a closed form.
@add("""WITH a AS (SELECT o_totalprice / 1000 AS e, (o_orderkey % 100)::DOUBLE AS y, (o_custkey % 50)::DOUBLE AS c FROM orders),
q AS (SELECT quantile_cont(e, 0.01) AS lo, quantile_cont(e, 0.99) AS hi FROM a), k AS MATERIALIZED (SELECT a.* FROM a, q WHERE e BETWEEN lo AND hi),
g AS MATERIALIZED (SELECT count(*) AS n, min(e) AS low, max(e) AS high, stddev_pop(e) AS sd, regr_slope(e, c) AS b, regr_intercept(e, c) AS a FROM k),
r AS MATERIALIZED (SELECT e, y, e - a - b * c AS res, least(floor((e - low) / ((high - low) / 512)), 511)::INT AS bin FROM k, g), s AS (SELECT stddev_pop(res) AS sigma FROM r),
h AS (SELECT bin, count(*) AS m FROM r GROUP BY 1),
f AS MATERIALIZED (SELECT edge, sum(m * exp(-0.5 * ((edge - bin - 0.5) * ((high - low) / 512) / (sd * n ** -0.2)) ** 2)) / (any_value(n) * any_value(sd) * any_value(n) ** -0.2 * sqrt(2 * pi())) AS p FROM h, g, range(513) x(edge) GROUP BY 1),
v AS (SELECT e, y, ((1 - ((e - low) / ((high - low) / 512) - bin)) * f0.p + ((e - low) / ((high - low) / 512) - bin) * f1.p) / greatest(exp(-0.5 * (res / sigma) ** 2) / (sigma * sqrt(2 * pi())), 1e-10) AS w
  FROM r JOIN f f0 ON f0.edge = bin JOIN f f1 ON f1.edge = bin + 1, g, s),
u AS MATERIALIZED (SELECT e, y, least(w, (SELECT quantile_cont(w, 0.99) FROM v)) AS w FROM v),
z AS (SELECT point, low + point * ((high - low) / 25) AS exposure, w * exp(-0.5 * ((e - low - point * ((high - low) / 25)) / (1.06 * sd * n ** -0.2)) ** 2) AS k, y FROM u, g, range(26) x(point))
SELECT point, round(any_value(exposure), 6) AS exposure, round(sum(k * y) / sum(k), 5) AS response FROM z GROUP BY 1""")
def k29_exposure_response(t):
    k = F.col("o_orderkey")
    o = t("orders").select((F.col("o_totalprice") / 1000).alias("e"), (k % 100).cast("double").alias("y"), (F.col("o_custkey") % 50).cast("double").alias("c"))
    got = effects.exposure_response(o, "e", "y", ["c"], points=26)
    return got.select("point", F.round("exposure", 6).alias("exposure"), F.round("response", 5).alias("response"))


def _treated(t):
    """Orders of several items against those of few, with what they hold."""
    n = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    o = t("orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"))
    return o.select("o_orderkey", (F.col("n") > 4).cast("int").alias("many"), "quantity", "discount", F.col("o_totalprice").alias("price"))


@add()
def k30_propensity_matched(t):
    return effects.matched_by_propensity(_treated(t), "o_orderkey", "many", "price", ["quantity", "discount"])


@add()
def k31_effects_by_row(t):
    return effects.effects_by_row(_treated(t), "o_orderkey", "many", "price", ["quantity", "discount"], folds=3, trees=10, depth=3).select("o_orderkey", "fold", "effect")


@add("""WITH RECURSIVE m AS (SELECT o_orderpriority AS priority, date_trunc('month', o_orderdate) AS t, count(*)::DOUBLE AS y FROM orders GROUP BY ALL),
s AS MATERIALIZED (SELECT priority, y, row_number() OVER (PARTITION BY priority ORDER BY t) AS i FROM m), w AS (SELECT i / 10 AS a, j / 10 AS b FROM range(1, 10) x(i), range(1, 10) z(j)),
h(priority, a, b, i, level, trend, sse) AS (
  SELECT y1.priority, a, b, 2::BIGINT, y1.y, y1.y - y0.y, 0::DOUBLE FROM s y1 JOIN s y0 USING (priority), w WHERE y1.i = 2 AND y0.i = 1
  UNION ALL SELECT h.priority, a, b, s.i, a * s.y + (1 - a) * (level + trend), b * (a * s.y + (1 - a) * (level + trend) - level) + (1 - b) * trend, sse + (s.y - level - trend) ** 2 FROM h JOIN s ON s.priority = h.priority AND s.i = h.i + 1),
e AS (SELECT * FROM h QUALIFY i = max(i) OVER (PARTITION BY priority)), f AS (SELECT * FROM e WHERE i >= 5 QUALIFY row_number() OVER (PARTITION BY priority ORDER BY sse, a, b) = 1),
g AS (SELECT f.*, p.period, sqrt(sse / (i - 2) * (SELECT 1 + coalesce(sum((a * (1 + j * b)) ** 2), 0) FROM range(1, 13) x(j) WHERE j < p.period)) AS se FROM f, range(1, 13) p(period))
SELECT priority, printf('holt(%.1f,%.1f)', a, b) AS model, period, round(level + period * trend, 4) AS forecast, round(level + period * trend - 1.96 * se, 4) AS low, round(level + period * trend + 1.96 * se, 4) AS high FROM g""")
def f10_holt(t):
    o = t("orders").withColumnRenamed("o_orderpriority", "priority")
    got = forecasts.holt(o, "o_orderdate", "o_orderkey", 12, "month", ["priority"], "count")
    return got.select("priority", "model", "period", *(F.round(c, 4).alias(c) for c in ("forecast", "low", "high")))


@add()
def f11_arima(t):
    return forecasts.arima(t("orders"), "o_orderdate", "o_totalprice", 12, "month", ["o_orderpriority"])


@add("""WITH d AS (SELECT c_custkey AS id, s_suppkey AS reference_key, sqrt((c_acctbal - s_acctbal) ** 2 + (c_custkey - s_suppkey) ** 2) AS distance FROM customer, supplier),
o AS (SELECT id, min(distance) AS distance FROM d GROUP BY 1)
SELECT count(*) AS n, round(avg(distance), 5) AS mean, round(quantile_cont(distance, 0.5), 5) AS median, round(max(distance), 5) AS largest, round(sqrt(avg(distance * distance)), 5) AS rmse, count(*) FILTER (distance <= 100) AS within, CASE WHEN sqrt(avg(distance * distance)) <= 50 THEN 'high' WHEN sqrt(avg(distance * distance)) <= 500 THEN 'medium' ELSE 'low' END AS grade FROM o""")
def d23_place_accuracy(t):
    s = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    one = precision.accuracy(precision.offsets(_points(t), s, "id", size=200.0), 100.0, 50.0, 500.0)
    return one.select("n", *(F.round(c, 5).alias(c) for c in ("mean", "median", "largest", "rmse")), "within", "grade")


@add("""WITH d AS (SELECT o_orderkey AS id, s_suppkey AS place, sqrt((o_totalprice / 50 - s_acctbal) ** 2 + (o_custkey % 100 - s_suppkey) ** 2) AS d, abs(epoch(o_orderdate::TIMESTAMP) - epoch(TIMESTAMP '1992-01-01' + to_days((s_suppkey * 25)::INT))) AS gap FROM orders, supplier),
n AS (SELECT * FROM d QUALIFY d = min(d) OVER (PARTITION BY id))
SELECT id, min(place) AS place, round(min(d), 6) AS distance FROM n WHERE gap <= 200 * 86400 GROUP BY 1""")
def d24_track_to_places(t):
    track = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 50).alias("x"), (F.col("o_custkey") % 100).cast("double").alias("y"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    k = F.col("s_suppkey")
    places = t("supplier").select(k.alias("place"), F.col("s_acctbal").alias("x"), k.cast("double").alias("y"), F.date_add(F.lit("1992-01-01").cast("date"), (k * 25).cast("int")).cast("timestamp").alias("ts"))
    met = temporal.track_to_places(track, places, "id", "ts", 200 * 86400, 500.0)
    return met.groupBy("id").agg(F.min("r_place").alias("place"), F.round(F.min("distance"), 6).alias("distance"))


@add()
def d25_matched_times(t):
    e = t("events")
    return temporal.matched_times(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "ts", "event_id", 6 * 3600)


@add("""WITH e AS (SELECT vec_id AS src, vec_id + d AS dst FROM embeddings, (SELECT unnest([1, 2]) AS d))
SELECT a.vec_id, count(*) AS neighbours, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS coherence FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst GROUP BY 1""")
def g10_coherence(t):
    v = t("embeddings")
    edges = v.select(F.col("vec_id").alias("src"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2)).alias("dst"))
    return precision.coherence(v, edges, "vec_id", "embedding").withColumn("coherence", F.round("coherence", 6))


@add(f"""WITH p AS ({_BANDS}), s AS (SELECT unnest(['red', 'blue']) AS band, unnest([red, blue]) AS v FROM p)
SELECT band, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM s GROUP BY 1""")
def j28_band_percentiles(t):
    q = rasters.band_percentiles(_bands(t), ["red", "blue"], [0.05, 0.5, 0.95])
    return q.select("band", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))))


@add()
def j29_pixel_classes(t):
    return rasters.class_statistics(rasters.cluster_pixels(_bands(t), ["red", "nir", "blue"], 5), ["red", "nir", "blue"])
