"""Queries over points, boxes and pixels: customers are points (x = balance, y = key), cells and nations are zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import expressions as X
from orbweave.operators import rasters, spatial, statistics
from orbweave.plans.catalog import Catalog

FOUND = Catalog()
add = FOUND.add

BOUNDS, SIDE = (-1000.0, 0.0, 10000.0, 16000.0), 500.0
_CELLS = "SELECT r * 22 + c AS zone_id, -1000 + c * 500.0 AS minx, r * 500.0 AS miny, -1000 + (c + 1) * 500.0 AS maxx, (r + 1) * 500.0 AS maxy FROM range(32) a(r), range(22) b(c)"
_BOXES = "SELECT c_nationkey AS k, min(c_acctbal) AS minx, min(c_custkey)::DOUBLE AS miny, min(c_acctbal) + 400 AS maxx, min(c_custkey)::DOUBLE + 3 AS maxy FROM customer GROUP BY 1"


def _points(t, name: str = "customer", x: str = "c_acctbal", y: str = "c_custkey", key: str = "c_custkey") -> DataFrame:
    return t(name).select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def _boxes(t) -> DataFrame:
    g = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_acctbal").alias("minx"), F.min("c_custkey").cast("double").alias("miny"))
    return g.withColumns({"maxx": F.col("minx") + 400, "maxy": F.col("miny") + 3})


@add(_CELLS)
def b01_tessellate(t):
    return spatial.tessellate(BOUNDS, SIDE, t("region"))


@add("SELECT r * 15 + c AS zone_id, round(-1000 + c * 750.0, 6) AS x, round((r + CASE WHEN c % 2 = 1 THEN 0.5 ELSE 0 END) * sqrt(3) * 500, 6) AS y FROM range(19) a(r), range(15) b(c)")
def b02_hexagons(t):
    return spatial.hexagons(BOUNDS, SIDE, t("region")).select("zone_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@add(f"WITH z AS ({_CELLS}) SELECT c_custkey AS id, zone_id FROM customer JOIN z ON c_acctbal >= minx AND c_acctbal < maxx AND c_custkey >= miny AND c_custkey < maxy")
def d06_points_in_boxes(t):
    p = _points(t)
    return spatial.points_in_boxes(p, spatial.tessellate(BOUNDS, SIDE, p), SIDE).select("id", "zone_id")


@add(f"WITH z AS ({_CELLS}) SELECT zone_id, count(c_custkey) AS n, round(coalesce(sum(c_acctbal), 0), 4) AS total FROM z LEFT JOIN customer ON c_acctbal >= minx AND c_acctbal < maxx AND c_custkey >= miny AND c_custkey < maxy GROUP BY 1")
def d05_summarize_within(t):
    p = _points(t)
    zones = spatial.tessellate(BOUNDS, SIDE, p)
    return spatial.summarize_within(zones, p, SIDE, "x").withColumn("total", F.round("total", 4))


@add(f"WITH b AS ({_BOXES}) SELECT l.k AS a, r.k AS b, round((least(l.maxx, r.maxx) - greatest(l.minx, r.minx)) * (least(l.maxy, r.maxy) - greatest(l.miny, r.miny)), 6) AS shared_area FROM b l JOIN b r ON l.k < r.k AND least(l.maxx, r.maxx) >= greatest(l.minx, r.minx) AND least(l.maxy, r.maxy) >= greatest(l.miny, r.miny)")
def d07_box_overlay(t):
    return spatial.box_pairs(_boxes(t), 200.0, "k").select("a", "b", F.round("shared_area", 6).alias("shared_area"))


@add("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE sqrt((c_acctbal - s_acctbal) ** 2 + (c_custkey - s_suppkey) ** 2) <= 50)")
def d08_within_distance(t):
    return spatial.within_distance(_points(t), _points(t, "supplier", "s_acctbal", "s_suppkey", "s_suppkey"), 50.0).select("id")


@add("""WITH d AS (SELECT c_custkey AS id, s_suppkey AS r_id, sqrt((c_acctbal - s_acctbal) ** 2 + (c_custkey - s_suppkey) ** 2) AS distance FROM customer, supplier)
SELECT id, min(r_id) AS r_id, round(min(distance), 6) AS distance FROM (SELECT * FROM d QUALIFY distance = min(distance) OVER (PARTITION BY id)) GROUP BY id""")
def d09_nearest(t):
    n = spatial.nearest(_points(t), _points(t, "supplier", "s_acctbal", "s_suppkey", "s_suppkey"), "id", 200.0)
    return n.groupBy("id").agg(F.min("r_id").alias("r_id"), F.round(F.min("distance"), 6).alias("distance"))


@add("""SELECT c_custkey AS id, round(2 * 6371000 * asin(sqrt(least(1, sin(radians(c_nationkey - 10) / 2) ** 2 + cos(radians(10)) * cos(radians(c_nationkey)) * sin(radians(c_custkey % 180 - 20) / 2) ** 2))), 3) AS metres FROM customer""")
def j01_haversine(t):
    d = X.haversine(F.lit(10.0), F.lit(20.0), F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 180).cast("double"))
    return t("customer").select(F.col("c_custkey").alias("id"), F.round(d, 3).alias("metres"))


@add("""SELECT c_custkey AS id FROM customer WHERE (c_acctbal + c_custkey / 2 < 5000) AND c_acctbal > 0 AND c_custkey > 10""")
def j02_in_polygon(t):
    ring = [(0.0, 10.0), (4995.0, 10.0), (0.0, 10000.0)]
    return _points(t).where(X.in_polygon(F.col("x"), F.col("y"), ring)).select("id")


@add("""WITH p AS (SELECT l_partkey % 64 AS "row", l_suppkey % 64 AS col, avg(l_quantity) AS red, avg(l_tax) * 100 AS nir FROM lineitem GROUP BY 1, 2)
SELECT "row", col, round((nir - red) / (nir + red), 6) AS ndvi FROM p""")
def j03_ndvi(t):
    return _pixels(t).select("row", "col", F.round(statistics.ndvi("red", "nir"), 6).alias("ndvi"))


def _pixels(t) -> DataFrame:
    """A raster as a table: line items fall in 64 by 64 pixels, bands are means."""
    return t("lineitem").groupBy((F.col("l_partkey") % 64).alias("row"), (F.col("l_suppkey") % 64).alias("col")).agg(F.avg("l_quantity").alias("red"), (F.avg("l_tax") * 100).alias("nir"))


@add("""WITH p AS (SELECT l_partkey % 64 AS "row", l_suppkey % 64 AS col, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT row // 8 AS zr, col // 8 AS zc, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean FROM p GROUP BY 1, 2""")
def j04_zonal_statistics(t):
    p = _pixels(t).select((F.col("row") / 8).cast("long").alias("zr"), (F.col("col") / 8).cast("long").alias("zc"), "red")
    return rasters.zonal(p, {"zr": F.col("zr"), "zc": F.col("zc")}, "red").select("zr", "zc", "n", *(F.round(c, 6).alias(c) for c in ("low", "high", "mean")))


@add(f"""WITH b AS ({_BOXES}), e AS (SELECT l.k AS a, r.k AS b FROM b l JOIN b r ON l.k <> r.k AND least(l.maxx, r.maxx) >= greatest(l.minx, r.minx) AND least(l.maxy, r.maxy) >= greatest(l.miny, r.miny)),
z AS (SELECT k, minx - avg(minx) OVER () AS z FROM b), g AS (SELECT a, avg(z) AS lag FROM e JOIN z ON k = b GROUP BY 1)
SELECT count(*) AS n, round(sum(z * lag) / count(lag) * count(*) / sum(z * z), 6) AS moran_i FROM z LEFT JOIN g ON k = a""")
def k01_moran(t):
    b = _boxes(t)
    e = spatial.box_pairs(b, 200.0, "k").select("a", "b")
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return spatial.moran(b, both, "k", "minx").select("n", F.round("moran_i", 6).alias("moran_i"))


@add("SELECT c_custkey AS id, round(greatest(0, least(1, 1 - abs(c_acctbal) / 5000)), 9) AS access FROM customer")
def k02_accessibility(t):
    return _points(t).select("id", F.round(spatial.accessibility(F.abs("x"), 5000.0), 9).alias("access"))
