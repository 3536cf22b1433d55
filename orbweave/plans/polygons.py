"""Queries over polygons: customers are L-shaped parcels, suppliers square rings around a hole; SQL counts their unit cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators import overlay
from orbweave.plans.catalog import Catalog

FOUND = Catalog()
add = FOUND.add

SIZE = 4.0
_UNITS = """
a AS (SELECT c_custkey AS k, c_nationkey AS g, (c_custkey * 7) % 100 * 3 AS x, c_custkey // 20 * 2 AS y, 1 + c_nationkey % 4 AS n FROM customer),
b AS (SELECT s_suppkey AS k, (s_suppkey * 13) % 97 * 3 AS x, s_suppkey * 3 // 2 AS y, 1 + s_nationkey % 5 AS n FROM supplier),
ua AS (SELECT k, g, x + i AS x, y + j AS y FROM a, range(8) u(i), range(12) v(j) WHERE i < 2 * n AND j < 3 * n AND NOT (i >= n AND j >= n)),
ub AS (SELECT k, x + i AS x, y + j AS y FROM b, range(15) u(i), range(15) v(j)
  WHERE i < 3 * n AND j < 3 * n AND NOT (i BETWEEN n AND 2 * n - 1 AND j BETWEEN n AND 2 * n - 1))"""


def _ring(*corners: tuple[int, int]) -> Column:
    """A ring of corners given in steps of n from (x, y)."""
    at = lambda c, k: (F.col(c) + F.lit(k) * F.col("n")).cast("double").alias(c)
    return F.array(*(F.struct(at("x", i), at("y", j)) for i, j in corners))


def _parcels(t) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    a = t("customer").select(k.alias("k"), n.alias("g"), (k * 7 % 100 * 3).alias("x"), (F.floor(k / 20) * 2).alias("y"), (1 + n % 4).alias("n"))
    return a.select("k", "g", "n", F.array(_ring((0, 0), (2, 0), (2, 1), (1, 1), (1, 3), (0, 3))).alias("rings"))


def _yards(t) -> DataFrame:
    k = F.col("s_suppkey")
    b = t("supplier").select(k.alias("k"), (k * 13 % 97 * 3).alias("x"), F.floor(k * 3 / 2).alias("y"), (1 + F.col("s_nationkey") % 5).alias("n"))
    return b.select("k", F.array(_ring((0, 0), (3, 0), (3, 3), (0, 3)), _ring((1, 1), (2, 1), (2, 2), (1, 2))).alias("rings"))


def _layers(t) -> tuple[overlay.Layer, overlay.Layer]:
    return overlay.Layer(_parcels(t), "k", SIZE), overlay.Layer(_yards(t), "k", SIZE)


def _filled(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.round("area", 4).alias("area")).where("area <> 0")


@add(f"""WITH {_UNITS}
SELECT ua.k AS a, ub.k AS b, count(*)::DOUBLE AS area FROM ua JOIN ub USING (x, y) GROUP BY ALL
UNION ALL SELECT k, NULL, count(*)::DOUBLE FROM ua ANTI JOIN ub USING (x, y) GROUP BY ALL
UNION ALL SELECT NULL, k, count(*)::DOUBLE FROM ub ANTI JOIN ua USING (x, y) GROUP BY ALL""")
def d18_overlay(t):
    return _filled(overlay.overlay(*_layers(t), how="union"), "a", "b")


@add(f"WITH {_UNITS} SELECT k, count(*)::DOUBLE AS area FROM ua ANTI JOIN ub USING (x, y) GROUP BY ALL")
def d19_erase_areas(t):
    return _filled(overlay.measured(overlay.masked(*_layers(t), how="difference"), ["a"]).withColumnRenamed("a", "k"), "k")


@add(f"WITH {_UNITS} SELECT k, count(*)::DOUBLE AS area FROM ua SEMI JOIN ub USING (x, y) GROUP BY ALL")
def d20_clip_areas(t):
    return _filled(overlay.measured(overlay.masked(*_layers(t), how="intersection"), ["a"]).withColumnRenamed("a", "k"), "k")


@add(f"""WITH {_UNITS}, met AS (
  SELECT ua.k AS a, ub.k AS b, count(*) FILTER (ua.x = ub.x AND ua.y = ub.y) AS n FROM ua JOIN ub ON ub.x BETWEEN ua.x - 1 AND ua.x + 1 AND ub.y BETWEEN ua.y - 1 AND ua.y + 1 GROUP BY ALL)
SELECT a, b, n::DOUBLE AS shared_area, n = (SELECT count(*) FROM ua WHERE k = a) AS within, n = (SELECT count(*) FROM ub WHERE k = b) AS contains FROM met""")
def d21_ring_join(t):
    return overlay.related(*_layers(t)).withColumn("shared_area", F.round("shared_area", 4))


@add(f"""WITH {_UNITS}, z AS (SELECT k, count(*) AS n FROM ub GROUP BY 1)
SELECT ub.k AS zone, ua.g AS class, count(*)::DOUBLE AS area, round(count(*) * 100 / any_value(z.n), 4) AS percent FROM ua JOIN ub USING (x, y) JOIN z ON z.k = ub.k GROUP BY ALL""")
def d22_tabulate_areas(t):
    parcels, yards = _parcels(t), _yards(t)
    left, right = overlay.Layer(parcels, "k", SIZE), overlay.Layer(yards, "k", SIZE)
    return overlay.tabulated(right, left, overlay.shape_areas(yards, "k"), parcels.select("k", F.col("g").alias("class"))).select("zone", "class", F.round("area", 4).alias("area"), F.round("percent", 4).alias("percent"))


_MERGED = f"""{_UNITS}, m AS (SELECT DISTINCT g, x, y FROM ua)"""


@add(f"""WITH {_MERGED}, e AS (SELECT m.g, count(*) AS free FROM m, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(i, j) WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.g = m.g AND o.x = m.x + i AND o.y = m.y + j) GROUP BY 1)
SELECT g, (SELECT count(*) FROM m WHERE m.g = e.g)::DOUBLE AS area, free::DOUBLE AS length FROM e""")
def c15_dissolve(t):
    return overlay.measured(overlay.dissolved(_parcels(t), "g", SIZE), ["g"]).select("g", F.round("area", 4).alias("area"), F.round("length", 4).alias("length"))


@add(f"""WITH {_MERGED}, c AS (SELECT g, x + i AS x, y + j AS y, count(*) AS n, count(DISTINCT (i + j) % 2) AS kinds FROM m, range(2) u(i), range(2) v(j) GROUP BY 1, 2, 3)
SELECT g, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND kinds = 1 THEN 2 ELSE 0 END)::BIGINT AS corners FROM c GROUP BY 1""")
def c16_outlines(t):
    parts = overlay.outlines(overlay.dissolved(_parcels(t), "g", SIZE), ["g"], SIZE)
    return parts.groupBy("g").agg(F.sum(F.size(F.flatten("rings"))).cast("long").alias("corners"))


#: Area, edges and the chords of five outer corners, less the square where the inner corner's sides overlap.
@add("""WITH a AS (SELECT c_custkey AS k, 1 + c_nationkey % 4 AS n FROM customer)
SELECT k, round(4 * n * n + 10 * n * 0.5 + 5 * 0.25 * 8 * sin(pi() / 16) / 2 - 0.25, 4) AS area FROM a""")
def j20_buffer(t):
    return overlay.measured(overlay.buffered(_parcels(t), "k", 0.5, SIZE, quarter=8), ["k"]).select("k", F.round("area", 4).alias("area"))
