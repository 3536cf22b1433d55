"""Queries over values in space: variograms, kriging, weighted regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators import geostatistics
from orbweave.plans.catalog import Catalog

FOUND = Catalog()
add = FOUND.add

_POINTS = "p AS (SELECT c_custkey AS id, c_acctbal AS x, c_custkey::DOUBLE AS y, c_nationkey::DOUBLE AS v, (c_custkey % 7)::DOUBLE AS u FROM customer)"


def _points(t) -> DataFrame:
    k = F.col("c_custkey")
    return t("customer").select(k.alias("id"), F.col("c_acctbal").alias("x"), k.cast("double").alias("y"), F.col("c_nationkey").cast("double").alias("v"), (k % 7).cast("double").alias("u"))


@add(f"""WITH {_POINTS}, d AS (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.v - b.v AS e FROM p a JOIN p b ON a.id < b.id AND abs(a.y - b.y) <= 400 AND abs(a.x - b.x) <= 400)
SELECT floor(d / 50)::INT AS bin, count(*) AS n, round(avg(d), 6) AS distance, round(avg(e * e) / 2, 6) AS gamma FROM d WHERE d < 400 GROUP BY 1""")
def j25_variogram(t):
    v = geostatistics.variogram(_points(t), "id", "v", 50.0, 8)
    return v.select("bin", "n", F.round("distance", 6).alias("distance"), F.round("gamma", 6).alias("gamma"))


#: Of two points the system has a closed answer.
@add(f"""WITH {_POINTS}, s AS (SELECT s_suppkey AS id, s_acctbal AS x, s_suppkey::DOUBLE AS y FROM supplier),
near AS (
  SELECT s.id, p.x, p.y, p.v, sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2) AS d, row_number() OVER (PARTITION BY s.id ORDER BY sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2), p.x, p.y) AS k
  FROM s JOIN p ON abs(s.x - p.x) <= 600 AND abs(s.y - p.y) <= 600 WHERE (s.x - p.x) ** 2 + (s.y - p.y) ** 2 <= 360000),
g AS (SELECT *, CASE WHEN d > 0 THEN 4 + 40 * CASE WHEN d < 500 THEN 1.5 * d / 500 - 0.5 * (d / 500) ** 3 ELSE 1 END ELSE 0 END AS g FROM near WHERE k <= 2),
two AS (
  SELECT a.id, a.v AS v1, b.v AS v2, a.g AS g1, b.g AS g2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d12 FROM g a LEFT JOIN g b ON b.id = a.id AND b.k = 2 WHERE a.k = 1),
w AS (SELECT *, 4 + 40 * CASE WHEN d12 < 500 THEN 1.5 * d12 / 500 - 0.5 * (d12 / 500) ** 3 ELSE 1 END AS g12 FROM two),
l AS (SELECT *, CASE WHEN v2 IS NULL THEN 1 ELSE 0.5 + (g2 - g1) / (2 * g12) END AS l1 FROM w)
SELECT s.id, round(CASE WHEN v2 IS NULL THEN v1 ELSE l1 * v1 + (1 - l1) * v2 END, 5) AS estimate,
  round(CASE WHEN v2 IS NULL THEN 2 * g1 ELSE l1 * g1 + (1 - l1) * g2 + g1 - (1 - l1) * g12 END, 5) AS variance, CASE WHEN l.id IS NULL THEN 0 WHEN v2 IS NULL THEN 1 ELSE 2 END AS n
FROM s LEFT JOIN l ON l.id = s.id""")
def j27_kriging(t):
    k = F.col("s_suppkey")
    s = t("supplier").select(k.alias("id"), F.col("s_acctbal").alias("x"), k.cast("double").alias("y"))
    got = geostatistics.krige(_points(t), s, "id", "v", geostatistics.Model("spherical", 4.0, 44.0, 500.0), 600.0, neighbours=2)
    return got.select("id", F.round("estimate", 5).alias("estimate"), F.round("variance", 5).alias("variance"), "n")


@add(f"""WITH {_POINTS}, m AS (
  SELECT a.id, any_value(a.u) AS own_u, any_value(a.v) AS own_v, count(*) AS n, sum(w) AS sw, sum(w * b.u) AS su, sum(w * b.u * b.u) AS suu, sum(w * b.v) AS sv, sum(w * b.u * b.v) AS suv, sum(w * b.v * b.v) AS svv
  FROM (SELECT a.id, a.u, a.v, b.id AS bid, (1 - ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 640000.0) ** 2 AS w FROM p a JOIN p b ON abs(a.x - b.x) <= 800 AND abs(a.y - b.y) <= 800 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 640000) a JOIN p b ON b.id = a.bid GROUP BY a.id),
c AS (SELECT *, CASE WHEN suu > 0 AND 1 - su * su / (sw * suu) >= 1e-9 THEN (sw * suv - su * sv) / (sw * suu - su * su) END AS slope FROM m)
SELECT id, n, round((sv - slope * su) / sw, 5) AS intercept, round(slope, 5) AS coef_u, round(own_v - (sv - slope * su) / sw - slope * own_u, 5) AS residual FROM c""")
def k23_weighted_regression(t):
    got = geostatistics.weighted_regression(_points(t), "id", "v", ["u"], 800.0)
    return got.select("id", "n", *(F.round(c, 5).alias(c) for c in ("intercept", "coef_u", "residual")))
