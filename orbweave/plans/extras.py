"""Queries over boxes of two tables, fences, tool logs and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions.expressions import in_polygon
from orbweave.operators import audit, rasters, relational, spatial, temporal
from orbweave.plans.catalog import Catalog
from orbweave.plans.places import _BOXES, _boxes

FOUND = Catalog()
add = FOUND.add

_MOVED = f"a AS ({_BOXES}), b AS (SELECT k + 3 AS k, minx + 150 + k * 20 AS minx, miny AS miny, maxx + 150 + k * 20 AS maxx, maxy FROM a)"
_MET = "a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy"


def _moved(t):
    by = 150 + F.col("k") * 20
    return _boxes(t).select((F.col("k") + 3).alias("k"), (F.col("minx") + by).alias("minx"), "miny", (F.col("maxx") + by).alias("maxx"), "maxy")


@add(f"WITH {_MOVED} SELECT a.k, b.k AS region FROM a JOIN b ON {_MET}")
def d17_boxes_meet(t):
    return spatial.boxes_meet(_boxes(t), _moved(t).withColumnRenamed("k", "region"), "k", "region", 200.0)


@add(f"WITH {_MOVED} SELECT k, CASE WHEN EXISTS (SELECT 1 FROM b WHERE {_MET}) THEN 'modified' ELSE 'removed' END AS change FROM a UNION ALL SELECT k, 'added' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_MET})")
def h06_changes_by_place(t):
    return spatial.changes_by_place(_boxes(t), _moved(t), "k", 200.0)


@add('SELECT l_partkey % 64 AS "row", l_suppkey % 64 AS col, 900.0 AS area, (l_suppkey % 64) * 30.0 AS x0, 5000 - (l_partkey % 64) * 30.0 AS y1 FROM lineitem GROUP BY 1, 2, 4, 5')
def j19_cell_rings(t):
    p = t("lineitem").select((F.col("l_partkey") % 64).alias("row"), (F.col("l_suppkey") % 64).alias("col")).distinct()
    p = rasters.cell_rings(p, (0.0, 5000.0), 30.0)
    return p.select("row", "col", F.round(spatial.ring_area("ring"), 6).alias("area"), F.col("ring")[0]["x"].alias("x0"), F.col("ring")[2]["y"].alias("y1"))


_FENCE = [(0.0, 0.0), (40.0, 0.0), (40.0, 30.0), (0.0, 30.0)]


@add("WITH f AS (SELECT event_id, user_id, ts, event_id % 50 < 40 AND event_id % 37 < 30 AS i FROM events) SELECT event_id, user_id FROM (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM f) WHERE was AND NOT i")
def m07_exits(t):
    e = t("events").withColumn("at", F.struct("ts", "event_id"))
    inside = in_polygon(F.col("event_id") % 50, F.col("event_id") % 37 + 0.5, _FENCE)
    return temporal.exits(e, "user_id", "at", inside).select("event_id", "user_id")


@add("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (user_id % 5 = 0) AS errors, round(avg((user_id % 5 <> 0)::INT) * 100, 6) AS rate, round(avg(value), 6) AS mean_s FROM events GROUP BY 1")
def e26_tools(t):
    call = F.struct(F.col("event_type").alias("tool"), (F.col("user_id") % 5 != 0).alias("ok"), F.col("value").alias("seconds"))
    s = audit.tools(t("events").select(F.to_json(F.array(call)).alias("log")), "log")
    return s.withColumns({"rate": F.round("rate", 6), "mean_s": F.round("mean_s", 6)})


@add("SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NULL THEN 'right' WHEN r.k IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders) l FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 > 0) r ON l.k = r.k")
def h07_id_overlap(t):
    return relational.id_overlap(t("orders").select(F.col("o_custkey").alias("k")), t("customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k")), "k")
