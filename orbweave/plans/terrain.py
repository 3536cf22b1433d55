"""Queries over a bumpy surface of 48 by 48 pixels made of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators import surfaces, terrain
from orbweave.plans.catalog import Catalog

FOUND = Catalog()
add = FOUND.add

_DEM = """
dem AS (
  SELECT l_partkey % 48 AS "row", (l_orderkey * 7 + l_linenumber) % 48 AS col, (sum(l_quantity)::BIGINT % 50 + l_partkey % 48)::DOUBLE AS h
  FROM lineitem GROUP BY l_partkey % 48, (l_orderkey * 7 + l_linenumber) % 48),
n AS (
  SELECT a."row", a.col, a.h, b."row" AS tr, b.col AS tc, b.h AS th
  FROM dem a JOIN dem b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (a."row" <> b."row" OR a.col <> b.col)),
rim AS (SELECT dem."row", dem.col, dem.h FROM dem LEFT JOIN n ON n."row" = dem."row" AND n.col = dem.col GROUP BY ALL HAVING count(n.tr) < 8),
rise("row", col, lv) AS (SELECT "row", col, h FROM rim UNION SELECT n.tr, n.tc, greatest(rise.lv, n.th) FROM rise JOIN n ON n."row" = rise."row" AND n.col = rise.col),
f AS MATERIALIZED (SELECT "row", col, min(lv) AS h FROM rise GROUP BY ALL)"""


def _dem(t) -> DataFrame:
    g = t("lineitem").groupBy((F.col("l_partkey") % 48).alias("row"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 48).alias("col"))
    return g.agg(F.sum("l_quantity").cast("long").alias("q")).select("row", "col", (F.col("q") % 50 + F.col("row")).cast("double").alias("h"))


@add(f'WITH RECURSIVE {_DEM} SELECT "row", col, h AS height FROM f')
def j21_filled(t):
    return terrain.filled(_dem(t), "h", tile=16)


_FLOW = f"""{_DEM},
m AS MATERIALIZED (SELECT n."row", n.col, a.h, n.tr, n.tc, b.h AS th FROM n JOIN f a ON a."row" = n."row" AND a.col = n.col JOIN f b ON b."row" = n.tr AND b.col = n.tc),
fall AS (
  SELECT "row", col, tr, tc FROM m WHERE h > th
  QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY (h - th) / sqrt(("row" - tr) ** 2 + (col - tc) ** 2) DESC, tr, tc) = 1),
drains AS (SELECT "row", col FROM fall UNION SELECT "row", col FROM rim),
flat("row", col, d) AS (
  SELECT "row", col, 0 FROM drains
  UNION SELECT m."row", m.col, d + 1 FROM flat JOIN m ON m.tr = flat."row" AND m.tc = flat.col AND m.h = m.th WHERE d < 50 AND NOT EXISTS (SELECT 1 FROM drains x WHERE x."row" = m."row" AND x.col = m.col)),
far AS MATERIALIZED (SELECT "row", col, min(d) AS d FROM flat GROUP BY ALL),
flow AS MATERIALIZED (
  SELECT f."row", f.col, coalesce(fall.tr, o.tr) AS to_row, coalesce(fall.tc, o.tc) AS to_col FROM f LEFT JOIN fall ON fall."row" = f."row" AND fall.col = f.col
  LEFT JOIN (
    SELECT m."row", m.col, m.tr, m.tc FROM m JOIN far a ON a."row" = m."row" AND a.col = m.col JOIN far b ON b."row" = m.tr AND b.col = m.tc
    WHERE m.h = m.th AND a.d > 0 AND b.d = a.d - 1 QUALIFY row_number() OVER (PARTITION BY m."row", m.col ORDER BY m.tr, m.tc) = 1) o ON o."row" = f."row" AND o.col = f.col),
way(r, c) AS (SELECT to_row, to_col FROM flow WHERE to_row IS NOT NULL UNION ALL SELECT to_row, to_col FROM way JOIN flow ON "row" = r AND col = c WHERE to_row IS NOT NULL),
up AS MATERIALIZED (SELECT r AS "row", c AS col, count(*) AS upstream FROM way GROUP BY ALL)"""


@add(f'WITH RECURSIVE {_FLOW} SELECT "row", col, to_row, to_col FROM flow')
def j22_flow_over_flats(t):
    return terrain.flow_over(terrain.filled(_dem(t), "h", tile=16))


@add(f'WITH RECURSIVE {_FLOW} SELECT flow."row", flow.col, coalesce(upstream, 0) AS upstream FROM flow LEFT JOIN up ON up."row" = flow."row" AND up.col = flow.col')
def j23_filled_accumulation(t):
    return surfaces.flow_accumulation(terrain.flow_over(terrain.filled(_dem(t), "h", tile=16)))


@add(f"""WITH RECURSIVE {_FLOW}, points AS (SELECT r_regionkey AS id, r_regionkey * 9 + 5 AS "row", r_regionkey * 8 + 7 AS col FROM region),
near AS (
  SELECT id, up."row", up.col FROM points JOIN up ON up."row" BETWEEN points."row" - 3 AND points."row" + 3 AND up.col BETWEEN points.col - 3 AND points.col + 3 AND upstream > 8
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY (up."row" - points."row") ** 2 + (up.col - points.col) ** 2, up."row", up.col) = 1),
outlet AS (SELECT "row", col, min(id) AS id FROM (SELECT p.id, coalesce(near."row", p."row") AS "row", coalesce(near.col, p.col) AS col FROM points p LEFT JOIN near USING (id)) GROUP BY ALL),
basin("row", col, id) AS (
  SELECT o."row", o.col, o.id FROM outlet o JOIN flow ON flow."row" = o."row" AND flow.col = o.col
  UNION SELECT flow."row", flow.col, basin.id FROM basin JOIN flow ON to_row = basin."row" AND to_col = basin.col WHERE NOT EXISTS (SELECT 1 FROM outlet o WHERE o."row" = flow."row" AND o.col = flow.col))
SELECT "row", col, id FROM basin""")
def j24_watersheds(t):
    directions = terrain.flow_over(terrain.filled(_dem(t), "h", tile=16))
    points = t("region").select(F.col("r_regionkey").alias("id"), (F.col("r_regionkey") * 9 + 5).alias("row"), (F.col("r_regionkey") * 8 + 7).alias("col"))
    outlets = terrain.snapped(surfaces.flow_accumulation(directions), points, threshold=8, reach=3)
    return terrain.watersheds(directions, outlets)


@add(f"""WITH {_DEM.split("n AS (", 1)[0].rstrip().rstrip(",")}, o AS (SELECT h + 1.7 AS eye FROM dem WHERE "row" = 20 AND col = 22),
target AS (SELECT "row", col, h, greatest(abs("row" - 20), abs(col - 22)) AS steps FROM dem WHERE ("row" - 20) ** 2 + (col - 22) ** 2 <= 400),
way AS (SELECT t.*, round_even(20 + (("row" - 20) * s) / steps::DOUBLE, 0)::BIGINT AS wr, round_even(22 + ((col - 22) * s) / steps::DOUBLE, 0)::BIGINT AS wc FROM target t, range(1, 48) u(s) WHERE s < steps),
blocked AS (
  SELECT DISTINCT w."row", w.col FROM way w JOIN dem d ON d."row" = w.wr AND d.col = w.wc, o
  WHERE (d.h - eye) / sqrt((d."row" - 20) ** 2 + (d.col - 22) ** 2) > (w.h - eye) / sqrt((w."row" - 20) ** 2 + (w.col - 22) ** 2))
SELECT t."row", t.col, b."row" IS NULL AS visible FROM target t LEFT JOIN blocked b ON b."row" = t."row" AND b.col = t.col, o""")
def j26_viewshed(t):
    return terrain.viewshed(_dem(t), "h", 20, 22, eye=1.7, radius=20.0)
