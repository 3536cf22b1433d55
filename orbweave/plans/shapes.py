"""Queries over graphs, clusters and surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators import clusters, graph, surfaces
from orbweave.plans.catalog import Catalog
from orbweave.plans.places import _points

FOUND = Catalog()
add = FOUND.add

#: Points near each other, so that clusters stay small at every size: the pairs within 60, a point with itself among them.
_NEAR = "p AS (SELECT c_custkey AS id, c_acctbal AS x, c_custkey::DOUBLE AS y FROM customer), e AS (SELECT l.id AS a, r.id AS b FROM p l JOIN p r ON r.y BETWEEN l.y - 60 AND l.y + 60 WHERE (l.x - r.x) ** 2 + (l.y - r.y) ** 2 <= 3600)"


@add(f"""WITH RECURSIVE {_NEAR}, core AS (SELECT a AS id FROM e GROUP BY 1 HAVING count(*) >= 3),
r(id, root) AS (SELECT id, id FROM core UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id JOIN core ON core.id = e.b),
c AS (SELECT id, min(root) AS cluster FROM r GROUP BY 1)
SELECT p.id, coalesce(any_value(c.cluster), min(n.cluster), -1) AS cluster FROM p LEFT JOIN c ON c.id = p.id LEFT JOIN e ON e.a = p.id LEFT JOIN c n ON n.id = e.b GROUP BY 1""")
def k15_dbscan(t):
    return clusters.dbscan(_points(t), "id", 60.0, 3)


#: Each supplier leads to the one of half its key and, by threes, to another: one directed graph of a few steps' depth.
_LINKS = "l AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey % 5 = 0)"


def _links(t) -> DataFrame:
    k = F.col("s_suppkey")
    s = t("supplier")
    return s.where(k > 1).select(k.alias("src"), F.floor(k / 2).alias("dst")).unionAll(s.where(k % 5 == 0).select(k, F.floor(k / 3)))


@add(f"WITH RECURSIVE {_LINKS}, r(id, hop) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey = (SELECT max(s_suppkey) FROM supplier) UNION SELECT dst, hop + 1 FROM r JOIN l ON src = id WHERE hop < 3) SELECT id, min(hop) AS hop FROM r GROUP BY 1")
def k16_lineage_down(t):
    start = t("supplier").agg(F.max("s_suppkey").alias("id"))
    return graph.reach(_links(t), start, 3)


@add(f"WITH RECURSIVE {_LINKS}, r(id, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT src, hop + 1 FROM r JOIN l ON dst = id WHERE hop < 2) SELECT id, min(hop) AS hop FROM r GROUP BY 1")
def k17_lineage_up(t):
    return graph.reach(_links(t), t("supplier").select(F.lit(1).cast("long").alias("id")), 2, back=True)


@add(f"""WITH RECURSIVE {_LINKS}, u AS (SELECT src, dst FROM l WHERE src <> dst UNION SELECT dst, src FROM l WHERE src <> dst),
r(id, path) AS (SELECT 10::BIGINT, [10::BIGINT] UNION ALL SELECT dst, list_append(path, dst) FROM r JOIN u ON src = id WHERE len(path) <= 5 AND NOT list_contains(path, dst))
SELECT len(path)::INT - 1 AS hops, path FROM r WHERE id = 7 ORDER BY len(path), path LIMIT 1""")
def k18_shortest_path(t):
    return graph.shortest_path(_links(t), 10, 7)


#: Suppliers of equal last digits, ten apart, in runs of ten.
_RUNS = "g AS (SELECT s_suppkey AS src, s_suppkey + 10 AS dst FROM supplier WHERE s_suppkey % 100 < 80 AND s_suppkey + 10 <= (SELECT max(s_suppkey) FROM supplier))"


@add(f"WITH RECURSIVE {_RUNS}, u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), r(id, root) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT dst, root FROM r JOIN u ON src = id) SELECT id, min(root) AS component FROM r GROUP BY 1")
def k19_components(t):
    s = t("supplier").select(F.col("s_suppkey").alias("id"))
    g = s.where(F.col("id") % 100 < 80).select(F.col("id").alias("src"), (F.col("id") + 10).alias("dst"))
    return graph.components(s, g.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi"))


_U = f"{_LINKS}, u AS (SELECT src, dst FROM l WHERE src <> dst AND dst > 0 UNION SELECT dst, src FROM l WHERE src <> dst AND dst > 0)"
_VOTE = "SELECT id, label FROM (SELECT src AS id, label, count(*) AS n FROM u JOIN {0} v ON v.id = dst GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1"


@add(f"WITH {_U}, v0 AS (SELECT DISTINCT src AS id, src AS label FROM u), v1 AS ({_VOTE.format('v0')}), v2 AS ({_VOTE.format('v1')}) {_VOTE.format('v2')}")
def k20_communities(t):
    return graph.communities(_links(t).where("dst > 0"), 3)


_POWER = "SELECT id, c / max(c) OVER () AS c FROM (SELECT v.id, any_value(v.c) + sum(o.c) AS c FROM {0} v JOIN u ON u.src = v.id JOIN {0} o ON o.id = u.dst GROUP BY 1)"


@add(f"WITH {_U}, c0 AS (SELECT DISTINCT src AS id, 1.0::DOUBLE AS c FROM u), c1 AS ({_POWER.format('c0')}), c2 AS ({_POWER.format('c1')}), c3 AS ({_POWER.format('c2')}) SELECT id, round(c, 6) AS centrality FROM c3")
def k21_eigenvector(t):
    return graph.eigenvector(_links(t).where("dst > 0"), 3).withColumn("centrality", F.round("centrality", 6))


@add("""WITH s AS (SELECT p_partkey, (p_retailprice * 100)::BIGINT % 97 AS a, p_size AS b FROM part),
f0 AS (SELECT * FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))), r0 AS (SELECT * FROM s ANTI JOIN f0 USING (p_partkey)),
f1 AS (SELECT * FROM r0 x WHERE NOT EXISTS (SELECT 1 FROM r0 y WHERE y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b)))
SELECT p_partkey, 0 AS front FROM f0 UNION ALL SELECT p_partkey, 1 FROM f1""")
def g05_fronts(t):
    s = t("part").select("p_partkey", (F.round(F.col("p_retailprice") * 100).cast("long") % 97).alias("a"), F.col("p_size").cast("long").alias("b"))
    return clusters.fronts(s, "p_partkey", ["a", "b"], 2)


@add("""SELECT p_partkey, CASE WHEN lag(p_retailprice) OVER a IS NULL OR lead(p_retailprice) OVER a IS NULL OR lag(p_size) OVER b IS NULL OR lead(p_size) OVER b IS NULL THEN -1 ELSE
 round(coalesce((lead(p_retailprice) OVER a - lag(p_retailprice) OVER a) / nullif(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 0), 0) + coalesce((lead(p_size) OVER b - lag(p_size) OVER b) / nullif(max(p_size) OVER w - min(p_size) OVER w, 0)::DOUBLE, 0), 6) END AS crowding
FROM part WINDOW w AS (PARTITION BY p_brand), a AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey), b AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)""")
def g06_crowding(t):
    c = clusters.crowding(t("part"), "p_brand", "p_partkey", ["p_retailprice", "p_size"])
    return c.select("p_partkey", F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 6)).alias("crowding"))


#: Pixels with a class, the holes left as they are.
_CLASSES = 'px AS (SELECT l_partkey % 64 AS "row", l_suppkey % 64 AS col, max(l_linenumber) % 3 AS class FROM lineitem GROUP BY 1, 2)'


def _classes(t) -> DataFrame:
    return t("lineitem").groupBy((F.col("l_partkey") % 64).alias("row"), (F.col("l_suppkey") % 64).alias("col")).agg((F.max("l_linenumber") % 3).alias("class"))


_PATCHES = f"""{_CLASSES}, i AS (SELECT *, "row" * (max(col) OVER () + 1) + col AS id FROM px),
n AS (SELECT x.id AS a, y.id AS b FROM i x JOIN i y ON x.class = y.class AND abs(x."row" - y."row") + abs(x.col - y.col) = 1),
r(id, root) AS (SELECT id, id FROM i UNION SELECT b, root FROM r JOIN n ON a = r.id), m AS (SELECT id, min(root) AS patch FROM r GROUP BY 1)"""


@add(f'WITH RECURSIVE {_PATCHES} SELECT "row", col, class, patch FROM i JOIN m USING (id)')
def j11_patches(t):
    return clusters.patches(_classes(t), "class")


@add(f"WITH RECURSIVE {_PATCHES}, z AS (SELECT class, patch, count(*) AS n FROM i JOIN m USING (id) GROUP BY 1, 2) SELECT class, count(*) AS patches, round(max(n) * 100 / (SELECT sum(n) FROM z), 6) AS largest_percent, round(count(*) / (SELECT sum(n) FROM z), 8) AS density FROM z GROUP BY 1")
def e19_landscape(t):
    s = clusters.landscape(clusters.patches(_classes(t), "class"))
    return s.withColumns({"largest_percent": F.round("largest_percent", 6), "density": F.round("density", 8)})


_GRID = 'g AS (SELECT r AS "row", c AS col, (c + 0.5) * 1000 AS gx, (r + 0.5) * 1000 AS gy FROM range(16) a(r), range(11) b(c)), d AS (SELECT "row", col, c_nationkey AS v, (c_acctbal - gx) ** 2 + (c_custkey - gy) ** 2 AS d2 FROM g, customer)'
GRID = (0.0, 0.0, 1000.0, 11, 16)


def _valued(t) -> DataFrame:
    return t("customer").select(F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"), F.col("c_nationkey").cast("double").alias("v"))


@add(f'WITH {_GRID} SELECT "row", col, round(sum(exp(-d2 / 320000)) / (2 * pi() * 160000) * 1e6, 6) AS density FROM d WHERE d2 <= 2400 * 2400 GROUP BY 1, 2')
def j12_kernel_density(t):
    s = surfaces.density(_valued(t), GRID, 400.0, reach=6.0)
    return s.select("row", "col", F.round(F.col("density") * 1e6, 6).alias("density"))


@add(f'WITH {_GRID} SELECT "row", col, round(sum(v / d2) / sum(1 / d2), 6) AS v FROM d GROUP BY 1, 2')
def j13_inverse_distance(t):
    return surfaces.inverse_distance(_valued(t), GRID, "v").withColumn("v", F.round("v", 6))


@add("""WITH m AS (SELECT avg(c_acctbal) mx, avg(c_custkey) my, avg(c_nationkey) mv, var_pop(c_acctbal) xx, var_pop(c_custkey) yy, covar_pop(c_acctbal, c_custkey) xy, covar_pop(c_acctbal, c_nationkey) xv, covar_pop(c_custkey, c_nationkey) yv FROM customer)
SELECT c_custkey, round(c_nationkey - mv - (xv * yy - yv * xy) / (xx * yy - xy * xy) * (c_acctbal - mx) - (yv * xx - xv * xy) / (xx * yy - xy * xy) * (c_custkey - my), 5) AS residual FROM customer, m""")
def f07_trend_residuals(t):
    c = t("customer").withColumns({"x": F.col("c_acctbal"), "y": F.col("c_custkey").cast("double"), "v": F.col("c_nationkey").cast("double")})
    return surfaces.trend_residuals(c, "v").select("c_custkey", F.round("residual", 5).alias("residual"))


#: A sloping surface with bumps on 64 by 64 pixels.
_DEM = 'dem AS (SELECT l_partkey % 64 AS "row", l_suppkey % 64 AS col, min(l_quantity) + (l_partkey % 64) * 3 + (l_suppkey % 64) * 2 AS h FROM lineitem GROUP BY l_partkey % 64, l_suppkey % 64)'


def _dem(t) -> DataFrame:
    g = t("lineitem").groupBy((F.col("l_partkey") % 64).alias("row"), (F.col("l_suppkey") % 64).alias("col")).agg(F.min("l_quantity").alias("h"))
    return g.withColumn("h", F.col("h") + F.col("row") * 3 + F.col("col") * 2)


@add(f'WITH {_DEM} SELECT "row" // 4 AS "row", col // 4 AS col, round(avg(h), 6) AS h FROM dem GROUP BY 1, 2')
def j14_resample(t):
    return surfaces.resample(_dem(t), 4, ["h"]).withColumn("h", F.round("h", 6))


_FLOW = f"""{_DEM}, o AS (SELECT a."row", a.col, b."row" AS tr, b.col AS tc, (a.h - b.h) / sqrt((a."row" - b."row") ** 2 + (a.col - b.col) ** 2) AS fall
FROM dem a JOIN dem b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND a.h > b.h), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY fall DESC, tr, tc) = 1)"""


@add(f'WITH {_FLOW} SELECT dem."row", dem.col, tr AS to_row, tc AS to_col FROM dem LEFT JOIN f ON f."row" = dem."row" AND f.col = dem.col')
def j15_flow_direction(t):
    return surfaces.flow_direction(_dem(t), "h")


@add(f"""WITH RECURSIVE {_FLOW}, w(r, c) AS (SELECT tr, tc FROM f UNION ALL SELECT tr, tc FROM w JOIN f ON f."row" = r AND f.col = c), k AS (SELECT r, c, count(*) AS n FROM w GROUP BY 1, 2)
SELECT "row", col, coalesce(n, 0) AS upstream FROM dem LEFT JOIN k ON r = "row" AND c = col""")
def j16_flow_accumulation(t):
    return surfaces.flow_accumulation(surfaces.flow_direction(_dem(t), "h"))


@add(f"""WITH RECURSIVE {_FLOW}, w(r, c) AS (SELECT tr, tc FROM f UNION ALL SELECT tr, tc FROM w JOIN f ON f."row" = r AND f.col = c) SELECT r AS "row", c AS col, count(*) AS upstream FROM w GROUP BY 1, 2 HAVING count(*) > 10""")
def j17_streams(t):
    return surfaces.streams(surfaces.flow_accumulation(surfaces.flow_direction(_dem(t), "h")), 10)


@add('WITH p AS (SELECT l_partkey % 64 AS r, l_suppkey % 64 AS c, avg(l_discount) * 5 AS red, avg(l_tax) * 5 AS blue FROM lineitem GROUP BY 1, 2) SELECT round(avg(((red + blue) / 2 > 0.25)::INT) * 100, 6) AS cover FROM p')
def j18_cloud_cover(t):
    p = t("lineitem").groupBy((F.col("l_partkey") % 64).alias("r"), (F.col("l_suppkey") % 64).alias("c")).agg((F.avg("l_discount") * 5).alias("red"), (F.avg("l_tax") * 5).alias("blue"))
    return p.agg(F.round(surfaces.cloud_cover(["red", "blue"], 0.25), 6).alias("cover"))
