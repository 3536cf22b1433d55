"""Queries over graphs of suppliers and over series of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import causality, centrality
from orbweave.plans.catalog import Catalog
from orbweave.plans.shapes import _links

FOUND = Catalog()
add = FOUND.add

#: All shortest paths of the suppliers' graph: how many lead from s to v, and how long they are.
_PATHS = """
l AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey % 5 = 0),
u AS MATERIALIZED (SELECT src, dst FROM l WHERE src <> dst AND dst > 0 UNION SELECT dst, src FROM l WHERE src <> dst AND dst > 0),
reach(s, v, d) AS (SELECT DISTINCT src, src, 0 FROM u UNION SELECT s, dst, d + 1 FROM reach JOIN u ON src = v WHERE d < 24),
far AS MATERIALIZED (SELECT s, v, min(d) AS d FROM reach GROUP BY ALL),
walk(s, v, d) AS (SELECT s, v, 0 FROM far WHERE d = 0 UNION ALL SELECT walk.s, u.dst, walk.d + 1 FROM walk JOIN u ON u.src = walk.v JOIN far ON far.s = walk.s AND far.v = u.dst AND far.d = walk.d + 1),
ways AS MATERIALIZED (SELECT s, v, any_value(d) AS d, count(*) AS n FROM walk GROUP BY ALL),
c AS (SELECT count(DISTINCT src) AS n FROM u)"""


@add(f"""WITH RECURSIVE {_PATHS}, b AS (
  SELECT m.v AS id, sum(m.n * o.n / st.n::DOUBLE) AS b FROM ways st JOIN ways m ON m.s = st.s JOIN ways o ON o.s = m.v AND o.v = st.v WHERE m.v <> st.s AND m.v <> st.v AND st.s <> st.v AND m.d + o.d = st.d GROUP BY 1)
SELECT id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM (SELECT DISTINCT src AS id FROM u) LEFT JOIN b USING (id), c""")
def k24_betweenness(t):
    return centrality.betweenness(_links(t).where("dst > 0")).withColumn("betweenness", F.round("betweenness", 9))


@add(f"WITH RECURSIVE {_PATHS} SELECT v AS id, round(((count(*) - 1) ** 2)::DOUBLE / (sum(d) * (any_value(n) - 1)), 9) AS closeness FROM far, c GROUP BY 1")
def k25_closeness(t):
    return centrality.closeness(_links(t).where("dst > 0")).withColumn("closeness", F.round("closeness", 9))


@add()
def k26_modular_communities(t):
    return centrality.modular_communities(_links(t).where("dst > 0"))[0]


#: One lag: both regressions follow from variances and covariances.
@add("""WITH d AS (SELECT o_orderpriority AS g, date_trunc('day', o_orderdate) AS t, avg(o_totalprice) AS x, count(*)::DOUBLE AS y FROM orders GROUP BY ALL),
s AS (SELECT g, y, lag(y) OVER w AS a, lag(x) OVER w AS b FROM d WINDOW w AS (PARTITION BY g ORDER BY t)),
m AS (SELECT g, count(*) AS n, var_pop(y) AS yy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab FROM s WHERE a IS NOT NULL GROUP BY 1),
r AS (SELECT g, n, yy - ya * ya / aa AS r0, yy - (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / (aa * bb - ab * ab) AS r1 FROM m)
SELECT g, n, round(greatest(0, (r0 - r1) / (r1 / (n - 3))), 5) AS f FROM r""")
def k27_granger(t):
    o = t("orders").groupBy(F.col("o_orderpriority").alias("g"), F.date_trunc("day", "o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("x"), F.count("*").cast("double").alias("y"))
    return causality.granger(o, "t", "x", "y", 1, ["g"]).select("g", "n", F.round("f", 5).alias("f"))
