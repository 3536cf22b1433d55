"""Queries that report on fused tables and cut texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import chunks, fusion_quality
from orbweave.plans.catalog import Catalog

FOUND = Catalog()
add = FOUND.add

_FUSED = """
r AS (SELECT l_orderkey, sum(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY 1),
f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 1000 ELSE o_totalprice END AS price, returned, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS priority FROM orders LEFT JOIN r ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0),
q AS (SELECT quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3, quantile_cont(o_orderkey, 0.25) AS k1, quantile_cont(o_orderkey, 0.75) AS k3, quantile_cont(returned, 0.25) AS r1, quantile_cont(returned, 0.75) AS r3 FROM f)"""


@add(f"""WITH {_FUSED}, n AS (
  SELECT avg((o_orderkey IS NULL)::INT) AS a, avg((price IS NULL)::INT) AS b, avg((returned IS NULL)::INT) AS c, avg((priority IS NULL)::INT) AS d, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS rows,
    avg((o_orderkey < k1 - 5 * (k3 - k1) OR o_orderkey > k3 + 5 * (k3 - k1))::INT) AS ok, avg((price < p1 - 5 * (p3 - p1) OR price > p3 + 5 * (p3 - p1))::INT) AS op, avg((returned < r1 - 5 * (r3 - r1) OR returned > r3 + 5 * (r3 - r1))::INT) AS o_r FROM f, q),
e AS (
  SELECT 'null_rate' AS "check", 'o_orderkey' AS "column", a AS value FROM n UNION ALL SELECT 'null_rate', 'price', b FROM n UNION ALL SELECT 'null_rate', 'returned', c FROM n UNION ALL SELECT 'null_rate', 'priority', d FROM n
  UNION ALL SELECT 'row_completeness', NULL, rows FROM n UNION ALL SELECT 'outliers', 'o_orderkey', ok FROM n UNION ALL SELECT 'outliers', 'price', op FROM n UNION ALL SELECT 'outliers', 'returned', o_r FROM n)
SELECT "check", "column", round(value, 6) AS value, CASE WHEN "check" = 'null_rate' THEN CASE WHEN value > 0.5 THEN 0.1 WHEN value > 0.2 THEN 0.05 ELSE 0 END
  WHEN "check" = 'row_completeness' THEN CASE WHEN value < 0.5 THEN 0.15 ELSE 0 END
  WHEN value > 0.05 AND "column" = (SELECT "column" FROM e WHERE "check" = 'outliers' AND value > 0.05 ORDER BY "column" LIMIT 1) THEN 0.05 ELSE 0 END::DOUBLE AS penalty FROM e""")
def l25_fusion_quality(t):
    r = t("lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("returned"))
    o, k = t("orders"), F.col("o_orderkey")
    price = F.when(k % 10 == 0, F.col("o_totalprice") * 1000).otherwise(F.col("o_totalprice")).alias("price")
    fused = o.where(k % 3 == 0).join(r, k == F.col("l_orderkey"), "left").select("o_orderkey", price, "returned", F.when(k % 4 > 0, F.col("o_orderpriority")).alias("priority"))
    found = fusion_quality.checks(fused, [o])
    return found.where(F.col("check").isin("null_rate", "row_completeness", "outliers")).withColumn("value", F.round("value", 6))


@add()
def i13_paragraph_chunks(t):
    return chunks.chunked(t("documents"), "doc_id", "text", longest=500, overlap=50)
