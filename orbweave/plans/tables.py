"""Queries over attribute tables: filters, joins, aggregates, windows, sets, cleaning, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import expressions as X
from orbweave.operators import charts, quality, relational as R
from orbweave.plans.catalog import Catalog

FOUND = Catalog()
add = FOUND.add

PII = {k: p.replace("'", "''") for k, p in quality.PII.items()}


@add("SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def c01_transform(t):
    steps = [
        {"op": "filter", "column": "l_quantity", "operator": ">", "value": 45},
        {"op": "filter", "column": "l_returnflag", "operator": "==", "value": "R"},
        {"op": "calculate", "name": "net", "expression": "round(!l_extendedprice! * (1 - !l_discount!), 6)"},
        {"op": "select", "columns": ["l_orderkey", "l_linenumber", "l_quantity", "net"]},
    ]
    return R.transform(t("lineitem"), steps)


@add("SELECT p_partkey, CASE WHEN p_retailprice > 1200 THEN 'high' WHEN p_size < 10 THEN 'small' ELSE p_brand END AS class FROM part")
def c02_inference_rules(t):
    return t("part").select("p_partkey", X.cased(F.col("p_brand"), [("p_size < 10", "small"), ("p_retailprice > 1200", "high")]).alias("class"))


@add("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS status FROM orders")
def c03_code_mapping(t):
    return t("orders").select("o_orderkey", X.coded(F.col("o_orderstatus"), {"O": "open", "F": "final"}).alias("status"))


@add("SELECT c_custkey, substr(c_name, 1, 3) || repeat('*', greatest(length(c_name) - 3, 0)) AS masked, substr(sha256(c_name), 1, 16) AS hashed, '[REDACTED]' AS hidden FROM customer WHERE c_name IS NOT NULL")
def c04_masking(t):
    c = F.col("c_name")
    return t("customer").where(c.isNotNull()).select("c_custkey", X.masked(c).alias("masked"), X.hashed(c).alias("hashed"), X.redacted(c).alias("hidden"))


@add("SELECT p_partkey, round(p_size * 1e-4, 9) AS ha, round(p_size / 666.67, 9) AS mu FROM part")
def c05_unit_conversion(t):
    return t("part").select("p_partkey", *(F.round(F.col("p_size") * X.UNITS["m2", u], 9).alias(u) for u in ("ha", "mu")))


@add("SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def d01_attribute_join(t):
    return R.attribute_join(t("customer").select("c_custkey", "c_nationkey"), t("nation"), "c_nationkey", "n_nationkey").drop("n_nationkey")


@add("SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS k, w FROM orders LEFT JOIN (VALUES ('2-HIGH', 2), (NULL, 1)) v(p, w) ON nullif(o_orderpriority, '1-URGENT') IS NOT DISTINCT FROM p")
def d02_null_safe_join(t):
    left = t("orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("k"))
    right = left.sparkSession.createDataFrame([("2-HIGH", 2), (None, 1)], "k string, w int")
    return R.attribute_join(left, right, "k")


@add("""SELECT e.event_type, count(*) AS n, round(avg(c.c_acctbal), 6) AS balance FROM events e JOIN customer c ON e.user_id = c.c_custkey GROUP BY ALL""")
def d03_fusion_aggregate(t):
    # The larger side is summed before the join: one row per type and user meets the customer.
    e = t("events").groupBy("event_type", "user_id").agg(F.count("*").alias("k"))
    m = e.join(t("customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal"), "user_id")
    has = F.when(F.col("c_acctbal").isNotNull(), F.col("k"))
    return m.groupBy("event_type").agg(F.sum("k").alias("n"), F.round(F.sum(F.col("c_acctbal") * F.col("k")) / F.sum(has), 6).alias("balance"))


@add("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY customers DESC, n_name LIMIT 5")
def d04_top_k_join(t):
    n = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return n.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers").orderBy(F.desc("customers"), "n_name").limit(5)


@add("""SELECT l_returnflag, round(sum(l_quantity), 4) AS "l_quantity_SUM", round(avg(l_discount), 9) AS "l_discount_MEAN", min(l_tax) AS "l_tax_MIN", max(l_tax) AS "l_tax_MAX", count(l_tax) AS "l_tax_COUNT", round(stddev_samp(l_quantity), 6) AS "l_quantity_STD"
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def e01_summary_statistics(t):
    s = R.summary_statistics(t("lineitem"), "l_quantity SUM; l_discount MEAN; l_tax MIN; l_tax MAX; l_tax COUNT; l_quantity STD", "l_returnflag")
    digits = {"l_quantity_SUM": 4, "l_discount_MEAN": 9, "l_quantity_STD": 6}
    return s.withColumns({c: F.round(c, n) for c, n in digits.items()})


@add("""SELECT o_orderstatus, min_by(o_totalprice, o_orderkey) AS "o_totalprice_FIRST", max_by(o_totalprice, o_orderkey) AS "o_totalprice_LAST" FROM orders GROUP BY o_orderstatus""")
def e02_first_last(t):
    return R.summary_statistics(t("orders"), "o_totalprice FIRST;o_totalprice LAST", "o_orderstatus", "o_orderkey")


@add("SELECT p_brand, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS percent FROM part GROUP BY p_brand")
def e03_shares(t):
    return charts.shares(t("part"), "p_brand").withColumn("percent", F.round("percent", 9))


@add("""WITH e AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)
SELECT least(19, floor((o_totalprice - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS n, round(any_value(lo + (hi - lo) / 20 * least(19, floor((o_totalprice - lo) / (hi - lo) * 20))), 6) AS low FROM orders, e GROUP BY 1""")
def e04_histogram(t):
    return charts.histogram(t("orders"), "o_totalprice").withColumn("low", F.round("low", 6))


@add("""SELECT l_shipmode AS mode, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 6) AS low, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(least(hi, q3 + 1.5 * (q3 - q1)), 6) AS high FROM (
SELECT o_orderpriority AS l_shipmode, quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.5) med, quantile_cont(o_totalprice, 0.75) q3, min(o_totalprice) lo, max(o_totalprice) hi FROM orders GROUP BY 1)""")
def e05_box_plot(t):
    b = charts.box_stats(t("orders"), "o_totalprice", "o_orderpriority").withColumnRenamed("o_orderpriority", "mode")
    return b.withColumns({c: F.round(c, 6) for c in ("low", "q1", "median", "q3", "high")})


@add("""SELECT * FROM (SELECT 'l_discount' AS a, 'l_extendedprice' AS b, round(corr(l_discount, l_extendedprice), 3) AS r FROM lineitem UNION ALL
SELECT 'l_discount', 'l_quantity', round(corr(l_discount, l_quantity), 3) FROM lineitem UNION ALL
SELECT 'l_extendedprice', 'l_quantity', round(corr(l_extendedprice, l_quantity), 3) FROM lineitem)""")
def e06_correlations(t):
    return charts.correlations(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@add("""WITH g AS (SELECT * FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT DISTINCT o_orderpriority FROM orders))
SELECT g.o_orderstatus, g.o_orderpriority, round(coalesce(sum(o_totalprice), 0), 4) AS total FROM g LEFT JOIN orders o USING (o_orderstatus, o_orderpriority) GROUP BY ALL""")
def e07_grouped_sum(t):
    return charts.grouped_sum(t("orders"), "o_orderstatus", "o_totalprice", "o_orderpriority").withColumn("total", F.round("total", 4))


@add("SELECT count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events")
def e08_nearest_rank(t):
    return charts.nearest_rank(t("events"), "value", {"p50": 0.5, "p95": 0.95}).withColumn("mean", F.round("mean", 6))


@add("""SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n, round(avg((props->>'$.k')::DOUBLE), 6) AS mean_k FROM events GROUP BY ALL""")
def e09_audit_analytics(t):
    k = F.get_json_object("props", "$.k").cast("double")
    return t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(k), 6).alias("mean_k"))


@add("""SELECT a.o_orderstatus AS before, b.l_linestatus AS after, count(*) AS n FROM orders a JOIN lineitem b ON o_orderkey = l_orderkey GROUP BY ALL""")
def e10_transitions(t):
    both = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("before")).join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("after")), "o_orderkey")
    return charts.transitions(both, "before", "after")


@add("""SELECT k, round(lo + (hi - lo) * k / 5, 6) AS edge FROM (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer), range(6) r(k)""")
def e11_equal_breaks(t):
    return charts.equal_breaks(t("customer"), "c_acctbal").select("k", F.round("edge", 6).alias("edge"))


@add("""SELECT k, round(e[k + 1], 6) AS edge FROM (SELECT quantile_cont(c_acctbal, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM customer), range(6) r(k)""")
def e12_quantile_breaks(t):
    return charts.quantile_breaks(t("customer"), "c_acctbal").select("k", F.round("edge", 6).alias("edge"))


@add("""SELECT * FROM (SELECT 'p_size' AS "column", 1 - count(p_size) / count(*)::DOUBLE AS null_share, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, round(avg(p_size), 6) AS mean FROM part UNION ALL
SELECT 'p_retailprice', 1 - count(p_retailprice) / count(*)::DOUBLE, min(p_retailprice), max(p_retailprice), round(avg(p_retailprice), 6) FROM part)""")
def e13_profile(t):
    return charts.profile(t("part"), ["p_size", "p_retailprice"]).withColumn("mean", F.round("mean", 6))


@add("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def e14_rollup(t):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@add("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def f01_latest(t):
    return R.latest(t("orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@add("""SELECT event_id, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS event_type FROM events""")
def f02_forward_fill(t):
    e = t("events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), F.nullif("event_type", F.lit("view")).alias("event_type"))
    return R.forward_fill(e, "event_type", ["user_id"], "o").select("event_id", "event_type")


@add("""SELECT user_id, event_id, round(value - lag(value) OVER w, 6) AS delta, sum(value) OVER w >= 0 AS positive FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def f03_deltas(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("user_id", "event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"), (F.sum("value").over(w) >= 0).alias("positive"))


@add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def g01_top_k(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@add("""SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))""")
def g02_skyline(t):
    return R.skyline(t("part"), "p_partkey", ["p_size"], ["p_retailprice"]).select("p_partkey")


@add("""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) <= 1995 GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) > 1995 GROUP BY 1)
SELECT k, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN abs(b.v - a.v) / abs(a.v) > 0.01 THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (k)""")
def h01_change_detection(t):
    by = lambda cond: t("orders").where(cond).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    return R.classify_changes(by("year(o_orderdate) <= 1995"), by("year(o_orderdate) > 1995"), "k", ["v"])


@add("""WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 1)
SELECT 'old' AS part, (SELECT count(*) FROM a) AS n UNION ALL SELECT 'new', (SELECT count(*) FROM b) UNION ALL
SELECT 'removed', (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) UNION ALL SELECT 'added', (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a))""")
def h02_dataset_diff(t):
    o = t("orders")
    return R.dataset_diff(*(o.where(c).select("o_custkey", "o_orderstatus") for c in ("o_orderkey % 3 <> 0", "o_orderkey % 3 <> 1")))


@add("SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY ALL HAVING count(*) > 1")
def l01_duplicates(t):
    return R.duplicates(t("events"), ["user_id", "event_type"]).select("user_id", "event_type", "copies").distinct()


@add("""SELECT count(*) FILTER (WHERE event_type IS NOT NULL AND try_cast(event_type AS DOUBLE) IS NULL) AS failures FROM events""")
def l02_cast_failures(t):
    return R.cast_failures(t("events"), "event_type", "integer")


@add("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS v FROM part)
SELECT p_partkey, round(coalesce(v, (SELECT median(v) FROM p)), 6) AS v FROM p""")
def l03_fill_median(t):
    p = t("part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("v"))
    return R.fill_nulls(p, "v", "median").select("p_partkey", F.round("v", 6).alias("v"))


@add("SELECT c_custkey, greatest(0, least(5000, c_acctbal)) AS c_acctbal FROM customer")
def l04_clip_outliers(t):
    return R.clip_outliers(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.0, 5000.0)


@add("""SELECT 'text' AS "column", round(count(*) FILTER (trim(text) <> '') * 100.0 / count(*), 6) AS percent, CASE WHEN count(*) FILTER (trim(text) <> '') * 100.0 / count(*) >= 95 THEN 'pass' WHEN count(*) FILTER (trim(text) <> '') * 100.0 / count(*) >= 80 THEN 'warn' ELSE 'fail' END AS grade FROM documents""")
def l05_completeness(t):
    return quality.completeness(t("documents"), ["text"]).withColumn("percent", F.round("percent", 6))


@add("""SELECT * FROM (SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity < 5) AS below, count(*) FILTER (l_quantity > 45) AS above FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax < 0.01), count(*) FILTER (l_tax > 0.07) FROM lineitem)""")
def l06_ranges(t):
    return quality.ranges(t("lineitem"), {"l_quantity": (5, 45), "l_tax": (0.01, 0.07)})


@add("SELECT count(*) AS rows, count(*) FILTER (abs(o.o_totalprice - l.s) > 0.01) AS violations, round(max(abs(o.o_totalprice - l.s)), 4) AS largest FROM orders o JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey")
def l07_formula(t):
    s = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    return quality.formula(t("orders").join(s, "o_orderkey"), "o_totalprice", "s", 0.01).withColumn("largest", F.round("largest", 4))


@add("""SELECT round(greatest(0, 100 - (12 * count(*) FILTER (l_quantity <= 0) + 4 * count(*) FILTER (l_discount > 0.09) + count(*) FILTER (l_tax > 0.07)) * 100.0 / count(*)), 6) AS score FROM lineitem""")
def l08_defect_score(t):
    rules = {"quantity": ("A", "l_quantity <= 0"), "discount": ("B", "l_discount > 0.09"), "tax": ("C", "l_tax > 0.07")}
    return quality.defect_score(quality.defects(t("lineitem"), rules)).withColumn("score", F.round("score", 6))


@add("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (regexp_matches(text, '{p}')) AS found FROM documents" for k, p in PII.items()) + ")")
def l09_pii_scan(t):
    return quality.pii(t("documents"), "text")


@add("""SELECT o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), o_orderstatus) AS value, CASE WHEN nullif(o_orderpriority, '1-URGENT') IS NOT NULL THEN 'a' WHEN o_orderstatus IS NOT NULL THEN 'b' END AS value_source FROM orders""")
def l10_conflict_resolution(t):
    o = t("orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("a"), F.col("o_orderstatus").alias("b"))
    return quality.resolve(o, ["a", "b"], "value").select("o_orderkey", "value", "value_source")


@add("""WITH d AS (SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n, len(regexp_extract_all(text, '[぀-ヿ]')) AS kana, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM documents)
SELECT doc_id, CASE WHEN kana > 0.1 * n THEN 'ja' WHEN latin > 0.7 * n THEN 'en' ELSE 'zh' END AS lang FROM d""")
def i01_language(t):
    return t("documents").select("doc_id", X.language(F.col("text")).alias("lang"))


@add("""SELECT n_nationkey, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(n_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS parts FROM nation""")
def i02_field_tokens(t):
    return t("nation").select("n_nationkey", X.tokens(F.col("n_name")).alias("parts"))
