"""Queries over polygons, rasters, fields and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import expressions as X
from orbweave.operators import audit, fields, rasters, spatial, temporal
from orbweave.plans.catalog import Catalog
from orbweave.plans.places import _BOXES, _boxes, _points

FOUND = Catalog()
add = FOUND.add

#: Six-band pixels from line items: bands are means of measures.
_BANDS = """SELECT l_partkey % 64 AS "row", l_suppkey % 64 AS col, avg(l_quantity) AS red, avg(l_tax) * 100 AS nir, avg(l_discount) * 100 AS blue, avg(l_extendedprice) / 1000 AS green, avg(l_linenumber) AS swir1, count(*)::DOUBLE AS swir2, avg(l_orderkey % 97) AS rededge FROM lineitem GROUP BY 1, 2"""


def _bands(t) -> DataFrame:
    keys = [(F.col("l_partkey") % 64).alias("row"), (F.col("l_suppkey") % 64).alias("col")]
    return t("lineitem").groupBy(*keys).agg(
        F.avg("l_quantity").alias("red"), (F.avg("l_tax") * 100).alias("nir"), (F.avg("l_discount") * 100).alias("blue"), (F.avg("l_extendedprice") / 1000).alias("green"),
        F.avg("l_linenumber").alias("swir1"), F.count("*").cast("double").alias("swir2"), F.avg(F.col("l_orderkey") % 97).alias("rededge"))


def _sql_index(name: str) -> str:
    """An index's formula for the other engine: a quotient with a zero divisor is null there too."""
    import re

    text = rasters.INDICES[name]
    return re.sub(r"try_divide\((.*), ([^,]*)\)", r"((\1) / nullif(\2, 0))", text)


@add(f"""SELECT "row", col, {', '.join(f'round({_sql_index(k)}, 5) + 0 AS {k}' for k in rasters.INDICES)} FROM ({_BANDS})""")
def j06_spectral_indices(t):
    p = _bands(t)
    for name in rasters.INDICES:
        p = rasters.spectral_index(p, name)
    return p.select("row", "col", *((F.round(k, 5) + 0.0).alias(k) for k in rasters.INDICES))


@add(f"""SELECT "row", col, round(sqrt(red * red + nir * nir) - 2 * blue, 6) AS out FROM ({_BANDS})""")
def j07_band_math(t):
    return rasters.band_math(_bands(t), "out", "sqrt(red * red + nir * nir) - 2 * blue").select("row", "col", F.round("out", 6).alias("out"))


@add(f"""WITH p AS ({_BANDS}), n AS (
SELECT p."row", p.col, CASE WHEN l.red IS NULL AND r.red IS NULL THEN 0 WHEN l.red IS NULL THEN r.red - p.red WHEN r.red IS NULL THEN p.red - l.red ELSE (r.red - l.red) / 2 END AS dx,
 CASE WHEN u.red IS NULL AND d.red IS NULL THEN 0 WHEN u.red IS NULL THEN d.red - p.red WHEN d.red IS NULL THEN p.red - u.red ELSE (d.red - u.red) / 2 END AS dy
FROM p LEFT JOIN p l ON l."row" = p."row" AND l.col = p.col - 1 LEFT JOIN p r ON r."row" = p."row" AND r.col = p.col + 1 LEFT JOIN p u ON u.col = p.col AND u."row" = p."row" - 1 LEFT JOIN p d ON d.col = p.col AND d."row" = p."row" + 1)
SELECT "row", col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 5) AS slope, CASE WHEN dx <> 0 OR dy <> 0 THEN round((degrees(atan2(-dx, dy)) + 360) % 360, 4) END AS aspect FROM n""")
def j05_slope(t):
    return rasters.terrain(_bands(t), "red").select("row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 4).alias("aspect"))


@add(f"""WITH p AS ({_BANDS}) SELECT c_custkey AS id, round(red, 6) AS red FROM customer LEFT JOIN p ON "row" = floor((6400 - c_custkey) / 100) AND col = floor((c_acctbal - 0) / 100)""")
def j08_point_sampling(t):
    return rasters.sample(_points(t), _bands(t), (0.0, 6400.0), 100.0, ["red"]).select("id", F.round("red", 6).alias("red"))


@add(f"""WITH p AS ({_BANDS}), s AS (SELECT unnest(['red', 'blue']) AS band, unnest([red, blue]) AS v FROM p) SELECT band, count(v) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM s GROUP BY 1""")
def j09_band_statistics(t):
    s = rasters.band_stats(_bands(t), ["red", "blue"])
    return s.select("band", "n", *(F.round(c, 6).alias(c) for c in ("low", "high", "mean", "sd")))


@add("""WITH d AS (SELECT c_custkey AS id, c_nationkey * 7.0 - 80 AS lng, c_nationkey * 5.0 - 60.5 AS lat FROM customer)
SELECT id, round(radians(lng) * 6378137, 3) AS x, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137, 3) AS y, round(lng, 9) AS back_lng, round(lat, 9) AS back_lat FROM d""")
def j10_reproject(t):
    d = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 7.0 - 80).alias("lng"), (F.col("c_nationkey") * 5.0 - 60.5).alias("lat"))
    x, y = spatial.to_mercator(F.col("lng"), F.col("lat"))
    d = d.withColumns({"x": x, "y": y})
    lng, lat = spatial.from_mercator(F.col("x"), F.col("y"))
    return d.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lng, 9).alias("back_lng"), F.round(lat, 9).alias("back_lat"))


#: Every nation is an L-shaped hexagon around its customers' first corner.
_LS = "SELECT c_nationkey AS k, min(c_acctbal) AS x0, min(c_custkey)::DOUBLE AS y0 FROM customer GROUP BY 1"
_CORNERS = [(0.0, 0.0), (4000.0, 0.0), (4000.0, 40.0), (2000.0, 40.0), (2000.0, 90.0), (0.0, 90.0)]


def _ls(t) -> DataFrame:
    g = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_acctbal").alias("x0"), F.min("c_custkey").cast("double").alias("y0"))
    return g.select("k", F.array(*(F.struct((F.col("x0") + a).alias("x"), (F.col("y0") + b).alias("y")) for a, b in _CORNERS)).alias("ring"))


_INSIDE = "c_acctbal >= x0 AND c_custkey >= y0 AND c_acctbal < x0 + 4000 AND c_custkey < y0 + 90 AND (c_custkey < y0 + 40 OR c_acctbal < x0 + 2000)"


@add(f"SELECT c_custkey AS id, k FROM customer JOIN ({_LS}) ON {_INSIDE}")
def d12_points_in_polygons(t):
    return spatial.points_in_rings(_points(t), _ls(t), 500.0).select("id", "k")


@add(f"SELECT c_custkey AS id, k FROM customer LEFT JOIN ({_LS}) ON {_INSIDE}")
def d13_spatial_join_left(t):
    return spatial.points_in_rings(_points(t), _ls(t), 500.0, how="left").select("id", "k")


@add(f"SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM ({_LS}) WHERE {_INSIDE})")
def d14_erase_points(t):
    return spatial.points_in_rings(_points(t), _ls(t), 500.0, how="left_anti").select("id")


@add(f"SELECT k, 4000.0 * 40 + 2000 * 50 AS area, 4000.0 + 40 + 2000 + 50 + 2000 + 90 AS length FROM ({_LS})")
def i03_ring_measures(t):
    return _ls(t).select("k", F.round(spatial.ring_area("ring"), 4).alias("area"), F.round(spatial.ring_length("ring"), 4).alias("length"))


@add(f"SELECT k, round(greatest(0, least(maxx, 500) - greatest(minx, -500)) * greatest(0, least(maxy, 60) - greatest(miny, 5)), 4) AS area FROM ({_BOXES})")
def d15_clip(t):
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"))))
    b = _boxes(t).select("k", ring.alias("ring")).withColumn("ring", spatial.clip("ring", (-500.0, 5.0, 500.0, 60.0)))
    return b.select("k", F.round(spatial.ring_area("ring"), 4).alias("area"))


_EDGES = f"b AS ({_BOXES}), e AS (SELECT l.k AS a, r.k AS b FROM b l JOIN b r ON l.k <> r.k AND least(l.maxx, r.maxx) >= greatest(l.minx, r.minx) AND least(l.maxy, r.maxy) >= greatest(l.miny, r.miny))"


def _edges(t) -> DataFrame:
    e = spatial.box_pairs(_boxes(t), 200.0, "k").select("a", "b")
    return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


@add(f"""WITH {_EDGES}, z AS (SELECT k, (minx - avg(minx) OVER ()) / stddev_pop(minx) OVER () AS z FROM b), g AS (SELECT a, avg(z) AS lag FROM e JOIN z ON k = b GROUP BY 1)
SELECT k, round(z, 6) AS z, round(lag, 6) AS lag, round(z * lag, 6) AS local_i, CASE WHEN z > 0 THEN 'H' ELSE 'L' END || CASE WHEN lag > 0 THEN 'H' ELSE 'L' END AS quadrant FROM z JOIN g ON k = a""")
def k12_local_moran(t):
    m = spatial.local_moran(_boxes(t), _edges(t), "k", "minx")
    return m.select("k", *(F.round(c, 6).alias(c) for c in ("z", "lag", "local_i")), "quadrant")


@add(f"""WITH {_EDGES}, o AS (SELECT a, b FROM e UNION ALL SELECT k, k FROM b), s AS (SELECT a AS k, sum(minx) AS s, count(*) AS w FROM o JOIN b x ON x.k = o.b GROUP BY 1), m AS (SELECT avg(minx) AS m, stddev_pop(minx) AS d, count(*) AS n FROM b)
SELECT k, round((s - m * w) / nullif(d * sqrt((n * w - w * w)::DOUBLE / (n - 1)), 0), 6) AS z FROM s, m""")
def k13_hot_spots(t):
    return spatial.hot_spots(_boxes(t), _edges(t), "k", "minx").select("k", F.round("z", 6).alias("z"))


@add(f"WITH {_EDGES} SELECT a, b, round(1.0 / count(*) OVER (PARTITION BY a), 9) AS weight FROM e")
def k14_weights(t):
    return spatial.weights(_edges(t)).withColumn("weight", F.round("weight", 9))


@add("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_type), 'steel')")
def c06_filter_map(t):
    return fields.filter_map(t("part"), {"p_name": "A", "p_type": "steel", "nothing": "x"}).select("p_partkey")


@add("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def g04_paging(t):
    o = t("orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("_by"))
    return fields.page(o, ["_by", "o_orderkey"], 100, 50).drop("_by")


@add("SELECT n_nationkey, n_name, NULL::DOUBLE AS slope, 'x' AS note FROM nation")
def c07_add_field(t):
    return fields.add_field(fields.add_field(t("nation").select("n_nationkey", "n_name"), "slope", "DOUBLE"), "note", "TEXT", "x")


@add("SELECT r_regionkey, r_name, '' AS code, 0::BIGINT AS area, NULL::DATE AS since FROM region")
def c08_missing_fields(t):
    return fields.add_missing(t("region").select("r_regionkey", "r_name"), {"r_name": "string", "code": "string", "area": "bigint", "since": "date"})


@add("SELECT r_regionkey AS k, r_name AS name, NULL AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def h03_union_by_name(t):
    return fields.stacked([t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))])


_FORMS = (("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"), ("%Y/%m/%d", "yyyy/MM/dd"), ("%Y%m%d", "yyyyMMdd"), ("%d/%m/%Y", "dd/MM/yyyy"), ("%m-%d-%Y", "MM-dd-yyyy"), ("%Y年%m月%d日", "yyyy年MM月dd日"))


@add("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate::TIMESTAMP WHEN o_orderkey % 7 < 6 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS at FROM orders")
def i04_dates(t):
    text = F.lit("no date")
    for k, (_, form) in enumerate(_FORMS):
        text = F.when(F.col("o_orderkey") % 7 == k, F.date_format("o_orderdate", form)).otherwise(text)
    return t("orders").select("o_orderkey", fields.parsed_date(text).alias("at"))


@add("""SELECT p_partkey, json_object('brand', p_brand, 'size', p_size::VARCHAR, 'type', p_type)::VARCHAR AS merged FROM part""")
def i05_json_merge(t):
    a = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.lit("old").alias("type")))
    b = F.to_json(F.struct(F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size")))
    return t("part").select("p_partkey", fields.merged_json(a, b).alias("merged"))


@add("SELECT c_custkey, substr('138' || lpad(c_custkey::VARCHAR, 8, '0'), 1, 3) || '****' || right(lpad(c_custkey::VARCHAR, 8, '0'), 4) AS phone, substr(c_name, 1, 4) || '***' AS name, '东城区***' AS place FROM customer")
def c09_generalize(t):
    phone = F.concat(F.lit("138"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return t("customer").select("c_custkey", fields.generalized(phone).alias("phone"), fields.generalized(F.col("c_name")).alias("name"), fields.generalized(F.lit("东城区长安路1号")).alias("place"))


@add("SELECT count(*) AS n, count(*) - count(o_orderdate) AS missing, count(*) FILTER (o_orderdate < '1995-01-01') AS expired, count(*) FILTER (o_orderdate > '1997-06-30') AS future FROM orders")
def l11_date_checks(t):
    return fields.date_checks(t("orders"), "o_orderdate", "1995-01-01", "1997-06-30")


@add("""WITH o AS (SELECT count(*) AS n, count(*) - count(o_orderstatus) AS a, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS b, count(*) FILTER (length(o_orderpriority) > 8) AS c FROM orders)
SELECT 'o_orderstatus' AS field, true AS present, a AS nulls, b AS codes, 0 AS too_long, round(1 - (a + b) / n, 9) AS compliance FROM o UNION ALL SELECT 'o_orderpriority', true, 0, 0, c, round(1 - c / n, 9) FROM o UNION ALL SELECT 'o_nothing', false, NULL, NULL, NULL, 0""")
def l12_field_standards(t):
    s = [{"name": "o_orderstatus", "required": True, "values": ["F", "O"]}, {"name": "o_orderpriority", "max_length": 8}, {"name": "o_nothing", "required": True}]
    return fields.standard_checks(t("orders"), s).withColumn("compliance", F.round("compliance", 9))


@add("SELECT 'n_name' AS field, 'present' AS status, true AS same_type, 1.0::DOUBLE AS filled UNION ALL SELECT 'n_code', 'missing', NULL, 0 UNION ALL SELECT 'n_nationkey', 'present', false, 1 UNION ALL SELECT 'n_regionkey', 'extra', NULL, 1")
def h04_schema_gaps(t):
    return fields.schema_gaps(t("nation"), {"n_name": "string", "n_code": "string", "n_nationkey": "string"})


def _conflicts(t, how: str) -> DataFrame:
    rows = t("lineitem").select("l_partkey", F.col("l_quantity").alias("v"), F.col("l_returnflag").alias("source"), F.col("l_shipdate").alias("at"))
    return fields.resolved(rows, ["l_partkey"], "v", "source", "at", how, ["R", "A"])


@add("SELECT l_partkey, arg_max(l_quantity, (l_shipdate, l_quantity)) AS v FROM lineitem GROUP BY 1")
def l13_conflicts_latest(t):
    return _conflicts(t, "latest")


@add("SELECT l_partkey, l_quantity AS v FROM (SELECT l_partkey, l_quantity, count(*) AS k FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY k DESC, l_quantity) = 1")
def l14_conflicts_voting(t):
    return _conflicts(t, "voting")


@add("SELECT l_partkey, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1")
def l15_conflicts_mean(t):
    return _conflicts(t, "mean").withColumn("v", F.round("v", 6))


@add("SELECT l_partkey, arg_min(l_quantity, (CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_returnflag, l_quantity)) AS v FROM lineitem GROUP BY 1")
def l16_conflicts_priority(t):
    return _conflicts(t, "priority")


@add("SELECT doc_id, chunk::INT AS chunk, (chunk * 450)::INT AS start, substr(text, (chunk * 450 + 1)::BIGINT, 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(0, (length(text) - 51) // 450) + 1)) AS chunk FROM documents WHERE length(text) > 0)")
def i06_chunks(t):
    return fields.chunks(t("documents"), "doc_id", "text")


@add("SELECT event_type, count(*) AS total, count(*) FILTER (NOT (value > 20)) AS failures, round(avg((value > 20)::INT) * 100, 6) AS rate, round(avg(value), 6) AS mean_s FROM events GROUP BY 1")
def e14_success_rates(t):
    return audit.success(t("events"), ["event_type"], F.col("value") > 20, "value").withColumns({"rate": F.round("rate", 6), "mean_s": F.round("mean_s", 6)})


@add("SELECT ts::DATE AS day, count(*) AS runs, round(sum(value), 4) AS value_total, round(avg(value), 6) AS value_a_run FROM events GROUP BY 1")
def e15_tokens_per_day(t):
    return audit.per_day(t("events"), "ts", ["value"]).withColumns({"value_total": F.round("value_total", 4), "value_a_run": F.round("value_a_run", 6)})


@add("SELECT user_id, count(*) AS uses, count(DISTINCT props) AS users, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY 1")
def e16_access(t):
    return audit.access(t("events"), "user_id", "props", "event_type", ["click", "view"])


@add("SELECT c_custkey, round(3 + (c_acctbal - lo) / (hi - lo) * 27, 6) AS radius FROM customer, (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer)")
def e17_bubbles(t):
    return audit.radius(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("radius", 6).alias("radius"))


@add("SELECT event_id, round((user_id * 1000 * 0.3 + event_id * 1000 * 2.5) / 1e6, 6) AS dollars FROM events")
def e18_cost(t):
    return t("events").select("event_id", audit.cost(F.col("user_id") * 1000, F.col("event_id") * 1000, 0.3, 2.5).alias("dollars"))


@add("""WITH p AS (SELECT c_custkey, c_nationkey * 0.01 AS lat, (c_custkey % 100) * 0.01 AS lng FROM customer), d AS (SELECT c_custkey, 2 * 6371000 * asin(sqrt(sin(radians(lat - 0.1) / 2) ** 2 + cos(radians(0.1)) * cos(radians(lat)) * sin(radians(lng - 0.3) / 2) ** 2)) AS m FROM p)
SELECT c_custkey, round(m, 3) AS metres FROM d WHERE m <= 20000 ORDER BY m, c_custkey LIMIT 20""")
def o01_control_points(t):
    p = t("customer").select("c_custkey", (F.col("c_nationkey") * 0.01).alias("lat"), ((F.col("c_custkey") % 100) * 0.01).alias("lng"))
    return spatial.near_points(p, 0.3, 0.1, 20_000.0, 20, "c_custkey").select("c_custkey", F.round("metres", 3).alias("metres"))


@add("""WITH s AS (SELECT user_id, ts, event_id % 50 AS lat, event_id % 80 AS lng, lag(event_id % 50) OVER w AS la, lag(event_id % 80) OVER w AS ln FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT user_id, ts, (degrees(atan2(sin(radians(lng - ln)) * cos(radians(lat)), cos(radians(la)) * sin(radians(lat)) - sin(radians(la)) * cos(radians(lat)) * cos(radians(lng - ln)))) + 360) % 360 AS h FROM s)
SELECT user_id, count(*) AS fixes, round(arg_max(h, ts), 4) AS heading FROM h GROUP BY 1""")
def m06_headings(t):
    e = t("events").select("user_id", "ts", (F.col("event_id") % 50).alias("lat"), (F.col("event_id") % 80).alias("lng"))
    return temporal.trajectories(e, "user_id", "ts", "lat", "lng").select("user_id", "fixes", F.round("heading", 4).alias("heading"))


@add("SELECT event_id, CASE WHEN value < 15 THEN 'low' WHEN value < 35 THEN 'medium' ELSE 'high' END AS level FROM events")
def l17_levels(t):
    return t("events").select("event_id", fields.quality_level(X.min_max(F.col("value"), F.lit(0.0), F.lit(50.0))).alias("level"))
