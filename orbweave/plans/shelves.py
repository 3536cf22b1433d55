"""Queries over catalogs of data, their words, codes and quality, and over matched pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators import audit, catalogs, privacy
from orbweave.plans.catalog import Catalog
from orbweave.plans.more import _bands, _BANDS

FOUND = Catalog()
add = FOUND.add


@add("SELECT event_id FROM events WHERE user_id = 7 OR event_type = 'view'")
def c10_row_security(t):
    e = t("events").select("event_id", F.col("user_id").cast("string").alias("owner"), (F.col("event_type") == "view").alias("shared"))
    return catalogs.visible(e, "owner", "shared", "7").select("event_id")


@add("SELECT c_custkey FROM customer WHERE starts_with(lpad(c_custkey::VARCHAR, 6, '0'), '0001') OR starts_with(lpad(c_custkey::VARCHAR, 6, '0'), '00002')")
def c11_hierarchy_filter(t):
    c = t("customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"))
    return catalogs.under(c, "code", ["0001", "00002"]).select("c_custkey")


@add("""WITH p AS (SELECT DISTINCT p_brand AS term, p_partkey::VARCHAR AS root FROM part WHERE p_partkey < 10), c AS (SELECT p_partkey::VARCHAR AS code FROM part)
SELECT DISTINCT term, code FROM p JOIN c ON starts_with(code, root)""")
def c12_expand_hierarchy(t):
    tree = t("part").select("p_brand", F.col("p_partkey").cast("string").alias("code"), F.when(F.col("p_partkey") < 10, F.col("p_brand")).alias("name"))
    return catalogs.expanded(tree.select(F.col("p_brand").alias("term")), tree, "term", "name", "code")


@add("""WITH g AS (SELECT unnest(['ne', 'ew', 'cl', 'lo', 'ou', 'ud']) AS g), s AS (SELECT p_partkey, CASE WHEN any_value(contains(lower(p_name || ' ' || p_type), 'new cloud')) THEN 0.9 ELSE 0.85 * avg(contains(lower(p_name || ' ' || p_type), g)::INT) END AS score FROM part, g GROUP BY 1)
SELECT p_partkey, round(score, 9) AS score FROM s WHERE score >= 0.1 ORDER BY score DESC, p_partkey LIMIT 20""")
def g07_lexical_search(t):
    p = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return catalogs.search(p, "p_partkey", "text", "New Cloud", 20, 0.1).withColumn("score", F.round("score", 9))


@add("""SELECT p_partkey, round(greatest(CASE WHEN s = 'steel' THEN 1 WHEN contains(s, 'steel') THEN 0.7 ELSE 0.6 * (1 - levenshtein(s, 'steel')::DOUBLE / greatest(length(s), 5)) END, CASE WHEN s = 'tin' THEN 1 WHEN contains(s, 'tin') THEN 0.7 ELSE 0.6 * (1 - levenshtein(s, 'tin')::DOUBLE / greatest(length(s), 3)) END, 0), 9) AS score FROM (SELECT p_partkey, lower(p_type) AS s FROM part)""")
def i07_alias_match(t):
    return t("part").select("p_partkey", F.round(catalogs.alias_score(F.col("p_type"), ["Steel", "TIN"]), 9).alias("score"))


@add("SELECT p_partkey FROM part WHERE list_has_all([p_brand, p_type, p_size::VARCHAR], ['Brand#11', '10']) ")
def i08_tags(t):
    p = t("part").select("p_partkey", F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("tags"))
    return catalogs.tagged(p, "tags", ["Brand#11", "10"]).select("p_partkey")


@add("""WITH c AS (SELECT o_orderkey, 'DA-' || CASE o_orderstatus WHEN 'F' THEN 'VEC' WHEN 'O' THEN 'RAS' ELSE 'OTH' END || '-' || upper(substr(o_orderpriority, 1, 3)) || '-' || year(o_orderdate) || '-' || CASE WHEN length(to_hex(o_orderkey)) < 4 THEN lpad(upper(to_hex(o_orderkey)), 4, '0') ELSE upper(to_hex(o_orderkey)) END AS code FROM orders)
SELECT o_orderkey, code, regexp_matches(code, '^DA-[A-Z]{3}-[^-]{1,3}-[0-9]{4}-[0-9A-F]{4,}$') AS parses, CASE WHEN regexp_matches(code, '^DA-[A-Z]{3}-[^-]{1,3}-[0-9]{4}-[0-9A-F]{4,}$') THEN o_orderkey END AS number FROM c""")
def i09_asset_codes(t):
    kind = F.when(F.col("o_orderstatus") == "F", "vector").when(F.col("o_orderstatus") == "O", "raster").otherwise("what")
    o = t("orders").select("o_orderkey", catalogs.asset_code(F.col("o_orderkey"), kind, F.col("o_orderpriority"), F.year("o_orderdate")).alias("code"))
    parsed = catalogs.parsed_code(F.col("code"))
    return o.select("o_orderkey", "code", parsed.isNotNull().alias("parses"), parsed["number"].alias("number"))


_KINDS = {"number": r"[0-9]+(?:\.[0-9]+)?", "capital": "[A-Z][a-z]+", "any": "[a-z]{12,}"}


@add("""WITH f AS (SELECT doc_id, unnest(list_concat(list_transform(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), lambda x: {'k': 0, 'name': x}), list_transform(regexp_extract_all(text, '[A-Z][a-z]+'), lambda x: {'k': 1, 'name': x}), list_transform(regexp_extract_all(text, '[a-z]{12,}'), lambda x: {'k': 2, 'name': x}))) AS e FROM documents)
SELECT doc_id, e.name AS name, ['number', 'capital', 'any'][min(e.k) + 1] AS type FROM f GROUP BY 1, 2""")
def i10_entities(t):
    return catalogs.entities(t("documents"), "doc_id", "text", _KINDS)


@add("""WITH o AS (SELECT o_custkey, count(*) AS last FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT o_orderkey, n.o_custkey, coalesce(last, 0) + row_number() OVER (PARTITION BY n.o_custkey ORDER BY o_orderkey) AS version FROM orders n LEFT JOIN o USING (o_custkey) WHERE o_orderkey % 3 > 0""")
def f08_versions(t):
    o = t("orders")
    old = o.where("o_orderkey % 3 = 0").groupBy("o_custkey").agg(F.count("*").alias("version"))
    return catalogs.next_versions(o.where("o_orderkey % 3 > 0").select("o_orderkey", "o_custkey"), old, "o_custkey", "version", "o_orderkey")


@add("SELECT sha256(p_type) AS hash, min(p_partkey) AS p_partkey FROM part WHERE p_partkey > 3 AND p_type NOT IN (SELECT p_type FROM part WHERE p_partkey <= 3) GROUP BY 1")
def h05_insert_new(t):
    p = t("part").select("p_partkey", "p_type")
    return catalogs.insert_new(p.where("p_partkey <= 3"), p.where("p_partkey > 3"), "p_type", "p_partkey").select("hash", "p_partkey")


@add("SELECT c_custkey, ['vector', 'raster', 'tabular', 'other'][c_custkey % 4 + 1] AS kind FROM customer")
def c13_asset_types(t):
    ext = F.element_at(F.array(*map(F.lit, (".SHP", ".tiff", ".Parquet", ""))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t("customer").select("c_custkey", catalogs.asset_type(F.concat(F.lit("a.b/c."), "c_name", ext)).alias("kind"))


@add("SELECT c_custkey, round(0.5 + CASE WHEN c_custkey % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 0.15 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 0.15 ELSE 0 END, 9) AS score FROM customer")
def l18_metadata_score(t):
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", F.round(catalogs.metadata_score(k % 2 == 0, k % 3 == 0, F.col("c_acctbal") > 0), 9).alias("score"))


_AUDITS = "SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS met, count(*) FILTER (o_orderpriority = '1-URGENT') AS gap_count, 90.0 AS complete_percent, round(avg((o_totalprice > 1000)::INT), 4) AS valid_share, count(*) AS duplicate_count, o_custkey % 2 = 0 AS crs_ok FROM orders GROUP BY o_custkey"


@add(f"""WITH s AS (SELECT k, round(CASE WHEN met = 0 THEN 100 WHEN met < 5 THEN 50 ELSE 0 END * 0.25::DOUBLE + greatest(0, 100 - gap_count * 10) * 0.15::DOUBLE + complete_percent::DOUBLE * 0.2 + valid_share * 100 * 0.15::DOUBLE + greatest(0, 100 - duplicate_count * 5) * 0.1::DOUBLE + CASE WHEN crs_ok THEN 15 ELSE 0 END, 2) AS total FROM ({_AUDITS}))
SELECT k, total, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 60 THEN 'C' WHEN total >= 40 THEN 'D' ELSE 'F' END AS grade FROM s""")
def l19_governance(t):
    a = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("overlaps"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("gap_count"), F.lit(90.0).alias("complete_percent"),
        F.round(F.avg((F.col("o_totalprice") > 1000).cast("int")), 4).alias("valid_share"), F.count("*").alias("duplicate_count"))
    return catalogs.governance(a.withColumn("crs_ok", F.col("k") % 2 == 0)).select("k", "total", "grade")


#: Runs of a text and their kinds, each validated.
_LUHN = "list_sum(list_transform(range(1, length(v) + 1), lambda k: CASE WHEN k % 2 = 1 THEN reverse(v)[k]::INT WHEN reverse(v)[k]::INT > 4 THEN reverse(v)[k]::INT * 2 - 9 ELSE reverse(v)[k]::INT * 2 END))"
_CHECK = "list_sum(list_transform(range(1, 18), lambda k: v[k]::INT * " + str(privacy.ID_WEIGHTS) + "[k]))"
_PERSONAL = rf"""
cut AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '{privacy.RUN}')), '{privacy.EDGES}') AS v FROM documents),
held AS (SELECT * FROM cut WHERE length(v) >= 7 AND regexp_matches(v, '[0-9@]')),
typed AS (SELECT *, CASE
  WHEN regexp_matches(v, '^[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}$') THEN 'email'
  WHEN regexp_matches(v, '^(86)?1[3-9][0-9]{{9}}$') THEN 'phone'
  WHEN CASE WHEN regexp_matches(v, '^[0-9]{{17}}[0-9Xx]$') THEN '{privacy.ID_LETTERS}'[({_CHECK} % 11 + 1)::INT] = upper(v[18]) AND v[7:10]::INT BETWEEN 1900 AND 2099 AND v[11:12]::INT BETWEEN 1 AND 12 AND v[13:14]::INT BETWEEN 1 AND 31 END THEN 'id_card'
  WHEN CASE WHEN regexp_matches(v, '^[0-9]{{13,19}}$') THEN {_LUHN} % 10 = 0 END THEN 'bank_card'
  WHEN CASE WHEN regexp_matches(v, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') THEN list_max(list_transform(string_split(v, '.'), lambda o: o::INT)) <= 255 END THEN 'ip'
  WHEN CASE WHEN regexp_matches(v, '^[0-9]{{1,3}}\.[0-9]{{4,}}$') THEN v::DOUBLE <= 180 END THEN 'coordinate' END AS kind FROM held)"""


@add(f"WITH {_PERSONAL} SELECT doc_id, kind, v AS value, count(*) AS n FROM typed WHERE kind IS NOT NULL GROUP BY ALL")
def l24_personal_data(t):
    return privacy.personal(t("documents"), "doc_id", "text")


_LEVEL = "list_max([CASE WHEN id_card + bank_card > 0 THEN 3 END, CASE WHEN credential > 0 THEN 4 END, CASE WHEN phone > 0 THEN 2 END, CASE WHEN email + address + coordinate + ip > 0 THEN 1 END, 0])"


@add(rf"""WITH {_PERSONAL}, kinds AS (
  SELECT {", ".join(f"count(DISTINCT doc_id) FILTER (kind = '{k}') AS {k}" for k in privacy.KINDS)} FROM typed),
words AS (SELECT count(*) FILTER (regexp_matches(text, '{"|".join(privacy.ADDRESS_WORDS)}')) AS address, count(*) FILTER (regexp_matches(text, '{privacy.CREDENTIAL.replace(chr(39), chr(39) * 2)}')) AS credential FROM documents)
SELECT 'text' AS "column", phone, id_card, email, bank_card, address, coordinate, ip, credential, {privacy.LEVELS}[({_LEVEL} + 1)::INT] AS level FROM kinds, words
UNION ALL SELECT 'lang', 0, 0, 0, 0, 0, 0, 0, 0, 'public'""")
def l20_sensitivity(t):
    return privacy.sensitivity(t("documents"), ["text", "lang"])


@add("SELECT * FROM (VALUES ('1st', 'characters'), ('a b', 'characters'), (repeat('n', 31), 'length')) v(field, issue)")
def l21_naming(t):
    return catalogs.names(t("region"), ["ok_1", "地类", "1st", "a b", "n" * 31])


@add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.54 ELSE 0.84 END AS confidence, CASE WHEN o_orderstatus = 'F' THEN 'a' WHEN o_orderstatus = 'O' THEN 'b' ELSE 'a' END AS source FROM orders")
def l22_confidence(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", F.lit("F").alias("a"), F.lit("O").alias("b"))
    o = catalogs.confidence(o, {"a": {"timeliness": 0.9, "precision": 0.8, "completeness": 0.8}, "b": {"precision": 1.0, "timeliness": 0.75, "completeness": 0.8}}, F.col("o_orderstatus") == "P")
    return catalogs.provenance(o, "o_orderstatus", ["a", "b"], "source").select("o_orderkey", F.round("confidence", 6).alias("confidence"), "source")


@add("""SELECT p_brand, round(sum(CASE WHEN p_size > 30 THEN p_retailprice ELSE 0 END) / sum(p_retailprice) * 100, 6) AS cover, round(1 - max(p_retailprice) / sum(p_retailprice), 6) AS fragmentation FROM part GROUP BY 1""")
def e20_metrics(t):
    m = catalogs.metrics(t("part"), ["p_brand"], {"cover": "sum(CASE WHEN p_size > 30 THEN p_retailprice ELSE 0 END) / sum(p_retailprice) * 100", "fragmentation": "1 - max(p_retailprice) / sum(p_retailprice)"})
    return m.withColumns({"cover": F.round("cover", 6), "fragmentation": F.round("fragmentation", 6)})


@add("SELECT p_partkey, p_size * 3.0 AS height, round(4 * pi() * p_retailprice / 10000, 6) AS compactness, round(100 / (2 * sqrt(pi() * p_retailprice)), 6) AS shape_index FROM part")
def c14_derive(t):
    p = catalogs.derive(t("part").select("p_partkey", F.col("p_size").cast("double").alias("floors"), F.col("p_retailprice").alias("area"), F.lit(100.0).alias("perimeter")))
    return p.select("p_partkey", "height", F.round("compactness", 6).alias("compactness"), F.round("shape_index", 6).alias("shape_index"))


@add("""SELECT unnest(['priced', 'dated']) AS rule, unnest([count(*) FILTER (NOT abs(l_extendedprice - l_quantity * 1000) <= 20000), count(*) FILTER (NOT l_shipdate >= '1995-01-01')]) AS failures,
 round(1 - unnest([count(*) FILTER (NOT abs(l_extendedprice - l_quantity * 1000) <= 20000), count(*) FILTER (NOT l_shipdate >= '1995-01-01')]) / count(*), 9) AS pass_share FROM lineitem""")
def l23_rules(t):
    checks = {"priced": "abs(l_extendedprice - l_quantity * 1000) <= 20000", "dated": "l_shipdate >= TIMESTAMP '1995-01-01'"}
    return catalogs.rules(t("lineitem"), checks).withColumn("pass_share", F.round("pass_share", 9))


@add("SELECT year(o_orderdate) AS y, arg_min(o_orderkey, (abs(o_totalprice - 50000), o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def f09_nearest_per_year(t):
    o = t("orders").select(F.year("o_orderdate").alias("y"), "o_orderkey", "o_totalprice")
    return catalogs.nearest_per(o, ["y"], F.abs(F.col("o_totalprice") - 50000), "o_orderkey").select("y", "o_orderkey")


@add("SELECT c_nationkey, round(sum(CASE c_mktsegment WHEN 'BUILDING' THEN c_acctbal ELSE 0 END), 4) AS c_mktsegment_BUILDING, round(sum(CASE c_mktsegment WHEN 'MACHINERY' THEN c_acctbal ELSE 0 END), 4) AS c_mktsegment_MACHINERY FROM customer GROUP BY 1")
def d16_tabulate(t):
    s = catalogs.tabulate(t("customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"], "c_acctbal")
    return s.select("c_nationkey", *(F.round(c, 4).alias(c) for c in s.columns[1:]))


@add("""WITH d AS (SELECT 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT round(avg(d), 6) AS mean, round(max(d), 6) AS largest, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(stddev_pop(d), 6) AS sd FROM d""")
def e21_distance_summary(t):
    e = t("embeddings")
    p = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    s = catalogs.distance_summary(p, "a", "b")
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


_PSM = "q AS (SELECT o_orderkey AS k, o_orderkey % 4 = 0 AS t, (o_totalprice * 100)::BIGINT % 8191 / 8192 AS s, o_custkey % 50 AS y FROM orders), c AS (SELECT s, arg_min(y, k) AS y FROM q WHERE NOT t GROUP BY 1), m AS (SELECT a.y - (SELECT arg_min(c.y, (abs(c.s - a.s), c.s)) FROM c WHERE c.s BETWEEN a.s - 0.2 AND a.s + 0.2) AS d FROM q a WHERE a.t)"


@add(f"WITH {_PSM}, r AS (SELECT count(d) AS pairs, avg(d) AS effect, stddev_samp(d) / sqrt(count(d)) AS se FROM m) SELECT pairs, round(effect, 6) AS effect, round(se, 6) AS se, round(effect - 1.96 * se, 6) AS low, round(effect + 1.96 * se, 6) AS high FROM r")
def k22_matched_effect(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4 == 0).cast("int").alias("t"), (F.round(F.col("o_totalprice") * 100).cast("long") % 8191 / 8192).alias("s"), (F.col("o_custkey") % 50).alias("y"))
    m = catalogs.matched_effect(o, "k", "t", "s", "y")
    return m.select("pairs", *(F.round(c, 6).alias(c) for c in ("effect", "se", "low", "high")))


@add("""SELECT event_type, user_id % 3 AS project, round(sum(value), 4) AS total, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def e22_cost_by_two(t):
    e = t("events").withColumn("project", F.col("user_id") % 3)
    return audit.totals(e, ["event_type", "project"], "value").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@add("""SELECT count(*) AS n, count(*) FILTER (event_type = 'click') AS approved, count(*) FILTER (event_type = 'error') AS rejected, round(avg(value), 6) AS mean FROM events""")
def e23_decisions(t):
    return audit.decisions(t("events"), "event_type", {"approved": ["click"], "rejected": ["error"]}, "value").withColumn("mean", F.round("mean", 6))


@add("SELECT ts::DATE AS day, round(avg(value), 6) AS score, count(*) AS n, round(avg(avg(value)) OVER (ORDER BY ts::DATE ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS week FROM events GROUP BY 1")
def e24_eval_trend(t):
    return audit.trend(t("events"), "ts", "value").withColumns({"score": F.round("score", 6), "week": F.round("week", 6)})


@add(f"""WITH v AS (SELECT red, nir FROM ({_BANDS})) SELECT (SELECT count(*) FROM customer) AS assets, (SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey) AS active, (SELECT count(*) FROM v) AS pixels""")
def e25_overview(t):
    active = t("orders").select("o_custkey").distinct().join(t("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return audit.overview({"assets": t("customer"), "active": active, "pixels": _bands(t)})
