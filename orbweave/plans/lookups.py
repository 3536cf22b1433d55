"""Queries that look for what is alike: vectors, field names, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators import matching, vectors
from orbweave.plans.catalog import Catalog

FOUND = Catalog()
add = FOUND.add

#: Queries are the rows whose id is divisible by 20.
_VECTORS = """v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(embedding, embedding) > 0)"""


@add(f"""WITH {_VECTORS}, s AS (SELECT q.id AS query_id, c.id, list_cosine_similarity(q.v, c.v) AS s FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank, id, round(s, 6) AS similarity FROM s QUALIFY rank <= 10""")
def g08_vector_index_exact(t):
    index = vectors.Index(t("embeddings"), "vec_id", "embedding", lists=32)
    return index.search(t("embeddings").where("vec_id % 20 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


@add()
def g09_vector_index_recall(t):
    """Three quarters of the lists probed, as these vectors have no clusters; recall against all of them."""
    index, q = vectors.Index(t("embeddings"), "vec_id", "embedding", lists=32), t("embeddings").where("vec_id % 20 = 0")
    return vectors.recall(index.search(q, 10, probes=24), index.search(q, 10))


def _named(t) -> DataFrame:
    return t("part").where("p_name NOT LIKE '%old%'").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("type"), (F.col("p_size") / 100).alias("confidence"))


#: No two of these names are alike enough but for case, so clusters are groups of equal lower-cased names.
@add("""WITH n AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, p_brand AS type, p_size / 100 AS confidence FROM part WHERE p_name NOT LIKE '%old%')
SELECT name, type, confidence, n FROM (SELECT *, count(*) OVER (PARTITION BY lower(name), type) AS n FROM n) QUALIFY row_number() OVER (PARTITION BY lower(name), type ORDER BY confidence DESC, name) = 1""")
def i11_merged_entities(t):
    return matching.merged_entities(_named(t).select("name", "type", "confidence"))


@add("""WITH f AS (SELECT DISTINCT replace(p_name, ' ', '_') AS l, split_part(p_name, ' ', 1) || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS r FROM part)
SELECT l AS "left", r AS "right", round(0.5 + 0.2 * (0.6 + 0.4 * 2 * length(r) / (length(l) + length(r))), 2) AS confidence, 'fuzzy' AS kind FROM f""")
def i12_field_matches(t):
    snake = t("part").select(F.regexp_replace("p_name", " ", "_").alias("field"), F.lit("double").alias("type"))
    two = F.split("p_name", " ")
    camel = t("part").select(F.concat(two[0], F.initcap(two[1])).alias("field"), F.lit("int").alias("type"))
    return matching.match_fields(snake, camel)
