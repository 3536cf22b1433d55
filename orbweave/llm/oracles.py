"""DuckDB SQL for those operators' queries that SQL can express."""

from __future__ import annotations

from orbweave.llm.secrets import RULES, Rule

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, q.v, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""


def _either_case(pattern: str) -> str:
    """ASCII letters of the keywords in either case, with no folding of other letters."""
    head, bracket, rest = pattern.partition(")")
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + bracket + rest


def _kind(rank: int, rule: Rule) -> str:
    p = (_either_case(rule.pattern) if rule.any_case else rule.pattern).replace("'", "''")
    return f"""
SELECT doc, {rank} AS rank, '{rule.kind}' AS kind, s AS start, s + length(hit) AS stop FROM (
  SELECT doc, hits[i] AS hit, held[i] AS held,
    list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {rule.group}) AS held
    FROM docs WHERE regexp_matches(t, '{p}'))))
WHERE length(held) >= {rule.least}"""


SECRETS = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_kind(k, r) for k, r in enumerate(RULES))}),
found AS (
  SELECT doc, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
    string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (doc)
"""

INFILL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def _codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    def assigned(k: int) -> str:
        """Each part's entry of codebook k and its distance: exact in doubles for integers of this size."""
        far = "list_inner_product(p.v, p.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(p.v, b.v)"
        return f"""a{k} AS MATERIALIZED (
  SELECT row, part, min(struct_pack(far := {far}, entry := entry)) AS best FROM p JOIN b{k} b USING (part) GROUP BY row, part)"""

    def moved(k: int) -> str:
        return f"""m{k} AS (
  SELECT part, entry, list(c ORDER BY place) AS v FROM (
    SELECT part, a.best.entry AS entry, place, floor(sum(v[place]) / count(*)) AS c
    FROM a{k} a JOIN p USING (row, part), unnest(range(1, len(v) + 1)) AS t(place) GROUP BY ALL) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""

    steps = ",".join(f"\n{assigned(k)},\n{moved(k)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
p AS MATERIALIZED (SELECT row, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM kept, unnest(range({parts})) AS t(part)),
b0 AS (SELECT part, row - 1 AS entry, v FROM p WHERE row <= {entries}),{steps},
{assigned(rounds)},
coded AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM a{rounds} GROUP BY row),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), book
"""


CODES = _codes()
