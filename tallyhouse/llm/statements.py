"""DuckDB statements of the corpus queries that SQL can express."""

from __future__ import annotations

from tallyhouse.llm.quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{word}'" for word in STOP_WORDS)

OP5 = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), numbered AS (
  SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM split
), windows AS (
  SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM numbered WINDOW o AS (PARTITION BY r ORDER BY i)
), seen AS (
  SELECT r, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) > 1 AS again FROM windows
), covered AS (
  SELECT r, i, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS hit
  FROM seen WINDOW o AS (PARTITION BY r ORDER BY i)
), repeats AS (
  SELECT r, count(*) FILTER (WHERE hit) AS n FROM covered GROUP BY r
), counted AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '!')) AS bangs,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS stops,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets
  FROM split LEFT JOIN repeats USING (r)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.15
       AND bangs / n_words <= 0.3 AND stops / n_words >= 0.05 AND n_dup_lines / n_lines <= 0.4
       AND ellipses / n_lines <= 0.3 AND bullets / n_lines <= 0.9 AS kept
FROM based
"""

#: over the smallest record id of equal payloads; base 32 is spelt from the SHA-1 digits in groups of 20 bits
OP10 = """
WITH coded AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), digits AS (
  SELECT page_id, strlen(payload) AS payload_bytes, min(page_id) OVER (PARTITION BY payload) AS first,
         array_to_string(list_transform(range(0, 8), lambda g:
           array_to_string(list_transform(range(0, 4), lambda d:
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    1 + ((('0x' || substr(hex, 1 + 5 * g, 5))::BIGINT >> (15 - 5 * d)) & 31)::INTEGER, 1)), '')), '') AS payload_digest
  FROM coded
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM digits
"""



def _round(i: int) -> str:
    """Every vector's nearest centroid of round `i`, and the floored means that are the next centroids."""
    return f"""
near{i} AS (
  SELECT r, min({{'d': d, 'k': k}}) AS m FROM (
    SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM vectors, middle{i})
  GROUP BY r
), sum{i} AS (
  SELECT k, place, sum(part)::BIGINT AS s, count(*) AS n FROM (
    SELECT m.k AS k, generate_subscripts(v, 1) AS place, unnest(v) AS part FROM near{i} JOIN vectors USING (r)) GROUP BY k, place
), middle{i + 1} AS (
  SELECT k, coalesce(moved, c) AS c FROM middle{i} LEFT JOIN (
    SELECT k, list((s - (s % n + n) % n) // n ORDER BY place) AS moved FROM sum{i} GROUP BY k) USING (k)
)"""


#: every round spelt out; all distances, no walk
OP11 = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(abs(x::DOUBLE) < 262144, false)))
), middle0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM vectors QUALIFY k < 40
), """ + ",".join(map(_round, range(6))) + """
SELECT vec_id, m.k::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near5 JOIN vectors USING (r) JOIN middle5 ON k = m.k
"""

STATEMENTS: dict[str, str] = {"op5_quality_rules": OP5, "op10_warc": OP10, "op11_centroids": OP11}
