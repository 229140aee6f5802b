"""SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

OP3_WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, upper(sha1(encode(coalesce(html, '')))) AS h FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS lead FROM p
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> (15 - 5 * k)) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM g
"""

OP6_EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least ON least.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
"""

OP8_SUFFIX_ARRAY_DEDUP = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS bytes, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, i, md5_number(bytes[i + 1 : i + 200]) AS k FROM (SELECT doc_id, bytes, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1
), s AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM r
), t AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s
), spans AS (
  SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM t GROUP BY doc_id, run
), cut AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM spans
), kept AS (
  SELECT c.doc_id, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed,
    string_agg(CASE WHEN s > before THEN hex(bytes[before + 1 : s]) ELSE '' END, '' ORDER BY s) || CASE WHEN max(e) < any_value(n) THEN hex(any_value(bytes)[max(e) + 1 : any_value(n)]) ELSE '' END AS rest
  FROM cut c JOIN d USING (doc_id) GROUP BY c.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN rest IS NULL THEN bytes ELSE unhex(rest) END) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10_NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
), sizes AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), meets AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM meets JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = w.doc_id
"""

SQL = {"op3_warc": OP3_WARC, "op6_embedding_near_dedup": OP6_EMBEDDING_NEAR_DEDUP, "op8_suffix_array_dedup": OP8_SUFFIX_ARRAY_DEDUP, "op10_ngram_jaccard_join": OP10_NGRAM_JACCARD_JOIN}
