"""DuckDB SQL for the queries that SQL can express.

The others (token ids, n-gram models, lexing, HTML, WARC) are tested against
brute-force versions in tests/llm.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {
    # All pairs of documents that share an n-gram, then closure over the links.
    "op1_ngram_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
grams AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM words WHERE len(w) > 0),
each AS (SELECT doc_id, unnest(g) AS gram FROM grams),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT c.a, c.b, c.n = len(x.g) + len(y.g) - c.n AS copy
  FROM common c JOIN grams x ON x.doc_id = c.a JOIN grams y ON y.doc_id = c.b
  WHERE CAST(c.n AS DOUBLE) / (len(x.g) + len(y.g) - c.n) >= 0.8),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
class AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
counts AS (SELECT a, count(*) AS n, min(b) FILTER (WHERE copy) AS copy FROM links GROUP BY a)
SELECT d.doc_id, c.class_id, coalesce(n.n, 0) AS n_links, least(d.doc_id, coalesce(n.copy, d.doc_id)) AS copy_of
FROM documents d JOIN class c USING (doc_id) LEFT JOIN counts n ON n.a = d.doc_id""",
    "op6_cover_tree": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM component c LEFT JOIN counts n USING (vec_id)""",
    "op9_bit_sliced": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    # The checksum by its table of 256 remainders, a byte at a time.
    "op10_sharding": """
WITH remainders AS (SELECT list(r ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM (SELECT unnest(range(256)) AS i))),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS b FROM documents),
sums AS (
  SELECT doc_id, CAST(len(b) + 8 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
    list_transform(range(25), lambda i: CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT)) AS u
  FROM bytes, remainders),
placed AS (SELECT doc_id, size, text_crc32, CAST(list_position(u, list_max(u[1:24])) - 1 AS INTEGER) AS shard, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS grown_shard FROM sums)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM placed""",
}
