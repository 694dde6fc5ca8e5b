"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .codebooks import ENTRIES, PARTS, ROUNDS, SCALE

# crc32 of the decimal id: -1 stands for one shift, other entries for a byte that is put in
CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, strlen(s) + 1), lambda k: list_concat([ascii(s[k])], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""

MERKLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, n_chars, CAST(doc_id AS VARCHAR) AS s,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN {CRC32} % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS changed
  FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
low AS (
  SELECT 0 AS level, coalesce('=' || lang, '-') AS tree, place, leaf AS node FROM placed
  UNION ALL
  SELECT level + 1, tree, p, node FROM (
    SELECT max(level) AS level, tree, place // 2 AS p, sha256(string_agg(node, '' ORDER BY place)) AS node, max(size) AS size
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM low) GROUP BY tree, place // 2) WHERE size > 1),
low_tops AS (SELECT tree, max(level) AS top FROM low GROUP BY tree),
subroots AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place FROM low JOIN low_tops USING (tree) WHERE level = top),
high AS (
  SELECT 0 AS level, place, node FROM subroots
  UNION ALL
  SELECT level + 1, p, node FROM (
    SELECT max(level) AS level, place // 2 AS p, sha256(string_agg(node, '' ORDER BY place)) AS node, max(size) AS size
    FROM (SELECT *, count(*) OVER () AS size FROM high) GROUP BY place // 2) WHERE size > 1),
high_top AS (SELECT max(level) AS top FROM high),
walk AS (
  SELECT doc_id, leaf, coalesce('=' || lang, '-') AS tree, place, 0 AS level, coalesce(changed, leaf) AS node, '' AS proof FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree, w.place // 2, w.level + 1, sha256(CASE WHEN w.place % 2 = 1 THEN s.node || w.node ELSE w.node || coalesce(s.node, '') END), w.proof || coalesce(s.node, '')
  FROM walk w JOIN low_tops t ON t.tree = w.tree LEFT JOIN low s ON s.tree = w.tree AND s.level = w.level AND s.place = xor(w.place, 1) WHERE w.level < t.top),
climb AS (
  SELECT w.doc_id, w.leaf, r.node AS subroot, r.place, 0 AS level, w.node, w.proof FROM walk w JOIN low_tops t ON t.tree = w.tree AND t.top = w.level JOIN subroots r ON r.tree = w.tree
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.place // 2, c.level + 1, sha256(CASE WHEN c.place % 2 = 1 THEN s.node || c.node ELSE c.node || coalesce(s.node, '') END), c.proof || coalesce(s.node, '')
  FROM climb c JOIN high_top ON c.level < top LEFT JOIN high s ON s.level = c.level AND s.place = xor(c.place, 1))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM climb JOIN high_top ON level = top, (SELECT node AS root FROM high JOIN high_top ON level = top)
"""


def _codes_sql() -> str:
    """The rounds one behind the other; every part's entries are long rows (part, entry, position)."""
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS row FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cells AS (SELECT row, p AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) t(p))",
        f"books0 AS (SELECT part, row - 1 AS entry, v AS c FROM cells WHERE row <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT row, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
      SELECT row, part, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cells JOIN books{k} USING (part)) GROUP BY row, part)""")
        if k < ROUNDS:
            steps.append(f"""books{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM books{k} b LEFT JOIN (
      SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
        SELECT part, entry, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{k} JOIN cells USING (row, part), range(1, len(v) + 1) t(i) GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry))""")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books{ROUNDS})")
    steps.append(f"coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY row)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (row), digest"


# base32 of the SHA-1: ten hex digits are eight signs of five bits
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, trim(regexp_replace(coalesce(url, ''), '\\s+', ' ', 'g')) AS url FROM pages),
g AS (SELECT *, sha1(body) AS d, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  CASE WHEN url = '' THEN 'urn:none' ELSE url END AS target_uri, true AS digest_ok
FROM g
"""

ORACLE = {"op5_warc_salvage": WARC, "op11_merkle_manifest": MERKLE, "op12_vector_codes": _codes_sql()}
