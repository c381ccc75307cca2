"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Words as in the engine: runs of letters, digits and underscores.
OP9 = """
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
item_sets AS (
  SELECT item_id, least(len(w), 5) AS k,
         list_distinct(list_transform(range(0, len(w) - least(len(w), 5) + 1),
                                      lambda i: array_to_string(w[i + 1:i + least(len(w), 5)], ' '))) AS s
  FROM items WHERE len(w) > 0
),
wanted AS (SELECT item_id, k, len(s) AS n, unnest(s) AS shingle FROM item_sets),
sizes AS (SELECT DISTINCT k FROM wanted),
runs AS (
  SELECT d.doc_id, z.k, unnest(list_distinct(list_transform(range(0, len(w) - z.k + 1),
         lambda i: array_to_string(w[i + 1:i + z.k], ' ')))) AS shingle
  FROM docs d, sizes z WHERE len(w) >= z.k
)
SELECT r.doc_id, i.item_id, count(*) AS shared, CAST(any_value(i.n) AS BIGINT) AS item_shingles,
       count(*) / any_value(i.n) AS containment
FROM runs r JOIN wanted i ON i.k = r.k AND i.shingle = r.shingle
GROUP BY r.doc_id, i.item_id
HAVING count(*) >= 0.8 * any_value(i.n)"""

# Five hex digits of a SHA-1 make four base32 digits.
_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {i + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)"
    for i in range(0, 40, 5) for s in (15, 10, 5, 0))
OP7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to, sha256(html) AS payload_address
FROM f"""

ORACLE_SQL = {"op7_content_archive": OP7, "op9_decontamination": OP9}
