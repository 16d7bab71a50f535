"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

# sha1 in base 32: the 160 bits of the hex digits, five at a time.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
  CAST(16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT)
  + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT) AS BIGINT), 1)), '')"""

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS first_id FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
  CAST(4 * (instr('0123456789abcdef', substr(hex, i, 1)) - 1) + 1 AS BIGINT), 4)), '') AS bits FROM h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""


# Every word window of every document, found among the items' windows by its words.
OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM bw),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, h.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM dw) h JOIN win ON win.n = h.n AND win.k = h.k),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


# All pairs of rows that share a shingle, on whole sets; components by reaching.
OP3 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 85 * (x.n + y.n - p.k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""


# The same links at 80, without the column of the rows that stay.
OP12 = OP3.replace(">= 85", ">= 80").replace(", d.doc_id = component_id AS kept", "")


# crc32 of a decimal number: its digits' bytes, eight shifts each.
_CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295)"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

# Levels of all trees by recursion, then of the tree over their roots; every row's way through both, folded from below.
OP13 = f"""
WITH RECURSIVE d AS (SELECT *, {_LEAF.format("text")} AS leaf, {_CRC32.format("doc_id")} % 5 = 0 AS hit,
  {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents),
p AS (SELECT doc_id, leaf, CASE WHEN hit THEN low ELSE leaf END AS changed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS size FROM d),
up(tree, level, i, digest, size) AS (SELECT tree, 0, i, leaf, size FROM p
  UNION ALL SELECT tree, level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (size + 15) // 16 FROM up WHERE size > 1 GROUP BY tree, level, i // 16, size),
top(level, i, digest, size) AS (SELECT 0, tree, digest, (SELECT count(*) FROM up WHERE size = 1) FROM up WHERE size = 1
  UNION ALL SELECT level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (size + 15) // 16 FROM top WHERE size > 1 GROUP BY level, i // 16, size),
nodes AS (SELECT tree, level, i, digest, size, 0 AS above FROM up UNION ALL SELECT -1, level, i, digest, size, 1 FROM top),
row_of AS (SELECT row_number() OVER () - 1 AS r, * FROM p),
levels AS (SELECT DISTINCT tree, level, size, above FROM nodes WHERE size > 1),
steps AS (SELECT r, above, level, (CASE above WHEN 1 THEN row_of.tree ELSE row_of.i END) // CAST(16 ** level AS BIGINT) AS own, levels.tree AS t
  FROM row_of JOIN levels ON levels.above = 1 OR levels.tree = row_of.tree),
sides AS (SELECT r, steps.above, steps.level, coalesce(string_agg(digest, '' ORDER BY i) FILTER (i < own), '') AS l, coalesce(string_agg(digest, '' ORDER BY i) FILTER (i > own), '') AS g
  FROM steps JOIN nodes ON nodes.tree = t AND nodes.level = steps.level AND nodes.i // 16 = own // 16 GROUP BY r, steps.above, steps.level),
way AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY above, level) AS step FROM sides),
fold(r, step, digest) AS (SELECT r, 0, changed FROM row_of UNION ALL SELECT fold.r, way.step, sha256(l || digest || g) FROM fold JOIN way ON way.r = fold.r AND way.step = fold.step + 1),
proof AS (SELECT r, sha256(string_agg(l || g, '' ORDER BY step)) AS proof_sha256 FROM way GROUP BY r),
folded AS (SELECT r, arg_max(digest, step) AS folded_root FROM fold GROUP BY r)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.digest AS verified
FROM row_of JOIN up s ON s.tree = row_of.tree AND s.size = 1 JOIN top t ON t.size = 1 JOIN folded USING (r) LEFT JOIN proof USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op3_near_duplicates": OP3, "op6_warc": OP6, "op12_jaccard_join": OP12, "op13_merkle_manifest": OP13}
