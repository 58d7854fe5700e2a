"""Queries on the dataset manifest (11) and the prefix trie (13)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .merkle import document_leaves, fold, merkle_manifest, proof_digest
from .prefix_trie import prefix_trie
from .registry import query

#: crc32 of a column of ASCII text: the table's 256 entries, then one step a character.
CRC32_SQL = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(n::UBIGINT, [x::UBIGINT FOR x IN range(8)]),
              lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n))"""


def crc32_sql(text: str) -> str:
    return (f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [ascii(ch)::UBIGINT FOR ch IN string_split({text}, '')]), "
            "lambda c, b: xor(t[(xor(c, b) & 255)::BIGINT + 1], c >> 8)))")


def field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(field_sql(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP11_SQL = f"""
WITH RECURSIVE {CRC32_SQL},
l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf_sql('n_chars')} AS leaf,
               CASE WHEN doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 7 = 0 THEN {leaf_sql('(n_chars + 1)')} END AS tampered
        FROM documents, crc_table)),
n AS (
  SELECT tree, 0 AS level, pos AS idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS wide FROM l
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(wide) + 1) // 2
  FROM n WHERE wide > 1 GROUP BY tree, level, idx // 2),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n WHERE wide = 1),
m AS (
  SELECT 0 AS level, pos AS idx, subroot AS digest, count(*) OVER () AS wide FROM s
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(wide) + 1) // 2
  FROM m WHERE wide > 1 GROUP BY level, idx // 2),
f AS (
  SELECT l.doc_id, l.tree, l.pos, l.leaf, coalesce(l.tampered, l.leaf) AS folded, '' AS proof, 0 AS level, l.pos AS idx, false AS up
  FROM l
  UNION ALL
  SELECT f.doc_id, f.tree, f.pos, f.leaf,
         CASE WHEN x.wide = 1 THEN f.folded
              WHEN y.digest IS NULL THEN sha256(f.folded)
              WHEN f.idx % 2 = 0 THEN sha256(f.folded || y.digest) ELSE sha256(y.digest || f.folded) END,
         CASE WHEN x.wide = 1 THEN f.proof ELSE f.proof || coalesce(y.digest, '') END,
         CASE WHEN x.wide = 1 THEN 0 ELSE f.level + 1 END,
         CASE WHEN x.wide = 1 THEN s.pos ELSE f.idx // 2 END, f.up OR x.wide = 1
  FROM f JOIN s ON s.tree = f.tree
  JOIN (SELECT tree, level, idx, digest, wide FROM n UNION ALL SELECT NULL, level, idx, digest, wide FROM m) x
    ON x.tree IS NOT DISTINCT FROM (CASE WHEN f.up THEN NULL ELSE f.tree END) AND x.level = f.level AND x.idx = f.idx
  LEFT JOIN (SELECT tree, level, idx, digest FROM n UNION ALL SELECT NULL, level, idx, digest FROM m) y
    ON y.tree IS NOT DISTINCT FROM x.tree AND y.level = x.level AND y.idx = xor(x.idx, 1) AND x.wide > 1
  WHERE NOT (f.up AND x.wide = 1)),
r AS (SELECT digest AS root FROM m WHERE wide = 1),
h AS (SELECT max(level) AS top FROM m)
SELECT f.doc_id, f.leaf, s.subroot, r.root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = r.root AS verified
FROM f JOIN s ON s.tree = f.tree, r, h WHERE f.up AND f.level = h.top
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof digest of every document, and the root that a
    tampered leaf leads to with the original siblings."""
    rows = merkle_manifest(document_leaves(table(spark, sf_dir, "documents")), ["doc_id"], ["doc_id", "tampered"])
    return (rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
            .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


OP13_SQL = f"""
WITH RECURSIVE {CRC32_SQL},
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_key) - 1 AS pos
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {crc32_sql('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o), crc_table),
b AS (
  SELECT c.conv_id, 0 AS own, o.pos, o.turn_key, o.words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.turn_key, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, count(*) OVER (PARTITION BY conv_id) AS total FROM b),
p AS (
  SELECT conv_id, 0 AS depth, '' AS node, NULL::VARCHAR AS up, 0::BIGINT AS words,
         (SELECT count(*) FROM s WHERE s.conv_id = c.conv_id) AS total FROM c
  UNION ALL
  SELECT s.conv_id, s.depth, sha256(p.node || s.turn_key), p.node, s.words, p.total
  FROM p JOIN s ON s.conv_id = p.conv_id AND s.depth = p.depth + 1),
n AS (
  SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE total = depth), '') AS ends
  FROM p GROUP BY node, depth),
k AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.node),
a AS (
  SELECT node AS top, node, up, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * words AS saved FROM w
  UNION ALL
  SELECT a.up, w.node, w.up, a.leaf, a.saved FROM a JOIN w ON w.node = a.up),
t AS (SELECT top, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY top)
SELECT w.conv_id, w.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, t.n_leaves, t.saved_tokens,
       sha256(w.ends) AS ends_sha256
FROM w JOIN t ON t.top = w.node LEFT JOIN w u ON u.node = w.up
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
