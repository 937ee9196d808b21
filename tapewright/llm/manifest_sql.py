"""The manifest's digest as SQL for DuckDB, which has SHA-256 but no CRC-32: that one is folded bit by bit."""

_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
#: CRC-32 of the decimal id: its polynomial, reflected, and the start and end mask.
_CRC = f"""xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT),
  lambda s, d: list_reduce([xor(s, d)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))"""

OP13_SQL = f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.replace("{n}", "n_chars")} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.replace("{n}", "(n_chars + 1)")} ELSE {_LEAF.replace("{n}", "n_chars")} END AS changed FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS node FROM ranked
  UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2, n),
subroots AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS t, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, t AS i, n, subroot AS node FROM subroots
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (
  SELECT r.tree, r.i, x.level, x.i & 1 AS side, s.node AS sibling FROM ranked r JOIN nodes x ON r.tree = x.tree AND r.i >> x.level = x.i AND x.n > 1
    LEFT JOIN nodes s ON s.tree = x.tree AND s.level = x.level AND s.i = xor(x.i, 1)
  UNION ALL
  SELECT r.tree, r.i, 100 + x.level, x.i & 1, s.node FROM ranked r JOIN subroots u ON r.tree = u.tree JOIN tops x ON u.t >> x.level = x.i AND x.n > 1
    LEFT JOIN tops s ON s.level = x.level AND s.i = xor(x.i, 1)),
paths AS (
  SELECT tree, i, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256, list(CASE WHEN side = 1 THEN sibling ELSE '' END ORDER BY level) AS lefts,
    list(CASE WHEN side = 1 THEN '' ELSE coalesce(sibling, '') END ORDER BY level) AS rights FROM steps GROUP BY tree, i),
proofs AS (SELECT r.doc_id, r.tree, r.leaf, r.changed, coalesce(proof_sha256, sha256('')) AS proof_sha256, coalesce(lefts, []) AS lefts, coalesce(rights, []) AS rights FROM ranked r LEFT JOIN paths p ON r.tree = p.tree AND r.i = p.i),
folds AS (
  SELECT *, 0 AS k, changed AS folded FROM proofs
  UNION ALL SELECT doc_id, tree, leaf, changed, proof_sha256, lefts, rights, k + 1, sha256(lefts[k + 1] || folded || rights[k + 1]) FROM folds WHERE k < len(lefts))
SELECT doc_id, leaf, subroot, node AS root, proof_sha256, folded AS folded_root, folded = node AS verified
FROM folds f JOIN subroots s ON f.tree = s.tree JOIN tops ON tops.n = 1 WHERE k = len(lefts)"""
