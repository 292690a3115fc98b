"""DuckDB SQL of the corpus queries whose results SQL can express in full."""

from __future__ import annotations


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of the decimal doc_id, bit by bit (the reflected polynomial 0xEDB88320).
_MIXED = "CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INTEGER, 1))::BIGINT) ELSE c END"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(doc_id::VARCHAR))), lambda c, i: xor(({_MIXED}) >> 1, 3988292384 * (({_MIXED}) & 1))))"

#: Nodes of all trees, level by level; tree 0 is the one over the sources.
MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id::BIGINT AS doc_id, source, lang, n_chars::BIGINT AS n_chars, text FROM documents),
l AS (SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS found,
    dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_leaf("text")}) - 1 AS idx FROM d),
up(tree, level, idx, h) AS (
  SELECT tree, 0, idx, leaf FROM l
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up
  WHERE (tree, level) IN (SELECT (tree, level) FROM up GROUP BY tree, level HAVING count(*) > 1)
  GROUP BY tree, level, idx // 3),
sub AS (SELECT tree, max(level) AS levels, arg_max(h, level) AS subroot FROM up GROUP BY tree),
top(level, idx, h) AS (
  SELECT 0, tree - 1, subroot FROM sub
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top
  WHERE (SELECT count(*) FROM top) > 1 GROUP BY level, idx // 3),
fin AS (SELECT max(level) AS levels, arg_max(h, level) AS root FROM top),
near AS (
  SELECT l.doc_id, l.leaf, l.idx AS place, l.tree, k.level AS step, coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx < l.idx // (3 ** k.level)::BIGINT), '') AS before,
    coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx > l.idx // (3 ** k.level)::BIGINT), '') AS after
  FROM l JOIN sub USING (tree) JOIN (SELECT unnest(range(0, 40)) AS level) k ON k.level < sub.levels
  JOIN up n ON n.tree = l.tree AND n.level = k.level AND n.idx // 3 = l.idx // (3 ** (k.level + 1))::BIGINT
  GROUP BY l.doc_id, l.leaf, l.idx, l.tree, k.level),
high AS (
  SELECT t.tree, 1000 + k.level AS step, coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx < (t.tree - 1) // (3 ** k.level)::BIGINT), '') AS before,
    coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx > (t.tree - 1) // (3 ** k.level)::BIGINT), '') AS after
  FROM sub t JOIN fin ON true JOIN (SELECT unnest(range(0, 40)) AS level) k ON k.level < fin.levels
  JOIN top n ON n.level = k.level AND n.idx // 3 = (t.tree - 1) // (3 ** (k.level + 1))::BIGINT
  GROUP BY t.tree, k.level),
steps AS (SELECT tree, place, step, before, after FROM near UNION ALL SELECT l.tree, l.idx, step, before, after FROM l JOIN high USING (tree)),
path AS (SELECT tree, place, list({{'before': before, 'after': after}} ORDER BY step) AS path, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY tree, place),
fold AS (SELECT l.tree, l.idx, list_reduce(list_prepend({{'before': l.found, 'after': ''}}, coalesce(path, [])), lambda a, s: {{'before': sha256(s.before || a.before || s.after), 'after': ''}}).before AS folded
  FROM l LEFT JOIN path p ON p.tree = l.tree AND p.place = l.idx)
SELECT l.doc_id, l.leaf, sub.subroot, fin.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded AS folded_root, f.folded = fin.root AS verified
FROM l JOIN sub USING (tree) JOIN fin ON true JOIN fold f ON f.tree = l.tree AND f.idx = l.idx LEFT JOIN path p ON p.tree = l.tree AND p.place = l.idx
"""

NEGATIVES_SQL = """
WITH e AS (SELECT vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
