"""SQL with the same results as the queries, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# CRC-32 of a decimal number, bit by bit.
CRC = """xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(({0})[i])::BIGINT),
  lambda c, b: list_reduce(range(8), lambda d, k: xor(d >> 1, (d & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _levels(name: str, nodes: str) -> str:
    """Levels (grp, pos, h, lvl, n) of the trees over ``nodes`` (grp, pos, h); n is the number of nodes of a level."""
    return f"""{name}_all(lvl, grp, pos, h) AS (
  SELECT 0, grp, pos, h FROM {nodes}
  UNION ALL
  SELECT lvl + 1, grp, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM {name}_all) WHERE c > 1 GROUP BY lvl, grp, pos // 16),
{name} AS (SELECT *, count(*) OVER (PARTITION BY grp, lvl) AS n FROM {name}_all),
{name}_path AS (
  SELECT a.grp, a.pos, list({{'l': coalesce(s.l, ''), 'r': coalesce(s.r, ''), 'h': ''}} ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL) AS path
  FROM {nodes} a LEFT JOIN (
    SELECT a.grp, a.pos, b.lvl,
      string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos // (16 ** b.lvl)::BIGINT) AS l,
      string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos // (16 ** b.lvl)::BIGINT) AS r
    FROM {nodes} a JOIN {name} b ON a.grp = b.grp AND b.n > 1 AND b.pos // 16 = a.pos // (16 ** (b.lvl + 1))::BIGINT
    GROUP BY a.grp, a.pos, b.lvl) s ON a.grp = s.grp AND a.pos = s.pos
  GROUP BY a.grp, a.pos)"""


MERKLE = f"""WITH RECURSIVE
docs AS (SELECT *, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS grp, {_leaf('text')} AS leaf,
  CASE WHEN {CRC.format('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h FROM docs),
{_levels('low', 'placed')},
subroots AS (SELECT grp AS of, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, h FROM low WHERE n = 1),
{_levels('top', 'subroots')},
done AS (
  SELECT p.doc_id, p.leaf, coalesce(p.tampered, p.leaf) AS start, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
    coalesce(a.path, []) || coalesce(b.path, []) AS path
  FROM placed p JOIN subroots s ON p.grp = s.of JOIN low_path a ON a.grp = p.grp AND a.pos = p.pos JOIN top_path b ON b.pos = s.pos),
folded AS (
  SELECT *, list_reduce(path, lambda x, s: {{'l': '', 'r': '', 'h': sha256(s.l || x.h || s.r)}}, {{'l': '', 'r': '', 'h': start}}).h AS folded_root FROM done)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded"""

JACCARD = f"""WITH RECURSIVE
parts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM parts),
nodes AS (SELECT row_number() OVER (ORDER BY least) AS node, s, len(s) AS n, least FROM (SELECT s, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s)),
items AS (SELECT node, n, unnest(s) AS t FROM nodes),
links AS (SELECT a.node AS x, b.node AS y FROM items a JOIN items b ON a.t = b.t AND a.node <> b.node AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT node, node FROM nodes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
named AS (SELECT r.x AS node, min(n.least) AS component_id FROM reach r JOIN nodes n ON n.node = r.y GROUP BY r.x)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE c.component_id END AS component_id
FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN named c ON c.node = n.node"""
