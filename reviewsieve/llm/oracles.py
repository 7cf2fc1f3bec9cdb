"""SQL twins of the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _crc32(value: str) -> str:
    """CRC-32 of a whole number's decimal text, bit by bit."""
    return f"""xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"""


ORACLES: dict[str, str] = {
    # All pairs of documents that share a five-word shingle, then what can be reached by links.
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM said WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT x, y, common = p.n AND common = q.n AS same
  FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 5 * common >= 4 * (p.n + q.n - common)),
reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reached GROUP BY x),
counts AS (SELECT x AS doc_id, count(*) AS n, count(*) FILTER (WHERE same) AS copies FROM links GROUP BY x)
SELECT doc_id, class_id, CAST(1 + coalesce(copies, 0) AS BIGINT) AS n_copies,
       CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM classes LEFT JOIN counts USING (doc_id)""",
    "op4_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok'
  FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
placed AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS role_out,
         regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS text_out
  FROM turns),
sized AS (
  SELECT *, length(text_out) + CASE WHEN before IS DISTINCT FROM role
         THEN length('<|im_start|>') + length(role_out) + length('<|im_sep|>') + length('<|im_end|>')
         ELSE length('<|im_sep|>') END AS size
  FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
         AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
         FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op6_warc": f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM payloads GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('{_LETTERS}',
         CAST((CAST('0x' || substr(digest, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT)
               >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM payloads JOIN firsts USING (html)""",
    # All nodes level by level, first of each language's tree, then of the tree over languages.
    "op11_merkle_manifest": r"""
WITH RECURSIVE said AS (
  SELECT *, concat(
      coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
      coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(""" + _crc32("doc_id") + r""" % 7 = 0, false) AS tampered
  FROM (SELECT doc_id, source, lang, text, n_chars FROM documents)),
leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, sha256(concat(head,
      coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), tail)) AS leaf,
    CASE WHEN tampered THEN sha256(concat(head,
      coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-'), tail)) END AS changed
  FROM said),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, i AS p, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, p // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY p))
  FROM nodes WHERE n > 1 GROUP BY tree, level, p // 2),
subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS g, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, g AS p, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, p // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY p))
  FROM upper WHERE n > 1 GROUP BY level, p // 2),
heights AS (SELECT tree, max(level) AS h FROM nodes GROUP BY tree),
steps AS (
  SELECT d.doc_id, d.tree, d.i, k.level, s.digest AS sibling, (d.i >> k.level) % 2 = 1 AS is_left
  FROM placed d JOIN heights t USING (tree)
  JOIN (SELECT DISTINCT tree, level FROM nodes) k ON k.tree = d.tree AND k.level < t.h
  LEFT JOIN nodes s ON s.tree = d.tree AND s.level = k.level AND s.p = xor(d.i >> k.level, 1)
  UNION ALL
  SELECT d.doc_id, d.tree, d.i, t.h + k.level, s.digest, (r.g >> k.level) % 2 = 1
  FROM placed d JOIN heights t USING (tree) JOIN subroots r USING (tree)
  JOIN (SELECT DISTINCT level FROM upper) k ON k.level < (SELECT max(level) FROM upper)
  LEFT JOIN upper s ON s.level = k.level AND s.p = xor(r.g >> k.level, 1)),
paths AS (
  SELECT tree, i, list({'sibling': sibling, 'is_left': is_left} ORDER BY level) AS path,
         coalesce(string_agg(sibling, '' ORDER BY level), '') AS said
  FROM steps GROUP BY tree, i),
folding AS (
  SELECT d.doc_id, d.tree, d.i, 1 AS k, coalesce(changed, leaf) AS node,
         coalesce(path, []) AS path
  FROM placed d LEFT JOIN paths USING (tree, i)
  UNION ALL
  SELECT doc_id, tree, i, k + 1, sha256(CASE WHEN path[k].sibling IS NULL THEN node
           WHEN path[k].is_left THEN path[k].sibling || node ELSE node || path[k].sibling END), path
  FROM folding WHERE k <= len(path))
SELECT d.doc_id, d.leaf, r.subroot, u.digest AS root, sha256(coalesce(p.said, '')) AS proof_sha256,
       f.node AS folded_root, f.node = u.digest AS verified
FROM placed d JOIN subroots r USING (tree) LEFT JOIN paths p USING (tree, i)
JOIN folding f ON f.tree = d.tree AND f.i = d.i AND f.k = len(f.path) + 1
CROSS JOIN (SELECT digest FROM upper WHERE n = 1) u""",
    # Nodes are strings of turn digests of one length, so a subtree is what begins alike.
    "op13_conversation_trie": r"""
WITH said AS (
  SELECT conv_id, turn, text, sha256(strlen(role) || ':' || role || text) AS id
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
  WHERE conv_id IS NOT NULL),
ordered AS (
  SELECT conv_id, id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(id, 1, 32)) AS pos
  FROM said),
members AS (
  SELECT conv_id, """ + _crc32("conv_id") + r""" % 4 AS h FROM (SELECT DISTINCT conv_id FROM said)),
rebuilt AS (
  SELECT m.conv_id, false AS own, o.pos, o.id, o.words
  FROM members m JOIN ordered o ON o.conv_id = m.conv_id - m.conv_id % 20 AND o.pos <= m.h
  UNION ALL
  SELECT m.conv_id, true, o.pos, o.id, o.words
  FROM members m JOIN ordered o ON o.conv_id = m.conv_id AND o.pos > m.h),
prefixes AS (
  SELECT conv_id, words, row_number() OVER w AS depth, string_agg(id, '') OVER w AS node
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM members),
lengths AS (SELECT conv_id, max(depth) AS n FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE depth = n), '') AS ends
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY depth, node),
children AS (
  SELECT p.node, count(c.node) AS n
  FROM nodes p LEFT JOIN nodes c ON c.depth = p.depth + 1 AND left(c.node, -64) = p.node
  GROUP BY p.node),
below AS (
  SELECT a.node, count(*) FILTER (WHERE k.n = 0) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved
  FROM nodes a JOIN nodes b ON starts_with(b.node, a.node) JOIN children k ON k.node = b.node
  GROUP BY a.node)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, k.n AS n_children, b.n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a JOIN children k USING (node) JOIN below b USING (node)
LEFT JOIN nodes p ON a.depth > 0 AND p.depth = a.depth - 1 AND p.node = left(a.node, -64)""",
}
