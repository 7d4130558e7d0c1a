"""SQL counterparts, for DuckDB, of the queries that SQL can express on whole tables."""

from __future__ import annotations

#: Shingle sets, a prefix join on their rarest shingles, links on full sets, the smallest id reachable.
NEAR_DUPLICATES = r"""WITH RECURSIVE c AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(10))]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]) END) AS s FROM c),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
f AS (SELECT x, count(*) AS f FROM t GROUP BY x),
r AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS k FROM t JOIN f USING (x)),
p AS (SELECT doc_id, n, x FROM r WHERE k <= n - (85 * n + 99) // 100 + 1),
q AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
l AS (SELECT a, b FROM (SELECT q.a, q.b, len(list_intersect(sa.s, sb.s)) AS shared, len(sa.s) + len(sb.s) AS together
  FROM q JOIN s sa ON sa.doc_id = q.a JOIN s sb ON sb.doc_id = q.b) WHERE 100 * shared >= 85 * (together - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""

#: A prefix join of word sets; a line goes if an earlier one is similar.
LINES = r"""WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
s AS (SELECT doc_id, i, line, list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS s FROM l),
t AS (SELECT doc_id, i, len(s) AS n, unnest(s) AS x FROM s),
f AS (SELECT x, count(*) AS f FROM t GROUP BY x),
r AS (SELECT doc_id, i, n, x, row_number() OVER (PARTITION BY doc_id, i ORDER BY f, x) AS k FROM t JOIN f USING (x)),
p AS (SELECT doc_id, i, n, x FROM r WHERE k <= n - (80 * n + 99) // 100 + 1),
q AS (SELECT DISTINCT a.doc_id AS d0, a.i AS i0, b.doc_id AS d1, b.i AS i1 FROM p a JOIN p b ON a.x = b.x AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i)
  AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
gone AS (SELECT DISTINCT d1 AS doc_id, i1 AS i FROM (SELECT d1, i1, len(list_intersect(x.s, y.s)) AS shared, len(x.s) + len(y.s) AS together
  FROM q JOIN s x ON x.doc_id = d0 AND x.i = i0 JOIN s y ON y.doc_id = d1 AND y.i = i1) WHERE 100 * shared >= 80 * (together - shared))
SELECT s.doc_id, count(*) FILTER (len(s.s) > 0) AS n_lines, count(gone.doc_id) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY s.i) FILTER (gone.doc_id IS NULL), '') AS text
FROM s LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.i = s.i GROUP BY s.doc_id"""

#: Every window of 200 bytes by its contents; covered bytes go.
REPEATS = r"""WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, i, md5(CAST(h[i + 1:i + 200] AS VARCHAR)) AS m FROM (SELECT doc_id, h, unnest(range(octet_length(h) - 199)) AS i FROM b)),
again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN again USING (m)),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS lo, max(i) + 200 AS hi FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM span
  UNION ALL SELECT doc_id, 0, min(lo) FROM span GROUP BY doc_id),
kept AS (SELECT b.doc_id, string_agg(hex(h[lo + 1:coalesce(hi, octet_length(h))]), '' ORDER BY lo) AS h FROM gap JOIN b USING (doc_id) GROUP BY b.doc_id),
n AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT b.doc_id, octet_length(b.h) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, hex(b.h)))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES = {"op1_minhash": NEAR_DUPLICATES, "op5_line_dedup": LINES, "op6_suffix_dedup": REPEATS}

#: The unsigned crc32 of the characters of ``{x}`` (code points below 128).
CRC32 = """xor(list_reduce(list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce(
  [xor(a, b)] || list_transform(range(8), lambda i: CAST(0 AS BIGINT)), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)), CAST(4294967295 AS BIGINT)), 4294967295)"""

#: Rebuilt conversations as lists of turns, nodes as their distinct prefixes, subtrees by the prefixes that continue a node.
PREFIX_TRIE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, {{'role': role, 'text': text}} AS x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS k FROM t),
l AS (SELECT c, list(x ORDER BY k) AS own, {CRC32.format(x="CAST(c AS VARCHAR)")} % 4 AS h FROM o GROUP BY c),
r AS (SELECT a.c, coalesce(b.own[1:a.h], []) || a.own[a.h + 1:] AS p FROM l a LEFT JOIN l b ON b.c = a.c - a.c % 20),
m AS (SELECT c, len(p) AS n, d, p[1:d] AS p FROM (SELECT c, p, unnest(range(len(p) + 1)) AS d FROM r)),
v AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends,
  len(list_filter(string_split_regex(coalesce(p[d].text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words FROM m GROUP BY d, p),
e AS (SELECT a.*, b.conv_id AS parent_conv_id FROM v a LEFT JOIN v b ON b.d = a.d - 1 AND b.p = a.p[1:a.d - 1]),
k AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
f AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN k USING (d, p)),
s AS (SELECT a.d, a.conv_id, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens
  FROM f a JOIN m ON m.d = a.d AND m.p = a.p JOIN f b ON b.conv_id = m.c AND b.d >= a.d GROUP BY a.d, a.conv_id)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM f JOIN s USING (d, conv_id)"""

ORACLES |= {"op11_prefix_trie": PREFIX_TRIE}

#: Every query against every other row, products summed in order.
NEAREST = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT row_number() OVER () AS r, vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM v),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]), lambda a, b: a + b) / (q.n * c.n) AS score
  FROM n q JOIN n c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""

ORACLES |= {"op12_nearest": NEAREST}


def _edit(state: str, letter: str, cost: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _shift(role: str, initial: str, *tops: str) -> list[str]:
    """Keep and rerole from each of ``tops``, where the row may stay (``c`` is too large to be chosen where it may not)."""
    keep = f"e + CASE WHEN fault IN ('b', 'd') OR role[1:1] <> '{initial}' THEN 1000000000 ELSE 0 END"
    change = "2 + e + CASE WHEN fault IN ('b', 'd') THEN 1000000000 ELSE 0 END"
    return [x for top in tops for x in (_edit(top, "K", keep, "chr(10) || role || ':' || text"), _edit(top, "R", change, f"chr(10) || '{role}:' || text"))]


_NONE = "{'c': CAST(2000000000 AS BIGINT), 'a': '', 't': ''}"
_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

#: Damage, faults, and a table of the cheapest edits to each of the four tops, row by row.
REPAIR = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {CRC32.format(x="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), copy) AS i FROM x),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS z FROM o),
f AS (SELECT *, CASE WHEN z = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM l),
r AS (SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS e FROM f),
s AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {_NONE} AS s1, {{'c': CAST(2 AS BIGINT), 'a': 'I', 't': {_USER}}} AS s2,
  {{'c': CAST(4 AS BIGINT), 'a': 'II', 't': {_USER} || {_ASSISTANT}}} AS s3 FROM conversations
UNION ALL SELECT conv_id, i, s0, s1, {_least("n2", _edit("n3", "I", "2", _USER))}, n3 FROM (
  SELECT conv_id, i, s0, s1, n2, {_least("s3", _edit("n2", "I", "2", _ASSISTANT))} AS n3 FROM (
  SELECT conv_id, i, s0, s1, {_least("s2", *[_edit(s, "I", "2", _USER) for s in ("s0", "s1", "s3")])} AS n2, s3 FROM (
  SELECT s.conv_id, r.i, {_edit("s0", "D", "3")} AS s0,
    {_least(_edit("s1", "D", "3"), _edit("s0", "K", "e + CASE WHEN fault IN ('b', 'd') OR role[1:1] <> 's' THEN 1000000000 ELSE 0 END", "chr(10) || role || ':' || text"))} AS s1,
    {_least(_edit("s2", "D", "3"), *_shift("user", "u", "s0", "s1", "s3"))} AS s2, {_least(_edit("s3", "D", "3"), *_shift("assistant", "a", "s2"))} AS s3
  FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1)))),
b AS (SELECT conv_id, {_least("s0", "s3")} AS b FROM (SELECT conv_id, arg_max(s0, i) AS s0, arg_max(s3, i) AS s3 FROM s GROUP BY conv_id)),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(b.b.c AS BIGINT) AS cost, b.b.a AS audit, sha256(b.b.t[2:]) AS repaired_sha256
FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id"""

ORACLES |= {"op13_conversation_repair": REPAIR}
