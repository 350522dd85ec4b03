"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, p, n FROM dw JOIN iw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

REPETITION = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (
  SELECT doc_id, p, w[p:p + 2] AS g3, CASE WHEN p + 9 <= len(w) THEN w[p:p + 9] END AS g10
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 3)),
r3 AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g3) AS n FROM g) WHERE n > 1),
r10 AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g10) AS n FROM g WHERE g10 IS NOT NULL)
  WHERE n > 1),
c3 AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS x FROM r3) GROUP BY doc_id),
c10 AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + 10)) AS x FROM r10) GROUP BY doc_id),
r201 AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, count(*) OVER (PARTITION BY doc_id, w[p:p + 200]) AS n
    FROM r10 JOIN w USING (doc_id) WHERE p + 200 <= len(w)) WHERE n > 1),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c3.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(c10.n, 0) AS BIGINT) AS n_covered_words, r201.doc_id IS NOT NULL AS too_long
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c10 USING (doc_id) LEFT JOIN r201 USING (doc_id))
SELECT * EXCLUDE (too_long), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_covered_words <= CAST(0.3 AS DOUBLE) * n_words AND NOT too_long AS kept
FROM m
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (shingle) JOIN n na ON na.doc_id = a.doc_id
  JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_REPEATS = """
f AS (SELECT win, min((doc_id, p)) AS first, count(*) AS n FROM g GROUP BY win HAVING count(*) > 1),
r AS (SELECT doc_id, p, {size} AS size, (doc_id, p) > first AS later, first[1] AS first_id FROM g JOIN f USING (win)),
u AS (SELECT doc_id, later, first_id, unnest(range(p, p + size)) AS x FROM r),
s AS (
  SELECT doc_id, count(DISTINCT x) AS n_repeated, count(DISTINCT x) FILTER (later) AS n_removed,
    list_sort(list(DISTINCT first_id) FILTER (later)) AS first_docs
  FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS {units}, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(first_docs, CAST([] AS BIGINT[])) AS first_docs
FROM d LEFT JOIN s USING (doc_id)
"""

SENTENCE_SPANS = rf"""
WITH t AS (
  SELECT doc_id, list_transform(regexp_extract_all({LOWER}, '[^.!?\n]+'), lambda x: regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS ws
  FROM documents),
d AS (
  SELECT doc_id, list_filter(list_transform(flatten(list_transform(ws, lambda s: string_split(array_to_string(list_transform(s,
    lambda x: x || CASE WHEN len(s) > 30 AND list_sum(list_transform(string_split(regexp_replace(x, '[^\x00-\x7F]', '', 'g'), ''),
      lambda c: ascii(c))) % 3 = 0 THEN chr(10) ELSE '' END), ' '), chr(10)))), lambda u: trim(u)), lambda u: u <> '') AS w
  FROM t),
n AS (
  SELECT doc_id, p, u, sum(len(string_split(u, ' '))) OVER (PARTITION BY doc_id ORDER BY p) AS upto
  FROM (SELECT doc_id, unnest(w) AS u, generate_subscripts(w, 1) AS p FROM d)),
c AS (SELECT doc_id, list(u ORDER BY p) AS w, list_prepend(0, list(upto ORDER BY p)) AS c FROM n GROUP BY doc_id),
e AS (
  SELECT doc_id, w, p, coalesce(list_filter(range(p + 1, least(p + 36, len(w)) + 1), lambda q: c[q + 1] - c[p] >= 36)[1],
    CASE WHEN p = 1 AND len(w) >= 2 AND c[len(w) + 1] < 36 THEN len(w) END) AS last
  FROM (SELECT doc_id, w, c, unnest(range(1, len(w) + 1)) AS p FROM c)),
g AS (SELECT doc_id, p, last - p + 1 AS size, array_to_string(w[p:last], chr(10)) AS win FROM e WHERE last IS NOT NULL),
""" + _REPEATS.format(size="size", units="n_sentences")

REPEATED_PASSAGES = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
""" + _REPEATS.format(size=50, units="n_words")

SOURCE_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat('1|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, count(*) AS n FROM d GROUP BY source),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
    CAST(3 * total AS DOUBLE) AS cap, CAST(sum(total) OVER () AS DOUBLE) AS corpus FROM s),
c AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS r FROM w),
l AS (
  SELECT *, (corpus - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM c),
t AS (
  SELECT source, total, n, least((SELECT share FROM l WHERE share * w <= cap ORDER BY r LIMIT 1) * w, cap) AS target FROM l),
q AS (
  SELECT *, greatest(1, ceil(total / 65536), ceil(n / 4096)) AS blocks,
    CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS passes FROM t),
p AS (
  SELECT d.*, q.total, q.target, q.passes, q.target - q.passes * q.total AS rest,
    CAST('0x' || substr(h, 1, 15) AS BIGINT) % CAST(blocks AS BIGINT) AS block
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (
  SELECT source, block, words, coalesce(sum(words) OVER (
    PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, block, sum(size) AS words FROM p GROUP BY source, block)),
m AS (
  SELECT p.*, b.before, b.words,
    sum(size) OVER (PARTITION BY p.source, p.block ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS middle
  FROM p JOIN b ON p.block = b.block AND p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, total AS source_size, target, CAST(size * (passes + CASE
  WHEN before + words <= rest THEN 1 WHEN before < rest AND middle <= rest - before THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC32 = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)),
  CAST(4294967295 AS BIGINT))"""

MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
    CASE WHEN {_CRC32} % 5 = 0 THEN sha256({_LEAF} || {_FIELD.format(LOWER)}) END AS changed
  FROM documents),
l AS (
  SELECT row_number() OVER () AS r, doc_id, leaf, coalesce(changed, leaf) AS other,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM d),
up(tree, level, pos, n, node) AS (
  SELECT tree, 0, pos, n, leaf FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1
  GROUP BY tree, level, pos // 16),
sub AS (SELECT tree, node AS subroot, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, pos, n, node) AS (
  SELECT 0, tree, n, subroot FROM sub
  UNION ALL
  SELECT level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1
  GROUP BY level, pos // 16),
walk(r, tree, level, pos, n, proof, fold) AS (
  SELECT r, tree, 0, pos, n, '', other FROM l
  UNION ALL
  SELECT r, w.tree, w.level + 1, any_value(w.pos) // 16, (any_value(w.n) + 15) // 16,
    any_value(w.proof) || coalesce(string_agg(up.node, '' ORDER BY up.pos) FILTER (up.pos <> w.pos), ''),
    sha256(string_agg(CASE WHEN up.pos = w.pos THEN w.fold ELSE up.node END, '' ORDER BY up.pos))
  FROM walk w JOIN up ON up.tree = w.tree AND up.level = w.level AND up.pos // 16 = w.pos // 16
  WHERE w.n > 1 GROUP BY r, w.tree, w.level),
rise(r, level, pos, n, proof, fold) AS (
  SELECT r, 0, tree, sub.n, proof, fold FROM walk JOIN sub USING (tree) WHERE walk.n = 1
  UNION ALL
  SELECT r, w.level + 1, any_value(w.pos) // 16, (any_value(w.n) + 15) // 16,
    any_value(w.proof) || coalesce(string_agg(top.node, '' ORDER BY top.pos) FILTER (top.pos <> w.pos), ''),
    sha256(string_agg(CASE WHEN top.pos = w.pos THEN w.fold ELSE top.node END, '' ORDER BY top.pos))
  FROM rise w JOIN top ON top.level = w.level AND top.pos // 16 = w.pos // 16
  WHERE w.n > 1 GROUP BY r, w.level),
root AS (SELECT node AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM l JOIN sub USING (tree) JOIN rise USING (r) CROSS JOIN root WHERE rise.n = 1
"""
