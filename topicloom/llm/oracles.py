"""DuckDB SQL for the queries whose results SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: The least node reachable over links (a, b) in both directions.
CLOSURE = """reach(node, other) AS (
  SELECT a, b FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
component AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams FROM d),
g AS MATERIALIZED (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id
        GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{CLOSURE}
SELECT doc_id, len(grams) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  doc_id = coalesce(component_id, doc_id) AS kept
FROM s LEFT JOIN component ON node = doc_id"""

REPEATS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i,
        unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram FROM d WHERE len(w) >= 13),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < doc_id),
r AS (SELECT doc_id, list(DISTINCT place) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS place FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, j: NOT list_contains(coalesce(gone, []), j)), ' ')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""

VECTOR_LINKS = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
both_ways AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND len(p.x) = len(q.x)
  AND p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.93),
counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a),
{CLOSURE}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN component ON node = vec_id"""

_RUNS = r"list_filter(string_split_regex({text}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

CONTAMINATED = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_RUNS.format(text=_LOWERED)} AS w FROM documents),
b AS (SELECT item_id, {_RUNS.format(text=_LOWERED)} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT item_id, size,
  unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS gram FROM sized),
runs AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i,
  unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS gram
  FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
hits AS MATERIALIZED (SELECT doc_id, i, size, item_id FROM runs JOIN windows USING (size, gram)),
places AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

COLLOCATIONS = f"""
WITH d AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
totals AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, gram, count(*) AS a FROM (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])) AS gram FROM p, range(1, 6) t(size) WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.gram, c.a, totals.n, k, x.a AS l, y.a AS r, (1000::HUGEINT * c.a * totals.n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c JOIN totals USING (lang)
  JOIN f x ON x.lang = c.lang AND x.gram = c.gram[1:k] JOIN f y ON y.lang = c.lang AND y.gram = c.gram[k + 1:]),
best AS (SELECT lang, gram, a, n, min(struct_pack(score := score, k := k, l := l, r := r)) AS b FROM cuts GROUP BY lang, gram, a, n),
inside AS (SELECT lang, gram[1:size - 1] AS gram, a FROM f UNION SELECT lang, gram[2:] AS gram, a FROM f),
kept AS (SELECT best.* FROM best ANTI JOIN inside USING (lang, gram, a)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, encode(array_to_string(gram, ' '))) AS rank,
  array_to_string(gram, ' ') AS phrase, a, b.l AS l, b.r AS r, n::BIGINT AS n, b.score::BIGINT AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000"""

#: CRC-32 bit by bit: every byte comes in with the first of its eight steps.
_CRC32 = """xor(4294967295, list_reduce(flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda s, x: xor(xor(s, x) >> 1, (xor(s, x) & 1) * 3988292384), 4294967295::BIGINT))"""

PREFIX_TRIE = f"""
WITH own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, w, {_CRC32.format(text="c::VARCHAR")} % 6 AS h FROM own),
r AS MATERIALIZED (SELECT h.c, list_concat(coalesce(base.w, [])[1:h], h.w[h + 1:]) AS w FROM h LEFT JOIN own base ON base.c = h.c - h.c % 100),
p AS (SELECT c, depth, w[1:depth] AS path, len(w) = depth AS ends, CASE WHEN depth = 0 THEN 0 ELSE length(w[depth].text) END AS size
  FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS depth FROM r)),
n AS MATERIALIZED (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
  sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM p GROUP BY depth, path),
k AS MATERIALIZED (SELECT n.*, up.conv_id AS parent_conv_id, coalesce(kids, 0) AS n_children FROM n
  LEFT JOIN n up ON up.depth = n.depth - 1 AND up.path = n.path[1:n.depth - 1] AND n.depth > 0
  LEFT JOIN (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS kids FROM n WHERE depth > 0 GROUP BY ALL) x
    ON x.depth = n.depth AND x.path = n.path),
t AS (SELECT unnest(range(0, depth + 1)) AS level, path, n_children, n_convs, size FROM k),
s AS (SELECT level AS depth, path[1:level] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM t GROUP BY ALL)
SELECT conv_id, k.depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM k JOIN s ON s.depth = k.depth AND s.path = k.path"""
