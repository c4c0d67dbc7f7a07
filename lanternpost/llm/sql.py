"""DuckDB counterparts of the queries that SQL can express."""

OP9 = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.holder AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP3 = r"""
WITH words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS key
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents))
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY key) > 1
), marked AS (
  SELECT w.doc_id, w.i, w.word,
    max(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN repeated r ON w.doc_id = r.doc_id AND w.i = r.i
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP10 = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

OP11 = r"""
WITH fit AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.id AS anchor, b.id, a.label = b.label AS same,
    list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM fit a JOIN fit b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor, id, score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id)::INT AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""

OP13 = r"""
WITH turns AS (
  SELECT conv_id AS c, turn, md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS d, length(coalesce(text, '')) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(generate_series(1, 8), lambda i: 0::UBIGINT)),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT v.c, 0 AS own, t.pos, t.d, t.n FROM convs v JOIN turns t ON t.c = v.base AND t.pos <= v.h
  UNION ALL
  SELECT v.c, 1, t.pos, t.d, t.n FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h
), lists AS (
  SELECT v.c, coalesce(list(d ORDER BY own, pos) FILTER (d IS NOT NULL), []) AS ds, coalesce(list(n ORDER BY own, pos) FILTER (d IS NOT NULL), []) AS ns
  FROM convs v LEFT JOIN rebuilt r ON r.c = v.c GROUP BY v.c
), paths AS (
  SELECT c, k AS depth, len(ds) = k AS ends, md5(array_to_string(list_slice(ds, 1, k), '')) AS key,
    CASE WHEN k > 0 THEN md5(array_to_string(list_slice(ds, 1, k - 1), '')) END AS parent, CASE WHEN k > 0 THEN ns[k] ELSE 0 END AS n
  FROM (SELECT *, unnest(generate_series(0, len(ds))) AS k FROM lists)
), nodes AS (
  SELECT key, depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY key, depth
), kids AS (SELECT parent, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(kids, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.parent = n.key),
sums AS (
  SELECT p.key, p.depth, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.n)::BIGINT AS saved_tokens
  FROM full_nodes u JOIN paths p ON p.c = u.conv_id AND p.depth <= u.depth GROUP BY p.key, p.depth
)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM full_nodes v JOIN sums s ON s.key = v.key AND s.depth = v.depth LEFT JOIN nodes u ON u.key = v.parent AND u.depth = v.depth - 1
"""
