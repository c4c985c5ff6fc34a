"""SQL for the operators that SQL can express; each statement reads the same tables as its query."""

from __future__ import annotations

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS x FROM starts),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT p.r, p.i, p.size, v.item_id FROM places AS p JOIN windows AS v
         ON v.size = p.size AND v.x = array_to_string(p.w[p.i : p.i + p.size - 1], ' ')),
words_hit AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) AS h GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words_hit USING (r) LEFT JOIN found USING (r)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_SPACED}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0) AS p),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes AS p ON p.doc_id = x JOIN sizes AS q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT reached.doc_id, ways.y FROM reached JOIN ways ON ways.x = reached.other)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least_id AS component_id, d.doc_id = least_id AS kept
FROM docs AS d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS least_id FROM reached GROUP BY doc_id) AS m USING (doc_id)"""

HOST_RULES = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
                     regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w,
                     list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_SPACED})) AS lines FROM documents),
windows AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs) AS p),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) AS q WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
  FROM docs LEFT JOIN covered USING (r)),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM measured GROUP BY source),
sums AS (SELECT sum(n) AS n, sum(failed) / sum(n) AS mean, sum(n * (failed / n) * (failed / n)) AS squares, count(*) AS hosts FROM hosts),
prior AS (SELECT mean, (squares - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / n AS variance FROM sums),
strengths AS (SELECT mean, CASE WHEN variance > 0 THEN greatest(mean * (1 - mean) / variance - 1, 0) END AS strength FROM prior),
rates AS (SELECT source, CASE WHEN strength IS NULL THEN mean ELSE (failed + strength * mean) / (n + strength) END AS rate FROM hosts, strengths)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept,
       round(rate, 6) AS host_rate
FROM measured AS m JOIN rates AS h ON m.source IS NOT DISTINCT FROM h.source"""

HARD_NEGATIVES = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
           FROM kept AS a, kept AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
found AS (SELECT p.anchor_id, positive_id, positive_score, s.other_id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
          FROM positives AS p JOIN scores AS s ON s.anchor_id = p.anchor_id AND NOT s.same
           AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3"""

VECTOR_DUPLICATES = """
WITH RECURSIVE rows AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM rows AS a JOIN rows AS b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.y FROM reached AS r JOIN links AS l ON l.x = r.other),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least_id AS component_id, e.vec_id = least_id AS kept
FROM embeddings AS e JOIN (SELECT vec_id, min(other) AS least_id FROM reached GROUP BY vec_id) AS m USING (vec_id)
LEFT JOIN counts ON x = e.vec_id"""

# unsigned crc32 of the decimal digits, bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns) AS c),
heads AS (SELECT c.conv_id, t.place, t.role, t.text FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.place <= c.h),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS place, role, text
  FROM (SELECT conv_id, 0 AS own, place, role, text FROM heads
        UNION ALL SELECT t.conv_id, 1, t.place, t.role, t.text FROM turns AS t JOIN convs AS c ON c.conv_id = t.conv_id AND t.place > c.h) AS u),
steps AS (SELECT conv_id, place, length(text) AS size, md5(length(role) || ':' || role || text) AS id FROM rebuilt),
prefixes AS (
  SELECT conv_id, place AS depth, size, md5(string_agg(id, ',') OVER (PARTITION BY conv_id ORDER BY place)) AS name FROM steps
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM prefixes GROUP BY conv_id),
nodes AS (SELECT depth, name, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved, max(n) = depth AS leaf,
                 sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
          FROM prefixes AS p JOIN lengths AS l ON l.conv_id = p.conv_id GROUP BY depth, name),
sums AS (SELECT a.name, a.depth, sum(n.saved) AS saved, sum(n.leaf::INT) AS leaves
         FROM nodes AS n JOIN prefixes AS a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.name, a.depth),
parents AS (SELECT n.depth, n.name, q.name AS parent FROM nodes AS n JOIN prefixes AS q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
children AS (SELECT parent, count(*) AS c FROM parents GROUP BY parent)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c, 0) AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes AS n JOIN sums AS s ON s.name = n.name AND s.depth = n.depth LEFT JOIN children AS k ON k.parent = n.name
LEFT JOIN parents AS p ON p.name = n.name AND p.depth = n.depth LEFT JOIN nodes AS u ON u.name = p.parent AND u.depth = n.depth - 1"""
