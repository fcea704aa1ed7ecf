"""DuckDB SQL for the operators' queries that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
  FROM documents),
g AS (
  SELECT normal, first(doc_id ORDER BY points DESC, doc_id) AS keep_id, count(*) AS group_size
  FROM n GROUP BY normal)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.normal) AS text_sha256
FROM n JOIN g ON n.normal = g.normal
"""

ORACLE_SQL["op3_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
      WHEN len(words) = 0 THEN []
      WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y
  WHERE 100 * common >= 80 * (cx.n + cy.n - common)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, r.component_id,
       CASE WHEN c.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY k.shingles) END AS class_id
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, sha256(string_agg(shingle, chr(10) ORDER BY shingle)) AS shingles FROM s GROUP BY doc_id) k ON k.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

ORACLE_SQL["op5_exact_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT * FROM r WHERE rank <= 10
"""

_MIX = r"""
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),
t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight,
         row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM d GROUP BY source),
u AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap FROM t),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER e, 0.0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level
  FROM u WINDOW e AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT first(level ORDER BY cap / weight, rank) AS level FROM l WHERE level * weight <= cap),
g AS (
  SELECT source, source_size, least(cap, coalesce(m.level * weight, cap)) AS target
  FROM u LEFT JOIN m ON true),
o AS (
  SELECT d.*, g.source_size, g.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
mix AS (
  SELECT doc_id, size, source_size, target,
         CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken
  FROM o)"""

ORACLE_SQL["op6_source_mix"] = f"WITH {_MIX.format(docs='documents')} SELECT * FROM mix"

ORACLE_SQL["op11_lexical_search"] = r"""
WITH term AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS pattern, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), pattern) AS words FROM documents, term),
q AS (SELECT item_id, t, count(*) AS asked FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), upper, lower), pattern)) AS t FROM benchmark, term) GROUP BY 1, 2),
s AS (SELECT count(*) AS docs, sum(len(words)) AS l FROM d WHERE len(words) > 0),
tf AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(words) AS n, unnest(words) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY t, docs),
score AS (
  SELECT item_id, row, doc_id, CAST(sum(asked * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN w USING (t), s GROUP BY 1, 2, 3),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

ORACLE_SQL["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT row, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS count FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(count), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.count, 0) AS count, CAST(1 + (1000000000 * (coalesce(c.count, 0) + 1)) // (n.n + v.v) AS BIGINT) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, CAST(1 + (1000000000 * (sum(count) + 1)) // (m.n + v.v) AS BIGINT) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY 1) m USING (lang) GROUP BY lang, term, m.n, v.v),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE count > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLE_SQL["op13_secret_scan"] = rf"""
WITH d AS (SELECT row_number() OVER () AS number, doc_id, coalesce(text, '') AS text, source, lang FROM documents),
k AS (SELECT * FROM (VALUES (0, 'assign', '{_ASSIGN}'), (1, 'access', 'AKIA[A-Z0-9]{{16,}}'), (2, 'hex', '[0-9a-f]{{24,}}'), (3, 'owned', '[A-Za-z0-9]{{20,}}')) x(kind, name, pattern)),
m AS (
  SELECT number, 0 AS kind, regexp_extract_all(text, '{_ASSIGN}') AS m, string_split_regex(text, '{_ASSIGN}') AS g FROM d
  UNION ALL SELECT number, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]{{16,}}'), string_split_regex(text, 'AKIA[A-Z0-9]{{16,}}') FROM d
  UNION ALL SELECT number, 2, regexp_extract_all(text, '[0-9a-f]{{24,}}'), string_split_regex(text, '[0-9a-f]{{24,}}') FROM d
  UNION ALL SELECT number, 3, regexp_extract_all(text, '[A-Za-z0-9]{{20,}}'), string_split_regex(text, '[A-Za-z0-9]{{20,}}') FROM d),
e AS (
  SELECT number, kind, m[i] AS found, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM m, unnest(range(1, len(m) + 1)) r(i)),
s AS (SELECT number, kind, start, start + length(found) AS stop, CASE WHEN kind = 0 THEN regexp_extract(found, '{_ASSIGN}', 2) ELSE found END AS secret FROM e),
b AS (SELECT *, len(list_distinct(string_split(secret, ''))) AS variety FROM s WHERE length(secret) >= 6),
l AS (
  SELECT *, CASE kind WHEN 0 THEN regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Za-z]') AND variety >= 6
                      WHEN 3 THEN regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]') AND len(regexp_extract_all(secret, '[0-9]+')) >= 2 AND variety >= 12
                      ELSE variety >= 6 END AS live
  FROM b),
c AS (SELECT * FROM l WHERE kind < 3 OR (live AND NOT EXISTS (SELECT 1 FROM l o WHERE o.number = l.number AND o.kind < 3 AND o.start < l.stop AND l.start < o.stop))),
o AS (SELECT secret, count(*) AS owners FROM (SELECT DISTINCT secret, source FROM c JOIN d USING (number)) GROUP BY 1),
j AS (SELECT c.*, owners > 3 AS copied, name || ':' || start || ':' || stop AS span FROM c JOIN o USING (secret) JOIN k USING (kind)),
a AS (
  SELECT number, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3 AND NOT copied) AS n_owned,
         count(*) FILTER (kind < 3 AND live AND NOT copied) AS n_live, count(*) FILTER (kind < 3 AND copied) AS n_copied,
         string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3 OR NOT copied) AS spans
  FROM j GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live,
       coalesce(n_copied, 0) AS n_copied, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (number)
"""
