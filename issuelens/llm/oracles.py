"""The registered queries of this package in DuckDB SQL, where SQL can express them."""

EMBEDDING_LINKS = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a LEFT JOIN counted ON e.vec_id = counted.a
"""

LINES = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS text
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
runs AS (
  SELECT doc_id, line, text AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM lines),
ranked AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, line) AS place
  FROM runs
  WHERE b IS NOT NULL
    AND regexp_matches(a || b, '[^\x09-\x0D\x20]')),
gone AS (
  SELECT doc_id, line FROM ranked WHERE place > 1
  UNION SELECT doc_id, line + 1 FROM ranked WHERE place > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
       sha256(coalesce(string_agg(l.text, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line
GROUP BY l.doc_id
"""

TOP_K = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM whole q JOIN whole x ON x.vec_id <> q.vec_id
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
WHERE place <= 20
"""

WORD_WINDOWS = r"""
WITH words AS (
  SELECT doc_id, w.i AS i, w.word AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS list FROM documents),
       LATERAL (SELECT unnest(list) AS word, generate_subscripts(list, 1) AS i) w),
windows AS (
  SELECT doc_id, i, count(*) OVER near AS n, string_agg(word, ' ') OVER near AS sequence
  FROM words
  WINDOW near AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
repeated AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY sequence) AS first FROM windows WHERE n = 13)
  WHERE first < doc_id),
covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM repeated),
kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(c.i) AS n_removed,
         string_agg(w.word, ' ' ORDER BY w.i) FILTER (c.i IS NULL) AS text
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.i = c.i
  GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

SHINGLE_GROUPS = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM lists, LATERAL (SELECT unnest(generate_series(1, greatest(len(words) - 2, 1))) AS i) s
  WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON c.a = x.doc_id JOIN sizes y ON c.b = y.doc_id
  WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON d.doc_id = least.a LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""

RANKED_ITEMS = r"""
WITH doc_terms AS (
  SELECT d.row, d.doc_id, unnest(regexp_extract_all(
    translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents) d),
sizes AS (SELECT row, count(*) AS n FROM doc_terms GROUP BY row),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
item_terms AS (
  SELECT item, item_id, term, count(*) AS copies FROM (
    SELECT item, item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)) GROUP BY ALL),
tfs AS (
  SELECT row, doc_id, term, count(*) AS tf FROM doc_terms
  WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, totals GROUP BY term),
parts AS (
  SELECT t.row, t.doc_id, t.term,
         w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * s.n * big_n) // big_l))) AS part
  FROM tfs t JOIN sizes s ON t.row = s.row JOIN weights w ON t.term = w.term, totals),
scored AS (
  SELECT i.item, i.item_id, p.row, p.doc_id, CAST(sum(i.copies * p.part) AS BIGINT) AS score
  FROM item_terms i JOIN parts p ON i.term = p.term GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

CONVERSATIONS = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         length(regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|AS\])', '\1\2\\\3', 'g')) AS body,
         CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17
              ELSE 21 + length(regexp_replace(
                role, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|AS\])', '\1\2\\\3', 'g')) END AS marks
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + marks) AS BIGINT) AS formatted_chars
FROM numbered GROUP BY conv_id
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
words AS (SELECT row, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS c
  FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
sources AS (
  SELECT DISTINCT d.lang, d.source, coalesce(s.n, 0) AS n
  FROM docs d LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) s
    ON d.lang = s.lang AND d.source = s.source),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (s.n + v.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM sources s JOIN v ON s.lang = v.lang JOIN kept k ON k.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
  FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
