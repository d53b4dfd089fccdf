"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {}

ORACLE["op6_cuckoo_line_dedup"] = r"""
WITH lines AS (
  SELECT doc, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM (SELECT *, row_number() OVER () AS doc FROM documents)),
keyed AS (
  SELECT doc, doc_id, line_no, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (
  SELECT key, count(DISTINCT doc) AS n, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key),
marked AS (
  SELECT k.doc, k.doc_id, k.line_no, k.line, coalesce(h.n >= 3 AND k.doc_id < h.top, false) AS gone
  FROM keyed k LEFT JOIN held h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc, doc_id
"""

ORACLE["op7_source_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS w
  FROM docs GROUP BY source),
run AS (
  SELECT *, 2 * source_size AS stop, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w,
         coalesce(sum(2 * source_size) OVER before, 0) AS stopped, coalesce(sum(w) OVER before, 0) AS stopped_w
  FROM src WINDOW before AS (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT *, (total - stopped::DOUBLE) / (all_w - stopped_w)::DOUBLE AS level FROM run),
cap AS (SELECT *, stop::DOUBLE / w <= level AS capped FROM lev),
tgt AS (
  SELECT source, source_size,
         CASE WHEN capped THEN stop::DOUBLE ELSE w * max(CASE WHEN NOT capped THEN level END) OVER () END AS target FROM cap)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(d.size * (floor(t.target / t.source_size)
            + CASE WHEN CAST('0x' || substr(md5(concat_ws(':', 7, d.doc_id)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE
                        < t.target / t.source_size - floor(t.target / t.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM docs d JOIN tgt t ON t.source IS NOT DISTINCT FROM d.source
"""

ORACLE["op1_winnowing_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bspan AS (
  SELECT item_id, least(10, len(w)) AS n,
         unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS span
  FROM bw WHERE len(w) > 0),
dspan AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS first_at,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS span
  FROM dw, (SELECT DISTINCT n FROM bspan) WHERE len(w) >= n),
hit AS (SELECT d.doc_id, d.n, d.first_at, b.item_id FROM dspan d JOIN bspan b ON b.n = d.n AND b.span = d.span),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(first_at, first_at + n)) AS pos FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

ORACLE["op2_arc_to_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN size >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id < top THEN top END AS refers_to
FROM p
"""

ORACLE["op3_quotation_linking"] = r"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, min(text) AS q FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2),
mail AS (
  SELECT row_number() OVER () AS id, c.conv_id, c.turn, c.role,
         concat_ws(chr(10), array_to_string(list_transform(string_split(b.q, chr(10)), lambda x: '>> ' || x), chr(10)),
                   array_to_string(list_transform(string_split(a.q, chr(10)), lambda x: '> ' || x), chr(10)), c.text) AS text
  FROM conversations c
  LEFT JOIN turns a ON a.conv_id = c.conv_id AND a.turn + 1 = c.turn
  LEFT JOIN turns b ON b.conv_id = c.conv_id AND b.turn + 2 = c.turn),
lines AS (
  SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM mail),
leveled AS (
  SELECT *, regexp_extract(raw, '^([ \t]*>)*[ \t]*') AS marks FROM lines),
said AS (
  SELECT id, conv_id, turn, line_no, raw, len(marks) - len(replace(marks, '>', '')) AS level,
         lower(trim(regexp_replace(substr(raw, len(marks) + 1), '\s+', ' ', 'g'))) AS said FROM leveled),
runs AS (
  SELECT *, line_no - row_number() OVER (PARTITION BY id, level ORDER BY line_no) AS run FROM said),
own AS (
  SELECT id, conv_id, turn, chr(30) || string_agg(said, chr(30) ORDER BY line_no) || chr(30) AS words
  FROM said WHERE level = 0 AND said <> '' GROUP BY 1, 2, 3),
quoted AS (
  SELECT id, conv_id, turn, level, chr(30) || string_agg(said, chr(30) ORDER BY line_no) || chr(30) AS words
  FROM runs WHERE level > 0 AND said <> '' GROUP BY id, conv_id, turn, level, run),
passages AS (
  SELECT q.id, q.level, (SELECT min(o.turn) FROM own o WHERE o.conv_id = q.conv_id AND o.turn < q.turn
                         AND contains(o.words, q.words)) AS original FROM quoted q),
each AS (
  SELECT id, count(*) AS n_passages, count(original) AS n_linked,
         max(original) FILTER (level = 1) AS reply_to FROM passages GROUP BY 1),
up AS (
  SELECT m.conv_id, m.turn, max(e.reply_to) AS reply_to FROM mail m JOIN each e USING (id)
  WHERE e.reply_to IS NOT NULL GROUP BY 1, 2),
chain AS (
  SELECT m.id, m.conv_id, e.reply_to AS thread, 1 AS depth FROM mail m JOIN each e USING (id) WHERE e.reply_to IS NOT NULL
  UNION ALL
  SELECT c.id, c.conv_id, u.reply_to, c.depth + 1 FROM chain c JOIN up u ON u.conv_id = c.conv_id AND u.turn = c.thread),
ends AS (SELECT id, min(thread) AS thread, max(depth) AS depth FROM chain GROUP BY 1),
bodies AS (
  SELECT id, max(level) AS max_level,
         trim(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (level = 0), ''), chr(10)) AS body FROM said GROUP BY 1)
SELECT m.conv_id, m.turn, m.role, b.body, CAST(b.max_level AS INTEGER) AS max_level,
       CAST(coalesce(e.n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(e.n_linked, 0) AS BIGINT) AS n_linked, e.reply_to,
       coalesce(t.thread, m.turn) AS thread, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth
FROM mail m JOIN bodies b USING (id) LEFT JOIN each e USING (id) LEFT JOIN ends t USING (id)
"""

ORACLE["op13_slot_hard_negatives"] = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 10
"""

ORACLE["op11_shared_term_search"] = r"""
WITH dw AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
corpus AS (SELECT count(*) AS docs, sum(len(w)) AS words FROM dw WHERE len(w) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM dw)
  WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), corpus),
impact AS (
  SELECT tf.d, tf.term,
         weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(dw.w) * docs) // CAST(words AS BIGINT)))) AS x
  FROM tf JOIN weights USING (term) JOIN dw USING (d), corpus),
scored AS (SELECT item_id, d, CAST(sum(x) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
       doc_id, score
FROM scored JOIN dw USING (d) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 50
"""
