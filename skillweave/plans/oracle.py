"""Oracle SQL (DuckDB dialect) for every registered query.

The same bindings and semantics as the Spark operators, written as plain
SQL over the driver's views. Where the Spark side uses a scalable strategy
(sweep windows instead of range joins, numpy blocks instead of pair rows),
the SQL states the definition directly (EXISTS, all-pairs ranking), which is
what makes it a useful check. Fragments are named CTEs; each query pulls in
only the fragments it depends on.
"""

from __future__ import annotations

from skillweave.config import ESCO_SKILL_NS, TRAILING_PUNCT
from skillweave.plans import bindings as B

MARKER_RE = "(?i)(" + "|".join(B.TEST_MARKERS) + ")"
PUNCT = TRAILING_PUNCT
CONCEPT_NS = ESCO_SKILL_NS + "bench/"


def _tile(src: str, key: str, text: str, pattern: str) -> str:
    """Pieces + running offsets of a tiling regex (1-based pos_)."""
    return f"""
  SELECT posting_id, pos_, piece,
         CAST(sum(length(piece)) OVER (PARTITION BY posting_id ORDER BY pos_
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS char_end,
         CAST(sum(CASE WHEN regexp_matches(piece, '^\\s') THEN 0 ELSE 1 END) OVER (PARTITION BY posting_id
              ORDER BY pos_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - 1 AS k,
         sum(CASE WHEN regexp_matches(piece, '[.!?\\n]') THEN 1 ELSE 0 END) OVER (PARTITION BY posting_id
              ORDER BY pos_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent
  FROM (SELECT posting_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos_
        FROM (SELECT {key} AS posting_id, regexp_extract_all({text}, '{pattern}') AS p FROM {src}))"""


def _words(src: str, key: str, text: str) -> str:
    return f"""
  SELECT posting_id, k AS w, piece AS word, char_end - length(piece) AS char_start, char_end
  FROM ({_tile(src, key, text, r'\S+|\s+')}) WHERE NOT regexp_matches(piece, '^\\s')"""


def _grams(words: str, sizes: list[int]) -> str:
    """Word n-grams of normalised words via lead(); one row per (start word, n)."""
    m = max(sizes)
    leads = ", ".join(f"lead(norm, {j}) OVER (PARTITION BY posting_id ORDER BY w) AS l{j}" for j in range(1, m))
    parts = []
    for n in sizes:
        key = " || ' ' || ".join(["norm"] + [f"l{j}" for j in range(1, n)])
        parts.append(f"SELECT posting_id, w, {n} AS n, {key} AS key FROM lw")
    union = " UNION ALL ".join(parts)
    return f"""
  SELECT * FROM (WITH lw AS (SELECT posting_id, w, norm{', ' + leads if leads else ''}
                             FROM (SELECT posting_id, w, lower(rtrim(word, '{PUNCT}')) AS norm FROM {words}))
                 {union}) WHERE key IS NOT NULL"""


FRAGMENTS: dict[str, tuple[str, list[str]]] = {}


def frag(name: str, sql: str, deps: list[str]):
    FRAGMENTS[name] = (sql, deps)


frag("postings", """
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN doc_id % 61 <> 11 THEN 'https://example.com/doc/'
           || CAST(CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) END AS source_uri,
         '2024-01-01' AS crawl_date, source AS platform,
         CASE WHEN doc_id % 53 <> 7 THEN concat_ws(' ', source, upper(lang)) END AS employer,
         CASE WHEN doc_id % 59 <> 5 THEN '2024-01-01' END AS posting_date,
         CASE WHEN doc_id % 47 <> 3 THEN list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1] END AS title,
         text AS raw_text,
         CAST(CASE WHEN doc_id % 11 = 10 THEN NULL ELSE doc_id % 11 END AS INTEGER) AS isco_group
  FROM documents""", [])

frag("tok_tagged", f"""
  SELECT posting_id, k AS i, sent, piece AS text, char_end - length(piece) AS char_start, char_end,
         CASE WHEN NOT regexp_matches(piece, '^[\\p{{L}}\\p{{N}}]') THEN 'PUNCT'
              WHEN regexp_matches(piece, '^\\p{{N}}+$') THEN 'NUM'
              WHEN regexp_matches(lower(piece), '(ung|heit|keit|schaft|tion)(en)?$') THEN 'NOUN'
              WHEN regexp_matches(lower(piece), '(lich|isch|ig|bar|sam)(e|er|en|es|em)?$') THEN 'ADJ'
              ELSE 'X' END AS pos
  FROM ({_tile('postings', 'id', 'raw_text', r'[\p{L}\p{N}]+|[^\p{L}\p{N}\s]|\s+')})
  WHERE NOT regexp_matches(piece, '^\\s')""", ["postings"])

frag("tokens", """
  SELECT posting_id, i, text, pos,
         CASE WHEN pos = 'ADJ' THEN regexp_replace(lower(text), '(lich|isch|ig|bar|sam)(e|er|en|es|em)$', '\\1')
              WHEN pos = 'NOUN' THEN regexp_replace(lower(text), '(ung|heit|keit|schaft|tion)en$', '\\1')
              WHEN pos IN ('PUNCT', 'NUM') THEN text ELSE lower(text) END AS lemma,
         CASE WHEN pos = 'ADJ' AND na IS NOT NULL THEN 'nk' ELSE 'ROOT' END AS dep,
         CAST(CASE WHEN pos = 'ADJ' AND na IS NOT NULL THEN na ELSE i END AS BIGINT) AS head_i,
         char_start, char_end
  FROM (SELECT *, min(CASE WHEN pos = 'NOUN' THEN i END) OVER (PARTITION BY posting_id, sent ORDER BY i
                      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS na FROM tok_tagged)""", ["tok_tagged"])

frag("sentences", f"""
  SELECT posting_id, CAST(pos_ - 1 AS BIGINT) AS sent_ord, char_end - length(piece) AS char_start, char_end,
         piece AS text
  FROM ({_tile('postings', 'id', 'raw_text', r'[^.!?\n]*[.!?\n]+|[^.!?\n]+')})""", ["postings"])

frag("rspans", """
  SELECT a.posting_id || '-adjn-' || CAST(row_number() OVER (PARTITION BY a.posting_id ORDER BY a.i) AS VARCHAR) AS id,
         a.posting_id, substr(p.raw_text, CAST(a.char_start + 1 AS BIGINT), CAST(h.char_end - a.char_start AS BIGINT)) AS text,
         'skill' AS span_type, a.char_start, h.char_end, 'adj_noun' AS extractor, CAST(NULL AS DOUBLE) AS score,
         0 AS extractor_ord, 0 AS kind_ord
  FROM tokens a JOIN tokens h ON a.posting_id = h.posting_id AND a.head_i = h.i
       JOIN postings p ON p.id = a.posting_id
  WHERE a.pos = 'ADJ' AND a.dep IN ('nk', 'amod') AND h.pos IN ('NOUN', 'PROPN') AND a.i <= h.i""",
     ["tokens", "postings"])

frag("bwords", _words("benchmark", "CAST(item_id AS VARCHAR)", "text"), [])

frag("dictionary", " UNION ALL ".join(
    f"""SELECT '{m}' AS model, CAST({B.TAGGER_SIZES[m]} AS INTEGER) AS n, key,
               1.0 / count(DISTINCT posting_id) AS weight
        FROM ({_grams('bwords', [B.TAGGER_SIZES[m]])}) GROUP BY key""" for m in B.TAGGER_MODELS), ["bwords"])

frag("dwords", _words("postings", "id", "raw_text"), ["postings"])

frag("dgrams", _grams("dwords", sorted(set(B.TAGGER_SIZES.values()))), ["dwords"])

frag("raw_hits", """
  SELECT o.posting_id, o.model, dw.w AS hit_ord, max(dw.word) AS word, max(dw.char_start) AS start,
         max(dw.char_end) AS "end", max(o.weight) AS score
  FROM (SELECT g.posting_id, d.model, g.w AS w0, g.n, d.weight
        FROM dgrams g JOIN dictionary d ON g.n = d.n AND g.key = d.key) o
  JOIN dwords dw ON dw.posting_id = o.posting_id AND dw.w BETWEEN o.w0 AND o.w0 + o.n - 1
  GROUP BY o.posting_id, o.model, dw.w""", ["dgrams", "dictionary", "dwords"])

frag("hits", f"""
  SELECT posting_id, model, hit_ord, rtrim(word, '{PUNCT}') AS word, start,
         "end" - (length(word) - length(rtrim(word, '{PUNCT}'))) AS "end", score
  FROM raw_hits WHERE rtrim(word, '{PUNCT}') <> ''""", ["raw_hits"])

frag("merged", """
  SELECT posting_id, model, string_agg(word, ' ' ORDER BY start, hit_ord) AS word, min(start) AS start,
         list("end" ORDER BY start, hit_ord)[-1] AS "end",
         list_reduce(list(score ORDER BY start, hit_ord), lambda a, b: (a + b) / 2) AS score,
         CAST(count(*) AS INTEGER) AS n_hits
  FROM (SELECT *, sum(CASE WHEN prev_end IS NULL OR start - prev_end > 1 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY posting_id, model ORDER BY start, hit_ord
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
        FROM (SELECT *, lag("end") OVER (PARTITION BY posting_id, model ORDER BY start, hit_ord) AS prev_end
              FROM hits))
  GROUP BY posting_id, model, island""", ["hits"])

frag("tspans", """
  SELECT posting_id || '-esco-' || CAST(row_number() OVER (PARTITION BY posting_id ORDER BY kind_ord, start, "end") AS VARCHAR) AS id,
         posting_id, word AS text, model AS span_type, start AS char_start, "end" AS char_end,
         'tagger' AS extractor, CAST(score AS DOUBLE) AS score, 1 AS extractor_ord, kind_ord
  FROM (SELECT *, CASE model WHEN 'skill' THEN 0 ELSE 1 END AS kind_ord FROM merged)""", ["merged"])

frag("spans", f"""
  SELECT s.*, CAST(row_number() OVER (PARTITION BY posting_id ORDER BY extractor_ord, kind_ord, char_start, char_end, id) AS BIGINT) AS span_ord,
         CASE WHEN EXISTS (SELECT 1 FROM sentences se WHERE se.posting_id = s.posting_id
                           AND se.char_start <= s.char_start AND s.char_start < se.char_end
                           AND regexp_matches(se.text, '{MARKER_RE}')) THEN 'nice_to_have' ELSE 'must' END AS requirement_kind
  FROM (SELECT * FROM rspans UNION ALL SELECT * FROM tspans) s""", ["rspans", "tspans", "sentences"])


# sentences of another model: lines
frag("line_sentences", f"""
  SELECT posting_id, CAST(pos_ - 1 AS BIGINT) AS sent_ord, char_end - length(piece) AS char_start, char_end,
         piece AS text
  FROM ({_tile('postings', 'id', 'raw_text', r'[^\n]*\n+|[^\n]+')})""", ["postings"])
frag("spans_read", FRAGMENTS["spans"][0].replace("FROM sentences se", "FROM line_sentences se"),
     ["rspans", "tspans", "line_sentences"])

# a tagger by ending: words at most NEAR from one that ends like a noun
frag("noun_hits", f"""
  SELECT posting_id, 'skill' AS model, w AS hit_ord, rtrim(word, '{PUNCT}') AS word, char_start AS start,
         char_end - (length(word) - length(rtrim(word, '{PUNCT}'))) AS "end", 1.0::DOUBLE / (1 + away) AS score
  FROM (SELECT *, least(w - max(CASE WHEN noun THEN w END) OVER (PARTITION BY posting_id ORDER BY w
                                  ROWS BETWEEN {B.NEAR} PRECEDING AND CURRENT ROW),
                        min(CASE WHEN noun THEN w END) OVER (PARTITION BY posting_id ORDER BY w
                                  ROWS BETWEEN CURRENT ROW AND {B.NEAR} FOLLOWING) - w) AS away
        FROM (SELECT *, regexp_matches(lower(rtrim(word, '{PUNCT}')), '(tion|ung)$') AS noun FROM dwords))
  WHERE away IS NOT NULL AND rtrim(word, '{PUNCT}') <> ''""", ["dwords"])


def build(deps: list[str], select: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in FRAGMENTS[n][1]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    ctes = ",\n".join(f"{n} AS ({FRAGMENTS[n][0]})" for n in order)
    return f"WITH {ctes}\n{select}"


SPAN_COLS = "id, posting_id, text, span_type, char_start, char_end, extractor, score"

ORACLE: dict[str, str] = {
    "postings": build(["postings"], "SELECT * FROM postings"),
    "tokens": build(["tokens"], "SELECT * FROM tokens"),
    "marker_sentences": build(["sentences"],
                              f"SELECT *, regexp_matches(text, '{MARKER_RE}') AS is_marked FROM sentences"),
    "adj_noun_spans": build(["rspans"], f"SELECT {SPAN_COLS} FROM rspans"),
    "tagger_raw_hits": build(["raw_hits"], "SELECT * FROM raw_hits"),
    "tagger_hits": build(["hits"], "SELECT * FROM hits"),
    "tagger_spans": build(["tspans"], f"SELECT {SPAN_COLS} FROM tspans"),
    "spans": build(["spans"], f"SELECT {SPAN_COLS}, span_ord, requirement_kind FROM spans"),
    "spans_by_reader": build(["spans_read"], f"SELECT {SPAN_COLS}, span_ord, requirement_kind FROM spans_read"),
    "tagger_windowed_hits": build(["noun_hits"], "SELECT * FROM noun_hits"),
    "span_counts": build(["spans", "postings"], """
        SELECT p.id AS posting_id,
               CAST(count(s.id) FILTER (WHERE s.extractor = 'adj_noun') AS BIGINT) AS n_adj_noun,
               CAST(count(s.id) FILTER (WHERE s.extractor = 'tagger') AS BIGINT) AS n_tagger
        FROM postings p LEFT JOIN spans s ON s.posting_id = p.id GROUP BY p.id"""),
    "drafts": build(["spans", "postings"], """
        SELECT 'draft-' || p.id AS id, p.id AS posting_id, CAST(count(s.id) AS BIGINT) AS n_spans,
               coalesce(string_agg(s.id, '|' ORDER BY s.span_ord), '') AS span_ids, p.title AS title
        FROM postings p LEFT JOIN spans s ON s.posting_id = p.id GROUP BY p.id, p.title"""),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def _trigrams(src: str, key: str, text: str) -> str:
    return f"""
  SELECT key, gram, tf, sqrt(CAST(sum(tf * tf) OVER (PARTITION BY key) AS DOUBLE)) AS norm
  FROM (SELECT key, gram, CAST(count(*) AS BIGINT) AS tf
        FROM (SELECT key, substr(p, k, 3) AS gram
              FROM (SELECT key, p, unnest(range(1, length(p) - 1)) AS k
                    FROM (SELECT {key} AS key, ' ' || lower({text}) || ' ' AS p FROM {src})
                    WHERE length(p) >= 3))
        GROUP BY key, gram)"""


frag("qtexts", "SELECT DISTINCT text FROM spans", ["spans"])
frag("qfeat", _trigrams("qtexts", "text", "text"), ["qtexts"])
frag("cfeat", _trigrams("benchmark", "item_id", "text"), [])
frag("smatch", f"""
  SELECT key AS text, CAST(rank AS INTEGER) AS rank, ord AS concept_ord, score,
         CASE WHEN rank = 1 AND score >= {B.SPARSE_THRESHOLD} THEN 'accepted' ELSE 'rejected' END AS decision
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord ASC) AS rank
        FROM (SELECT t.text AS key, b.item_id AS ord, coalesce(d.score, 0.0) AS score
              FROM qtexts t CROSS JOIN benchmark b
              LEFT JOIN (SELECT q.key, c.key AS ord, sum(q.tf * c.tf) / (max(q.norm) * max(c.norm)) AS score
                         FROM qfeat q JOIN cfeat c ON q.gram = c.gram GROUP BY q.key, c.key) d
                ON d.key = t.text AND d.ord = b.item_id))
  WHERE rank <= {3}""", ["qtexts", "qfeat", "cfeat"])
frag("mappings", f"""
  SELECT 'mapping-' || substr(sha256(s.id || chr(1) || CAST(m.rank AS VARCHAR)), 1, 32) AS id,
         s.id AS span_id, s.posting_id, '{CONCEPT_NS}' || CAST(m.concept_ord AS VARCHAR) AS concept_uri,
         m.score, m.decision, m.rank
  FROM spans s JOIN smatch m ON s.text = m.text""", ["spans", "smatch"])
frag("accepted", """
  SELECT s.*, m.concept_uri, m.score AS mapping_score
  FROM spans s JOIN mappings m ON m.span_id = s.id WHERE m.decision = 'accepted'""", ["spans", "mappings"])


def _fold(src: str) -> str:
    """Ordered consolidation fold per (posting, concept) over ``src``.

    src: posting_id, concept_uri, o (order), span_id, score, kind.
    """
    return f"""
  SELECT posting_id, concept_uri, first_ord, w.span_id AS span_id, w.score AS score, w.kind AS kind,
         CAST(row_number() OVER (PARTITION BY posting_id ORDER BY first_ord) AS BIGINT) AS req_ord
  FROM (SELECT posting_id, concept_uri, min(o) AS first_ord,
               list_reduce(list({{'o': o, 'span_id': span_id, 'score': CAST(score AS DOUBLE), 'kind': kind}} ORDER BY o),
                           lambda c, x: CASE WHEN x.score > c.score OR (c.kind = 'nice_to_have' AND x.kind = 'must')
                                             THEN x ELSE c END) AS w
        FROM {src} GROUP BY posting_id, concept_uri)"""


LEVEL_CASE = ("CASE isco_group " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in
                                            sorted(__import__('skillweave.config', fromlist=['x']).ISCO_MAJOR_GROUP_LEVEL.items()))
              + " ELSE 'DQR4' END")
frag("reqs", f"""
  SELECT 'req-' || substr(sha256(f.posting_id || chr(1) || f.concept_uri), 1, 32) AS id,
         f.posting_id, f.req_ord, f.concept_uri AS refers_to_competence,
         {LEVEL_CASE} AS required_level,
         (isco_group IS NULL OR isco_group NOT BETWEEN 1 AND 9) AS level_is_fallback,
         f.kind AS requirement_kind, f.score AS provenance_confidence, f.span_id
  FROM ({_fold("(SELECT posting_id, concept_uri, span_ord AS o, id AS span_id, mapping_score AS score, requirement_kind AS kind FROM accepted)")}) f
  JOIN postings p ON p.id = f.posting_id""", ["accepted", "postings"])

ORACLE.update({
    "sparse_matches": build(["smatch"], "SELECT text, rank, concept_ord, round(score, 4) AS score, decision FROM smatch"),
    "mappings": build(["mappings"], "SELECT id, span_id, posting_id, concept_uri, round(score, 4) AS score, decision, rank FROM mappings"),
    "accepted_spans": build(["accepted"], """SELECT id, posting_id, span_ord, requirement_kind, concept_uri,
                                                    round(mapping_score, 4) AS mapping_score FROM accepted"""),
    "requirements": build(["reqs"], """SELECT id, posting_id, req_ord, refers_to_competence, required_level,
        level_is_fallback, requirement_kind, round(provenance_confidence, 4) AS provenance_confidence, span_id FROM reqs"""),
})


frag("dvec", """
  SELECT 'plain' AS model_id, vec_id AS key, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
  UNION ALL
  SELECT 'squared', vec_id, list_transform(h, lambda x: x / sqrt(list_reduce(list_transform(h, lambda y: y * y), lambda a, b: a + b)))
  FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * abs(x)) AS h FROM embeddings)""", [])
frag("dmatch", """
  SELECT model_id, key, ord, score, rank FROM (
    SELECT q.model_id, q.key, i.key AS ord, list_dot_product(q.vec, i.vec) AS score,
           row_number() OVER (PARTITION BY q.model_id, q.key ORDER BY list_dot_product(q.vec, i.vec) DESC, i.key) AS rank
    FROM dvec q JOIN dvec i ON q.model_id = i.model_id AND q.key <> i.key)
  WHERE rank <= 3""", ["dvec"])

ORACLE.update({
    "dense_matches": build(["dmatch"], f"""
        SELECT model_id, key AS query_id, CAST(rank AS INTEGER) AS rank, ord AS concept_id, round(score, 4) AS score,
               CASE WHEN rank = 1 AND score >= {B.DENSE_THRESHOLD} THEN 'accepted' ELSE 'rejected' END AS decision
        FROM dmatch"""),
    "encoder_comparison": build(["dmatch"], """
        SELECT model_id, query_id, top1_concept, round(top1_score, 4) AS top1_score, round(margin, 4) AS margin FROM (
          SELECT model_id, key AS query_id, ord AS top1_concept, score AS top1_score,
                 score - lead(score) OVER (PARTITION BY model_id, key ORDER BY rank) AS margin, rank
          FROM dmatch) WHERE rank = 1"""),
    "dense_requirements": build(["dmatch"], f"""
        SELECT posting_id, req_ord, concept_uri AS refers_to_competence, kind AS requirement_kind,
               round(score, 4) AS provenance_confidence, span_id
        FROM ({_fold(f'''(SELECT CAST(key // 50 AS VARCHAR) AS posting_id, CAST(ord % 7 AS VARCHAR) AS concept_uri,
                                 key AS o, CAST(key AS VARCHAR) AS span_id, score,
                                 CASE WHEN (key // 5) % 2 = 0 THEN 'must' ELSE 'nice_to_have' END AS kind
                          FROM dmatch WHERE model_id = 'plain' AND rank = 1 AND score >= {B.DENSE_FOLD_THRESHOLD})''')})"""),
})


def _slug(x: str) -> str:
    return (f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), "
            f"'{__import__('skillweave.config', fromlist=['x']).SLUG_FALLBACK}')")


frag("page_postings", r"""
  SELECT 'page-' || CAST(page_id AS VARCHAR) AS id, url AS source_uri, '2024-01-01' AS crawl_date,
         regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS platform,
         regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS employer, '2024-01-01' AS posting_date,
         nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, html AS raw_text,
         CAST(NULL AS VARCHAR) AS isco_group
  FROM pages""", [])



def _faults(src: str) -> str:
    """Raw adverts of ``src`` with the faults of the binding."""
    return f"""
  SELECT CASE WHEN m = 1 THEN NULL WHEN m IN (2, 3) THEN 'twin-' || CAST(num // 29 AS VARCHAR) ELSE id END AS id, source_uri,
         CASE WHEN m = 4 THEN '01.01.2024' ELSE crawl_date END AS crawl_date, CASE WHEN m = 5 THEN NULL ELSE platform END AS platform,
         employer, CASE WHEN m = 6 THEN '2024-02-30' ELSE posting_date END AS posting_date,
         CASE WHEN m = 7 THEN NULL ELSE title END AS title, raw_text,
         CASE WHEN m = 8 THEN 'drei' ELSE CAST(isco_group AS VARCHAR) END AS isco_group, m
  FROM (SELECT *, num % 29 AS m FROM (SELECT *, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS num FROM {src}))"""


frag("raw_pages", _faults("page_postings"), ["page_postings"])
frag("raw_postings", f"""
  SELECT CASE WHEN cut THEN NULL ELSE id END AS id, CASE WHEN cut THEN NULL ELSE source_uri END AS source_uri,
         CASE WHEN cut THEN NULL ELSE crawl_date END AS crawl_date, CASE WHEN cut THEN NULL ELSE platform END AS platform,
         CASE WHEN cut THEN NULL ELSE employer END AS employer, CASE WHEN cut THEN NULL ELSE posting_date END AS posting_date,
         CASE WHEN cut OR k IN (9, 10, 16) THEN NULL ELSE title END AS title,
         CASE WHEN cut OR k = 17 THEN NULL ELSE raw_text END AS raw_text,
         CASE WHEN cut THEN NULL WHEN k = 11 THEN '3' WHEN k = 12 THEN '3.5' WHEN k = 13 THEN 'true' ELSE isco_group END AS isco_group,
         CASE WHEN k IN (9, 10) THEN 'title' WHEN k = 17 THEN 'raw_text' WHEN k = 14 THEN 'json' WHEN k = 15 THEN 'record' END AS wrong,
         CASE WHEN k = 14 THEN substr('{{"id":"' || id || '","source_uri":' || coalesce('"' || source_uri || '"', 'null') || ',"crawl_date":"2024-01-01"', 1, 40)
              WHEN k = 15 THEN '"' || id || '"' END AS record
  FROM (SELECT *, m AS k, m IN (14, 15) AS cut FROM ({_faults("postings")}))""", ["postings"])

frag("overlap", """
  SELECT s.posting_id, s.id, s.extractor, s.char_start, s.char_end, s.text, s.span_type,
         EXISTS (SELECT 1 FROM spans o WHERE o.posting_id = s.posting_id AND o.extractor <> s.extractor
                 AND s.char_start < o.char_end AND o.char_start < s.char_end) AS overlaps
  FROM spans s""", ["spans"])

_REQ = ["id", "source_uri", "crawl_date", "platform", "employer", "posting_date", "title", "raw_text"]
_isco = "CASE WHEN isco_group IS NOT NULL AND coalesce(try_cast(isco_group AS DOUBLE) % 1, 1) <> 0 THEN 'bad_type:isco_group' END"
# posting_checks also finds the integers that isco_group, 32 bits, cannot hold, as the code does
_isco_int = ("CASE WHEN isco_group IS NOT NULL AND (coalesce(try_cast(isco_group AS DOUBLE) % 1, 1) <> 0 "
             "OR try_cast(isco_group AS INTEGER) IS NULL) THEN 'bad_type:isco_group' END")
_checks = ", ".join([f"CASE WHEN {c} IS NULL THEN 'missing:{c}' END" for c in _REQ] + [_isco_int])
_json_checks = ", ".join(
    ["CASE WHEN wrong = 'json' THEN 'bad_json' WHEN wrong = 'record' THEN 'bad_type:record' END"]
    + [f"CASE WHEN wrong = '{c}' THEN 'bad_type:{c}' WHEN coalesce(wrong, '') NOT IN ('json', 'record') AND {c} IS NULL "
       f"THEN 'missing:{c}' END" for c in _REQ] + [_isco])
_odd = ", ".join(f"CASE WHEN {c} IS NOT NULL AND try_strptime({c}, '%Y-%m-%d') IS NULL THEN 'bad_date:{c}' END"
                 for c in ("crawl_date", "posting_date"))
_PROFILES = __import__('skillweave.config', fromlist=['x']).ENCODER_PROFILES
_ENC_VALUES = ", ".join(f"('{m}', '{mode}', '{p.get(mode + '_prefix', '')}')" for m, p in _PROFILES.items()
                        for mode in ("query", "passage"))
_UUID = ("substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || substr('89ab89ab89ab89ab', "
         "instr('0123456789abcdef', substr({h}, 17, 1)), 1) || substr({h}, 18, 15)")
_H = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source_uri))"

ORACLE.update({
    "extractor_overlap": build(["overlap"], "SELECT * FROM overlap"),
    "extractor_totals": build(["overlap", "postings"], """
        SELECT p.id AS posting_id,
               count(*) FILTER (WHERE o.extractor = 'adj_noun') AS n_rule,
               count(*) FILTER (WHERE o.extractor = 'tagger') AS n_tagger,
               count(*) FILTER (WHERE o.extractor = 'adj_noun' AND o.overlaps) AS n_overlap
        FROM postings p LEFT JOIN overlap o ON o.posting_id = p.id GROUP BY ROLLUP (p.id)"""),
    "stage_counts": build(["postings", "tokens", "sentences", "spans", "mappings", "reqs"], """
        SELECT p.id AS posting_id,
               coalesce((SELECT count(*) FROM tokens t WHERE t.posting_id = p.id), 0) AS n_tokens,
               coalesce((SELECT count(*) FROM sentences t WHERE t.posting_id = p.id), 0) AS n_sentences,
               coalesce((SELECT count(*) FROM spans t WHERE t.posting_id = p.id), 0) AS n_spans,
               coalesce((SELECT count(*) FROM mappings t WHERE t.posting_id = p.id), 0) AS n_mappings,
               coalesce((SELECT count(*) FROM mappings t WHERE t.posting_id = p.id AND t.decision = 'accepted'), 0) AS n_accepted,
               coalesce((SELECT count(*) FROM reqs t WHERE t.posting_id = p.id), 0) AS n_requirements
        FROM postings p"""),
    "isco_levels": build(["postings"], f"""
        SELECT id, isco_group, {LEVEL_CASE} AS required_level,
               (isco_group IS NULL OR isco_group NOT BETWEEN 1 AND 9) AS level_is_fallback FROM postings"""),
    "concepts": f"""SELECT '{CONCEPT_NS}' || CAST(item_id AS VARCHAR) AS uri, text AS pref_label,
                           CAST(0 AS BIGINT) AS n_alt_labels, CAST(NULL AS VARCHAR) AS definition, item_id AS ord
                    FROM benchmark""",
    "encoder_inputs": f"""SELECT m.model_id, m.mode, b.item_id AS key, m.prefix || b.text AS input_text
                          FROM benchmark b, (VALUES {_ENC_VALUES}) m(model_id, mode, prefix)""",
    "page_keys": build(["page_postings"], f"""
        SELECT id, source_uri AS url, substr(h, 1, 8) AS posting_key,
               substr(h, 1, 12) || '5' || substr(h, 14, 3)
                 || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 15) AS posting_uuid,
               {_slug('employer')} AS employer_slug, {_slug('title')} AS title_slug,
               'draft-' || id AS draft_id,
               '{__import__('skillweave.config', fromlist=['x']).DEFAULT.data_ns}req_' || substr(h, 1, 8) || '_' AS req_uri_prefix
        FROM (SELECT *, {_H} AS h FROM page_postings)"""),
    "posting_checks": build(["raw_pages"], f"""
        SELECT id, source_uri, concat_ws('|', nullif(own, ''), nullif(odd, ''), CASE WHEN n_same_id > 1 THEN 'duplicate_id' END)
                 AS reasons, own = '' AS is_valid, n_same_id
        FROM (SELECT *, concat_ws('|', {_checks}) AS own, concat_ws('|', {_odd}) AS odd,
                     CASE WHEN id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY id) END AS n_same_id FROM raw_pages)"""),
    "postings_json": build(["raw_postings"], f"""
        SELECT id, source_uri, crawl_date, platform, employer, posting_date, title, raw_text,
               CAST(isco_group AS INTEGER) AS isco_group, concat_ws('|', {_odd}) AS quality
        FROM (SELECT * FROM raw_postings WHERE concat_ws('|', {_json_checks}) = '')"""),
    "rejects": build(["raw_postings"], f"""
        SELECT id, source_uri, reasons, record FROM (SELECT *, concat_ws('|', {_json_checks}) AS reasons FROM raw_postings)
        WHERE reasons <> ''"""),
    "concepts_json": f"""SELECT '{CONCEPT_NS}' || CAST(item_id AS VARCHAR) AS uri, text AS pref_label,
                           CAST(0 AS BIGINT) AS n_alt_labels, CAST(NULL AS VARCHAR) AS definition,
                           row_number() OVER (ORDER BY '{CONCEPT_NS}' || CAST(item_id AS VARCHAR)) AS ord
                    FROM benchmark""",
})


# --- RDF delivery ---------------------------------------------------------------
def _rdf_fragments():
    from skillweave.config import (DEFAULT, LABEL_LANG, ONTOLOGY_NS as ONT, PROVENANCE_SOURCE, RDF_LANGSTRING,
                                   RDF_TYPE, RDFS_LABEL, XSD_NS)
    from skillweave.operators.rdf import turtle_prefixes
    from skillweave.operators.shapes import CONSTRAINT_ROWS, _expand
    d = DEFAULT
    frag("ids", f"""
      SELECT posting_id, posting_key, requirement_key, '{d.data_ns}posting_' || posting_key AS posting_iri,
             CASE WHEN employer IS NOT NULL THEN '{d.employer_ns}' || {_slug('employer')} END AS employer_iri,
             {_slug('employer')} AS slug, employer, title, posting_date, source_uri
      FROM (SELECT id AS posting_id, {_UUID.format(h=_H.replace('source_uri', 'coalesce(source_uri, id)'))} AS posting_key,
                   {_UUID.format(h=_H.replace('source_uri', "coalesce(source_uri, id) || '#' || id"))} AS requirement_key,
                   employer, title, posting_date, source_uri
            FROM postings)""", ["postings"])
    N = "CAST(NULL AS VARCHAR)"

    def t(pid, s, p, o, kind, dt=None, lang=None):
        dt_s = f"'{dt}'" if dt else N
        lang_s = f"'{lang}'" if lang else N
        return (f"SELECT {pid} AS posting_id, {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, {dt_s} AS datatype, "
                f"{lang_s} AS lang")

    rq = f"(SELECT r.*, i.posting_iri, '{d.data_ns}req_' || i.requirement_key || '_' || CAST(r.req_ord AS VARCHAR) AS req_iri FROM reqs r JOIN ids i ON i.posting_id = r.posting_id)"
    parts = [
        t(N, "employer_iri", RDF_TYPE, f"'{ONT}Employer'", "iri") + " FROM (SELECT DISTINCT employer_iri FROM ids WHERE employer IS NOT NULL)",
        t(N, "employer_iri", RDFS_LABEL, "employer", "literal", RDF_LANGSTRING, LABEL_LANG)
        + " FROM (SELECT DISTINCT employer_iri, employer FROM ids WHERE employer IS NOT NULL)",
        t("posting_id", "posting_iri", RDF_TYPE, f"'{ONT}JobPosting'", "iri") + " FROM ids",
        t("posting_id", "posting_iri", RDFS_LABEL, "title", "literal", RDF_LANGSTRING, LABEL_LANG) + " FROM ids",
        t("posting_id", "posting_iri", ONT + "postingDate", "posting_date", "literal", XSD_NS + "date") + " FROM ids",
        t("posting_id", "posting_iri", ONT + "issuedBy", "employer_iri", "iri") + " FROM ids",
        t("posting_id", "posting_iri", ONT + "sourceUrl", "source_uri", "literal", XSD_NS + "anyURI") + " FROM ids",
        t("posting_id", "posting_iri", ONT + "hasRequirement", "req_iri", "iri") + f" FROM {rq}",
        t("posting_id", "req_iri", RDF_TYPE, f"'{ONT}QualificationRequirement'", "iri") + f" FROM {rq}",
        t("posting_id", "req_iri", ONT + "refersToCompetence", "refers_to_competence", "iri") + f" FROM {rq}",
        t("posting_id", "req_iri", ONT + "requiredLevel", f"'{ONT}' || required_level", "iri") + f" FROM {rq}",
        t("posting_id", "req_iri", ONT + "requirementKind", "requirement_kind", "literal", XSD_NS + "string") + f" FROM {rq}",
        t("posting_id", "req_iri", ONT + "provenanceConfidence", "printf('%.2f', provenance_confidence)", "literal",
          XSD_NS + "decimal") + f" FROM {rq}",
        t("posting_id", "req_iri", ONT + "provenanceSource", f"'{PROVENANCE_SOURCE}'", "literal", XSD_NS + "string")
        + f" FROM {rq}",
    ]
    stated = "\n  UNION ALL ".join(parts[2:])
    frag("triples", "\n  UNION ALL ".join(parts[:2]) + f"""
  UNION ALL
  SELECT min(posting_id) AS posting_id, s, p, o, o_kind, datatype, lang
  FROM ({stated}) WHERE o IS NOT NULL GROUP BY s, p, o, o_kind, datatype, lang""", ["ids", "reqs"])

    m = ("CASE WHEN posting_id IS NULL THEN -1 ELSE "
         "CAST(regexp_extract(posting_id, '([0-9]+)$', 1) AS BIGINT) % 13 END")
    frag("faulty", f"""
      SELECT posting_id, s, p,
             CASE WHEN m_ = 2 AND p = '{ONT}postingDate' THEN '2024-13-45'
                  WHEN m_ = 3 AND p = '{ONT}requirementKind' THEN 'maybe'
                  WHEN m_ = 4 AND p = '{ONT}provenanceConfidence' THEN '1.50'
                  WHEN m_ = 7 AND p = '{ONT}requiredLevel' THEN '{ONT}DQR9' ELSE o END AS o,
             CASE WHEN m_ = 6 AND p = '{ONT}refersToCompetence' THEN 'literal' ELSE o_kind END AS o_kind,
             CASE WHEN m_ = 6 AND p = '{ONT}refersToCompetence' THEN '{XSD_NS}string'
                  WHEN m_ = 8 AND p = '{ONT}sourceUrl' THEN '{XSD_NS}string' ELSE datatype END AS datatype, lang
      FROM (SELECT *, {m} AS m_ FROM triples) WHERE NOT (m_ = 1 AND p = '{ONT}postingDate')
      UNION ALL
      SELECT posting_id, s, p, o || '-2', o_kind, datatype, lang
      FROM (SELECT *, {m} AS m_ FROM triples) WHERE m_ = 5 AND p = '{ONT}issuedBy'""", ["triples"])

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)

    rows = ",\n        ".join("(" + ", ".join(lit(x) for x in _expand(r)) + ")" for r in CONSTRAINT_ROWS)
    cols = ("shape, target_class, path, min_count, max_count, node_kind, datatype_c, pattern, allowed, "
            "min_incl, max_incl, min_excl, min_length, message")
    frag("cons", f"""
      SELECT shape, target_class, path, CAST(min_count AS INTEGER) AS min_count, CAST(max_count AS INTEGER) AS max_count,
             node_kind, datatype_c, pattern, CAST(allowed AS VARCHAR[]) AS allowed, CAST(min_incl AS DOUBLE) AS min_incl,
             CAST(max_incl AS DOUBLE) AS max_incl, CAST(min_excl AS DOUBLE) AS min_excl,
             CAST(min_length AS INTEGER) AS min_length, message
      FROM (VALUES {rows}) v({cols})""", [])
    fv = lambda graph: f"""
      SELECT fc.*, v.o, v.o_kind, v.datatype AS datatype_v
      FROM (SELECT f.focus, c.* FROM (SELECT DISTINCT s AS focus, o AS target_class FROM {graph} WHERE p = '{RDF_TYPE}') f
            JOIN cons c ON c.target_class = f.target_class) fc
      LEFT JOIN (SELECT DISTINCT s, p, o, o_kind, datatype, lang FROM {graph}) v ON v.s = fc.focus AND v.p = fc.path"""  # noqa: E731
    frag("fv", fv("faulty"), ["faulty", "cons"])
    frag("fv_clean", fv("triples"), ["triples", "cons"])
    num = "try_cast(o AS DECIMAL(38,18))"
    ill = (f"((datatype_v = '{XSD_NS}date' AND try_strptime(o, '%Y-%m-%d') IS NULL) OR "
           f"(datatype_v = '{XSD_NS}decimal' AND ({num} IS NULL OR NOT regexp_matches(o, '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$'))))")
    checks = {
        "nodeKind": "node_kind IS NOT NULL AND o_kind <> 'iri'",
        "datatype": f"datatype_c IS NOT NULL AND (o_kind <> 'literal' OR NOT coalesce(datatype_v = datatype_c, false) OR {ill})",
        "pattern": "pattern IS NOT NULL AND NOT regexp_matches(o, pattern)",
        "in": f"allowed IS NOT NULL AND NOT (o_kind = 'literal' AND coalesce(datatype_v = '{XSD_NS}string', false) AND list_contains(allowed, o))",
        "minInclusive": f"min_incl IS NOT NULL AND NOT coalesce({num} >= min_incl, false)",
        "maxInclusive": f"max_incl IS NOT NULL AND NOT coalesce({num} <= max_incl, false)",
        "minExclusive": f"min_excl IS NOT NULL AND NOT coalesce({num} > min_excl, false)",
        "minLength": "min_length IS NOT NULL AND length(o) < min_length",
    }
    def violations(fv):
        value_parts = [f"SELECT focus, shape, path, message, '{k}' AS \"constraint\", o AS value FROM {fv} WHERE o IS NOT NULL AND {c}"
                       for k, c in checks.items()]
        card = f"(SELECT focus, shape, path, message, min_count, max_count, count(o) AS n FROM {fv} GROUP BY ALL)"
        return "\n  UNION ALL ".join([
        f"SELECT focus, shape, path, message, 'minCount' AS \"constraint\", CAST(n AS VARCHAR) AS value FROM {card} WHERE n < min_count",
        f"SELECT focus, shape, path, message, 'maxCount', CAST(n AS VARCHAR) FROM {card} WHERE n > max_count",
        ] + value_parts)

    frag("violations", violations("fv"), ["fv"])
    frag("violations_clean", violations("fv_clean"), ["fv_clean"])

    def esc(x):
        return f"replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r')"

    prefixes = turtle_prefixes(d).replace("'", "''")
    name = "'data:req_' || i.requirement_key || '_' || CAST(r.req_ord AS VARCHAR)"
    block = (f"{name} || chr(10) || '  a ont:QualificationRequirement ;' || chr(10)"
             f" || '  ont:refersToCompetence <' || r.refers_to_competence || '> ;' || chr(10)"
             f" || '  ont:requiredLevel ont:' || r.required_level || ' ;' || chr(10)"
             f" || '  ont:requirementKind \"' || r.requirement_kind || '\" ;' || chr(10)"
             f" || '  ont:provenanceConfidence \"' || printf('%.2f', r.provenance_confidence) || '\"^^xsd:decimal ;' || chr(10)"
             f" || '  ont:provenanceSource \"{PROVENANCE_SOURCE}\" .' || chr(10)")
    frag("ttl_reqs", f"""
      SELECT r.posting_id, string_agg({name}, ' ,' || chr(10) || '    ' ORDER BY r.req_ord) AS names,
             string_agg({block}, chr(10) ORDER BY r.req_ord) AS blocks
      FROM reqs r JOIN ids i ON i.posting_id = r.posting_id GROUP BY r.posting_id""", ["reqs", "ids"])
    line = lambda c, x: f"CASE WHEN i.{c} IS NULL THEN '' ELSE {x} END"
    block_of_employer = ("chr(10) || 'employer:' || i.slug || chr(10) || '  a ont:Employer ;' || chr(10)"
                         f" || '  rdfs:label \"' || {esc('i.employer')} || '\"@de .' || chr(10)")
    head = " || ".join([
        f"'{prefixes}'", line("employer", block_of_employer),
        "chr(10) || 'data:posting_' || i.posting_key || chr(10) || '  a ont:JobPosting'",
        line("title", f"' ;' || chr(10) || '  rdfs:label \"' || {esc('i.title')} || '\"@de'"),
        line("posting_date", f"' ;' || chr(10) || '  ont:postingDate \"' || {esc('i.posting_date')} || '\"^^xsd:date'"),
        line("employer", "' ;' || chr(10) || '  ont:issuedBy employer:' || i.slug"),
        line("source_uri", f"' ;' || chr(10) || '  ont:sourceUrl \"' || {esc('i.source_uri')} || '\"^^xsd:anyURI'")])
    tail = ("CASE WHEN t.names IS NULL THEN ' .' || chr(10) ELSE ' ;' || chr(10) || '  ont:hasRequirement ' || t.names"
            " || ' .' || chr(10) || chr(10) || t.blocks END")
    frag("ttl", f"""
      SELECT i.posting_id, i.posting_id || '.ttl' AS file_name, {head} || {tail} AS turtle
      FROM ids i LEFT JOIN ttl_reqs t ON t.posting_id = i.posting_id""", ["ids", "ttl_reqs"])


_rdf_fragments()


def _slots(src: str, key: str, text: str, size: int = 3) -> str:
    """Counts of hashed character n-grams in 64 slots, and their norm."""
    slot = " + ".join(f"ord(substr(p, k + {j}, 1)) * {31 ** (size - 1 - j)}" for j in range(size))
    return f"""
  SELECT key, slot, n, sqrt(sum(n * n) OVER (PARTITION BY key)) AS norm
  FROM (SELECT key, ({slot}) % 64 AS slot, CAST(count(*) AS DOUBLE) AS n
        FROM (SELECT key, p, unnest(range(1, length(p) - {size - 2})) AS k FROM (SELECT {key} AS key, ' ' || lower({text}) || ' ' AS p FROM {src}))
        GROUP BY 1, 2)"""


frag("qslots", _slots("qtexts", "text", "text"), ["qtexts"])
frag("cslots", _slots("benchmark", "item_id", "text"), [])
frag("qpairs", _slots("qtexts", "text", "text", 2), ["qtexts"])
frag("cpairs", _slots("benchmark", "item_id", "text", 2), [])
frag("etexts", " UNION ALL ".join(f"""
  SELECT '{model}' AS model_id, t.text, b.item_id AS ord, b.text AS label, coalesce(d.score, 0.0) AS score
  FROM qtexts t CROSS JOIN benchmark b
  LEFT JOIN (SELECT q.key, c.key AS ord, sum(q.n * c.n) / (max(q.norm) * max(c.norm)) AS score
             FROM {q} q JOIN {c} c ON q.slot = c.slot GROUP BY q.key, c.key) d ON d.key = t.text AND d.ord = b.item_id"""
                            for model, q, c in (("hashed-trigrams", "qslots", "cslots"), ("hashed-pairs", "qpairs", "cpairs"))),
     ["qtexts", "qslots", "cslots", "qpairs", "cpairs"])
frag("hmaps", f"""
  SELECT 'mapping-' || substr(sha256(s.id || chr(1) || CAST(m.rank AS VARCHAR)), 1, 32) AS id, s.id AS span_id, s.posting_id,
         '{CONCEPT_NS}' || CAST(m.ord AS VARCHAR) AS concept_uri, round(m.score, 4) AS score,
         CASE WHEN m.rank = 1 AND m.score >= {B.SPARSE_THRESHOLD} THEN 'accepted' ELSE 'rejected' END AS decision,
         CAST(m.rank AS INTEGER) AS rank
  FROM spans s JOIN (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) AS rank FROM (
      SELECT t.text AS key, b.item_id AS ord, coalesce(d.score, 0.0) AS score FROM qtexts t CROSS JOIN benchmark b
      LEFT JOIN (SELECT q.key, c.key AS ord, sum(q.n * c.n) / (max(q.norm) * max(c.norm)) AS score
                 FROM qslots q JOIN cslots c ON q.slot = c.slot GROUP BY q.key, c.key) d
        ON d.key = t.text AND d.ord = b.item_id)) m ON m.key = s.text AND m.rank <= 3""", ["spans", "qtexts", "qslots", "cslots"])

ORACLE.update({
    "triples": build(["triples"], "SELECT * FROM triples"),
    "validation_report": build(["violations"], "SELECT * FROM violations"),
    "turtle_documents": build(["ttl"], "SELECT * FROM ttl"),
    "conforms": build(["violations", "violations_clean"], """
        SELECT 'delivered' AS graph, count(*) = 0 AS conforms, count(*) AS n_violations FROM violations_clean
        UNION ALL SELECT 'faulty', count(*) = 0, count(*) FROM violations"""),
    "mappings_dense_flow": build(["hmaps"], "SELECT * FROM hmaps"),
    "encoder_texts": build(["etexts"], """
        SELECT model_id, text, ord AS top1_concept, label AS top1_label, round(score, 4) AS top1_score, round(margin, 4) AS margin
        FROM (SELECT *, score - lead(score) OVER w AS margin, row_number() OVER w AS rank FROM etexts
              WINDOW w AS (PARTITION BY model_id, text ORDER BY score DESC, ord)) WHERE rank = 1"""),
})


ORACLE.update({
    "mapping_review": build(["mappings", "spans"], """
        SELECT m.posting_id, m.span_id, coalesce(s.text, '') AS span_text, coalesce(s.extractor, '') AS extractor,
               m.rank, m.concept_uri, printf('%.4f', m.score) AS score, m.decision
        FROM mappings m LEFT JOIN spans s ON s.id = m.span_id"""),
    "run_metadata": build(["postings", "tokens", "sentences", "spans", "mappings", "reqs", "triples"], f"""
        SELECT '{__import__('skillweave').__version__}' AS pipeline_version, 'documents' AS input, p.n AS posting_count,
               t.n AS n_tokens, s.n AS n_sentences, sp.n AS n_spans, m.n AS n_mappings, m.a AS n_accepted, r.n AS n_requirements,
               tr.n AS n_triples, 'mappings_csv|ntriples|turtle' AS sinks,
               CAST({B.SPARSE_THRESHOLD} AS DOUBLE) AS mapping_threshold, CAST(3 AS BIGINT) AS mapping_top_k,
               'trigram' AS encoder, sp.n AS rows_spans, m.n AS rows_mappings, r.n AS rows_requirements,
               p.n AS rows_stage_counts, tr.n AS rows_triples
        FROM (SELECT count(*) AS n FROM postings) p, (SELECT count(*) AS n FROM tokens) t,
             (SELECT count(*) AS n FROM sentences) s, (SELECT count(*) AS n FROM spans) sp,
             (SELECT count(*) AS n, count(*) FILTER (WHERE decision = 'accepted') AS a FROM mappings) m,
             (SELECT count(*) AS n FROM reqs) r, (SELECT count(*) AS n FROM triples) tr"""),
    "vector_cache": build(["cfeat"], f"""
        SELECT 'trigram' AS model_id, '{CONCEPT_NS}' || CAST(b.item_id AS VARCHAR) AS uri, sha256(b.text) AS label_hash,
               f.n_terms, round(f.norm, 6) AS norm,
               CAST(CASE WHEN upper(b.text) = b.text THEN 1 ELSE 2 END AS BIGINT) AS n_versions
        FROM benchmark b JOIN (SELECT key, count(*) AS n_terms, max(norm) AS norm FROM cfeat GROUP BY key) f
          ON f.key = b.item_id"""),
    "full_run": ORACLE["requirements"],
})
