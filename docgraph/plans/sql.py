"""The same inputs and relations in SQL, as common table expressions for the oracle queries."""

from __future__ import annotations

RAW = "raw AS (SELECT source || '/' || lang || '-' || doc_id || '/document.md' AS relative_path, text AS content FROM documents)"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
KEY = "regexp_replace(lower({}), '[^가-힣a-z0-9]', '', 'g')"


def ident(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256('[' || " + " || ',' || ".join(parts) + " || ']'), 1, 20)"


def j(x: str) -> str:
    return f"to_json({x})::VARCHAR"


SOURCES = f"""src AS (SELECT {ident('s', j('relative_path'))} AS source_id, relative_path, sha256(content) AS sha256, {ident('p', j("split_part(relative_path, '/', 1)"))} AS product_id,
  split_part(relative_path, '/', 1) AS product_name, {ident('d', j('sha256(content)'))} AS document_id FROM raw)"""
PRODUCTS = f"""prod AS (SELECT product_id, name, [{KEY.format('name')}] AS aliases, (row_number() OVER (ORDER BY p, product_id) - 1)::INT AS ordinal
  FROM (SELECT product_id, product_name AS name, min(relative_path) AS p FROM src GROUP BY ALL))"""
DOCUMENTS = f"""grp AS (SELECT sha256(content) AS sha256, min(relative_path) AS first_path, count(*) AS source_count, any_value(content) AS text FROM raw GROUP BY 1),
docs AS (SELECT {ident('d', j('sha256'))} AS document_id, sha256,
  CASE WHEN regexp_matches(text, '(?m)^#') THEN trim(regexp_replace(regexp_extract(text, '(?m)^(#[^\\n]*)', 1), '^#+\\s*', '')) ELSE split_part(first_path, '/', -2) END AS title, text, source_count,
  list_sort(list_distinct(regexp_extract_all(text, '20\\d{{2}}[.년/-]\\s*\\d{{1,2}}[.월/-]\\s*\\d{{1,2}}일?'))) AS date_mentions FROM grp)"""


def last(mark: str) -> str:
    """Place (from 0) of the last mark in the window w, or null."""
    back = f"strpos(reverse(w), '{mark[::-1]}')"
    return f"CASE WHEN {back} > 0 THEN length(w) - {back} - {len(mark) - 1} END"


def units(limit: int = 1700) -> str:
    half = limit // 2
    w = f"substr(rest, {half + 1}, {limit - half})"
    newline = last("#").replace("'#'", "chr(10)")
    places = ", ".join([newline, *(last(x) for x in ("。", ". ", "; ", " "))])
    return f"""parts AS (
  SELECT document_id, -1 AS ordinal, {STRIP.format('text')} AS rest, NULL::VARCHAR AS part FROM docs
  UNION ALL
  SELECT document_id, ordinal + 1, CASE WHEN length(rest) > {limit} THEN {STRIP.format('substr(rest, cut + 1)')} ELSE '' END,
    CASE WHEN length(rest) > {limit} THEN {STRIP.format('substr(rest, 1, cut)')} ELSE rest END
  FROM (SELECT *, coalesce({half} + greatest({places}) + 1, {limit}) AS cut FROM (SELECT *, {w} AS w FROM parts WHERE rest <> ''))),
units AS (SELECT {ident('u', j('p.document_id'), 'p.ordinal::VARCHAR')} AS unit_id, p.document_id, p.ordinal, p.part AS text, d.title AS heading, 1 AS page
  FROM parts p JOIN docs d USING (document_id) WHERE p.part IS NOT NULL)"""


UNITS = units()
CHUNKS = f"""fold AS (
  SELECT document_id, ordinal, 0 AS chunk_no, length(text) + length(heading) + 5 AS size FROM units WHERE ordinal = 0
  UNION ALL
  SELECT u.document_id, u.ordinal, f.chunk_no + full_::INT, CASE WHEN full_ THEN 0 ELSE f.size END + length(u.text) + length(u.heading) + 5
  FROM fold f JOIN units u ON u.document_id = f.document_id AND u.ordinal = f.ordinal + 1,
    LATERAL (SELECT f.size + length(u.text) + length(u.heading) + 5 > 5600 OR f.size >= 3400 AS full_)),
placed AS (SELECT u.*, f.chunk_no FROM units u JOIN fold f USING (document_id, ordinal)),
chunks AS (SELECT {ident('c', j('document_id'), j('unit_ids'))} AS chunk_id, * FROM (
  SELECT document_id, chunk_no AS ordinal, list(unit_id ORDER BY ordinal) AS unit_ids, [1] AS pages, [any_value(heading)] AS headings,
    string_agg('[' || heading || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) AS text FROM placed GROUP BY document_id, chunk_no))"""
FACTS = f"""kind(n, type) AS (VALUES (0, 'Rule'), (1, 'Condition'), (2, 'Requirement'), (3, 'Benefit'), (4, 'Restriction')),
fact AS (SELECT {ident('f', j('document_id'), j('type'), j('name'), j('[unit_id]'))} AS fact_id, * FROM (
  SELECT c.chunk_id, p.document_id, p.ordinal - min(p.ordinal) OVER (PARTITION BY c.chunk_id) AS fact_pos, k.type,
    trim(regexp_replace(array_to_string(list_slice(string_split(p.text, ' '), 1, 3), ' '), '\\s+', ' ', 'g')) AS name, p.text AS statement, p.unit_id,
    trim(regexp_replace(string_split(p.text, ' ')[1], '\\s+', ' ', 'g')) AS e1, trim(regexp_replace(string_split(p.text, ' ')[-1], '\\s+', ' ', 'g')) AS e2
  FROM placed p JOIN chunks c ON c.document_id = p.document_id AND c.ordinal = p.chunk_no JOIN kind k ON k.n = p.ordinal % 5)
  WHERE right(chunk_id, 1) NOT IN ('0', '1', '2')),
ent AS (SELECT DISTINCT {ident('entity', j('type'), j('name'))} AS entity_id, type, name, fact_id, unit_id FROM (
  SELECT 'Organization' AS type, e1 AS name, fact_id, unit_id FROM fact UNION ALL SELECT 'Concept', e2, fact_id, unit_id FROM fact))"""
GRAPH = f"""pair AS (
  SELECT 'ABOUT_PRODUCT' AS type, source_id AS source, product_id AS target FROM src UNION ALL SELECT 'VERSION_OF', source_id, document_id FROM src
  UNION ALL SELECT 'HAS_CHUNK', document_id, chunk_id FROM chunks
  UNION ALL SELECT * FROM (SELECT 'NEXT_CHUNK', chunk_id, lead(chunk_id) OVER (PARTITION BY document_id ORDER BY ordinal) AS t FROM chunks) WHERE t IS NOT NULL
  UNION ALL SELECT 'ASSERTS', document_id, fact_id FROM fact UNION ALL SELECT 'SUPPORTED_BY', fact_id, chunk_id FROM fact
  UNION ALL SELECT 'MENTIONS', fact_id, entity_id FROM ent),
edges AS (SELECT DISTINCT {ident('e', j('type'), j('source'), j('target'))} AS id, source, target, type FROM pair),
nodes AS (SELECT DISTINCT * FROM (
  SELECT document_id AS id, 'Document' AS type, title AS name FROM docs UNION ALL SELECT product_id, 'Product', name FROM prod
  UNION ALL SELECT source_id, 'Source', relative_path FROM src UNION ALL SELECT chunk_id, 'Chunk', chunk_id FROM chunks
  UNION ALL SELECT fact_id, type, name FROM fact UNION ALL SELECT entity_id, type, name FROM ent))"""


def terms(x: str) -> str:
    grams = lambda n: f"CASE WHEN length(w) >= {n} THEN list_transform(range(1, length(w) - {n - 2}), lambda i: 'g:' || substr(w, i, {n})) ELSE [] END"
    return f"flatten(list_transform(regexp_extract_all(lower({x}), '[가-힣A-Za-z0-9%]+'), lambda w: list_concat(CASE WHEN length(w) > 1 THEN ['w:' || w] ELSE [] END, list_concat({grams(2)}, {grams(3)}))))"


def bm25(name: str, texts: str, asked: str) -> str:
    """Common table expressions; {name}(question_id, id, score), rounded to nine places. texts(id, text), asked(question_id, question)."""
    return f"""{name}_t AS (SELECT id, {terms('text')} AS t FROM ({texts})),
{name}_s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM {name}_t),
{name}_q AS (SELECT DISTINCT question_id, unnest({terms('question')}) AS term FROM ({asked})),
{name}_u AS (SELECT DISTINCT term FROM {name}_q),
{name}_p AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM {name}_t) SEMI JOIN {name}_u USING (term) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name} AS (SELECT question_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / greatest(1.0::DOUBLE, a)))), 9) AS score
  FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_d USING (term), {name}_s GROUP BY ALL)"""


ASKED = "SELECT item_id AS question_id, 'src' || (item_id % 20) || ' ' || text AS question FROM benchmark"


def query(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


CORPUS = (RAW, SOURCES, PRODUCTS, DOCUMENTS)
CUT = (*CORPUS, UNITS, CHUNKS)
FULL = (*CUT, FACTS, GRAPH)
