"""Doctrine and guidance pages made from the given tables: a part's order lines are the segments of its page."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators import doctrine
from veritrail.plans.corpus import ctes, derived

_S = "CAST({0} AS STRING)"
_MONTHS = "split_part('enero,febrero,marzo,abril,mayo,junio,julio,agosto,septiembre,octubre,noviembre,brumario', ',', CAST(1 + {0} % 12 AS INT))"
#: Lines of a page in order, n from 1.
_LINES = "SELECT l_partkey AS e, l_orderkey * 10 + l_linenumber AS segment_id, l_suppkey AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM {line}"
#: Title, date, publication, then labels and contents by turns; titles, dates and labels are doubled, lost or foreign in a part of the pages.
_DOCTRINE = f"""SELECT e AS extraction_id, segment_id, n AS sequence_no, CASE WHEN n <= 3 OR (n % 2 = 1 AND v % 40 = 0) THEN 'paragraph' ELSE 'table_row' END AS segment_type,
 CASE WHEN n = 1 THEN ' CONCEPTO 00' || {_S.format('e % 97 + 1')} || ' int ' || {_S.format('v')} || ' DE ' || {_S.format('1990 + e % 25 + CASE WHEN e % 17 = 0 THEN 1 ELSE 0 END')} WHEN n = 2 THEN '(' || {_MONTHS.format('e')} || ' ' || {_S.format('1 + e % 30')} || ')' WHEN n = 3 THEN 'Publicado en la Página Web de la DIAN: ' || {_S.format('1 + e % 28')} || ' de ' || {_MONTHS.format('e % 11')} || ' de ' || {_S.format('1991 + e % 25')} || '.'
 WHEN n = 5 AND e % 19 = 0 THEN 'Concepto 7 int 8 de 2001' WHEN n = 7 AND e % 23 = 0 THEN 'Mayo 3' WHEN n = 9 AND e % 29 = 0 THEN 'x Publicado en la pagina web de la DIAN: 3 de mayo de 2001'
 WHEN n % 4 = 0 AND v % 30 > 0 THEN CASE WHEN v % 2 = 0 THEN 'PROBLEMA JURÍDICO No. ' ELSE 'Problema Juridico | PROBLEMA JURÍDICO No. ' END || {_S.format('CAST(floor(n / 4) AS BIGINT)')} WHEN n % 4 = 2 AND v % 31 > 0 THEN 'TESIS JURÍDICA No.' || {_S.format('CAST(floor(n / 4) AS BIGINT)')} || ' ' ELSE 'Se considera que ' || {_S.format('v')} || '.' END AS text FROM {{lines}}"""
_IDENTITIES = "SELECT DISTINCT e AS extraction_id, 'D' || CAST(e % 500 AS STRING) AS document_id, CASE WHEN e % 13 = 0 THEN 'OFICIO' ELSE 'CONCEPTO' END AS document_type, e % 97 + 1 AS number, CAST(1990 + e % 25 AS INT) AS year FROM {lines}"
#: A heading, thirteen questions with an answer each, and more answers; some pages have another heading, one inside, or lose an answer.
_GUIDANCE = f"""SELECT e AS extraction_id, segment_id, n AS sequence_no, CASE WHEN n = 1 OR (n % 7 = 3 AND v % 200 = 0) THEN 'section_heading' WHEN n % 2 = 0 AND n <= 26 THEN 'question' WHEN n % 11 = 5 AND v % 150 = 0 THEN 'paragraph' ELSE 'answer' END AS segment_type,
 CASE WHEN n = 1 THEN CASE WHEN e % 21 = 0 THEN 'Otro trámite' ELSE ' {doctrine.RUT_CANCELLATION['title']} ' END WHEN n % 2 = 0 THEN '¿Pregunta ' || {_S.format('v')} || '?' ELSE 'Respuesta ' || {_S.format('v')} END AS text FROM {{lines}}"""
_READ = f"SELECT DISTINCT e AS extraction_id, e + 1 AS manifestation_id, CASE WHEN e % 10 = 0 THEN 'generic_html' ELSE '{doctrine.RUT_CANCELLATION['extractor']}' END AS extractor, CASE e % 9 WHEN 0 THEN '1' WHEN 1 THEN 'beta' WHEN 2 THEN '10' ELSE '2' END AS version, CASE WHEN e % 8 = 0 THEN 'DOC-other' END AS document_id FROM {{lines}} UNION ALL SELECT -1, 0, '{doctrine.RUT_CANCELLATION['extractor']}', '2', NULL"


def _pages(spark, d, *sql):
    (line,) = derived(spark, d, "line")
    lines = spark.sql(_LINES, line=line)
    return [spark.sql(s, lines=lines) for s in sql]


def _doctrine(spark, d):
    return doctrine.doctrine(*_pages(spark, d, _DOCTRINE, _IDENTITIES))


def q_doctrine_metadata(spark, d):
    """Title, numbers and dates of doctrine pages, or why they are refused."""
    out = _doctrine(spark, d)["metadata"]
    return out.select("extraction_id", "document_id", "status", "reason", "title", "external_number", "normalized_number", "internal_number", F.col("doctrine_date").cast("string").alias("doctrine_date"), F.col("web_date").cast("string").alias("web_date"), "positions")


def q_doctrine_positions(spark, d):
    """Legal problems with their theses."""
    return _doctrine(spark, d)["positions"].drop("position_id")


def q_doctrine_evidence(spark, d):
    """What the rows of doctrine pages rest on, by role."""
    return _doctrine(spark, d)["evidence"].select("extraction_id", "segment_id", "role")


def q_guidance_pages(spark, d):
    """Guidance pages: registered, or by what they are refused."""
    out = doctrine.guidance(*_pages(spark, d, _GUIDANCE, _READ))["pages"]
    return out.select("extraction_id", "manifestation_id", "state", "questions", F.col("document_id").startswith("DOC-other").alias("elsewhere"))


def q_guidance_rows(spark, d):
    """Questions and answers of registered guidance pages."""
    return doctrine.guidance(*_pages(spark, d, _GUIDANCE, _READ))["rows"].select("extraction_id", "ordinal", "answer_order", "segment_id", "text")


_LABELS = r"(?i)(PROBLEMA\s+JUR[IÍ]DICO|TESIS\s+JUR[IÍ]DICA)(\s*\|)?\s+(PROBLEMA\s+JUR[IÍ]DICO|TESIS\s+JUR[IÍ]DICA)?\s*No\.\s*(\d+)\s*$"
_ON = ", ".join(f"({i + 1}, '{m}')" for i, m in enumerate(("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")))
_DAY = "try_cast({y} || '-' || lpad(CAST((SELECT m FROM mo WHERE name = lower({m})) AS VARCHAR), 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
_D = rf"""{ctes('line')}, lines AS ({_LINES.format(line='line')}), s AS ({_DOCTRINE.format(lines='lines')}), ids AS ({_IDENTITIES.format(lines='lines')}), mo AS (SELECT * FROM (VALUES {_ON}) t(m, name)),
h AS (SELECT *, trim(text) AS x, regexp_full_match(trim(text), '(?i)CONCEPTO\s+\d+\s+int\s+\d+\s+DE\s+\d{{4}}') AS it, regexp_full_match(trim(text), '\(?[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+\s+\d{{1,2}}\)?') AS id, regexp_matches(text, '(?i)Publicado en la p[aá]gina web de la DIAN: *\d+ de \S+ de \d{{4}}') AS iw FROM s),
g AS (SELECT extraction_id, count(*) FILTER (it) AS nt, count(*) FILTER (id) AS nd, count(*) FILTER (iw) AS nw, max(x) FILTER (it) AS t, max(x) FILTER (id) AS d, max(text) FILTER (iw) AS w, max(segment_id) FILTER (it) AS ti, max(segment_id) FILTER (id) AS di, max(segment_id) FILTER (iw) AS wi FROM h GROUP BY 1),
q AS (SELECT *, lead(segment_type) OVER o AS nty, lead(segment_id) OVER o AS nid, lead(text) OVER o AS ntx, CAST(nullif(regexp_extract(trim(text), '{_LABELS}', 4), '') AS BIGINT) AS ordinal, lower(trim(text))[1:4] = 'prob' AS pr FROM s WINDOW o AS (PARTITION BY extraction_id ORDER BY sequence_no)),
p AS (SELECT extraction_id, ordinal, bool_and(nty IS NOT DISTINCT FROM 'table_row') AS fed, max(nid) FILTER (pr AND nty = 'table_row') AS problem_id, max(ntx) FILTER (pr AND nty = 'table_row') AS problem_text, max(nid) FILTER (NOT pr AND nty = 'table_row') AS thesis_id, max(ntx) FILTER (NOT pr AND nty = 'table_row') AS thesis_text FROM q WHERE segment_type = 'table_row' AND ordinal IS NOT NULL GROUP BY 1, 2),
c AS (SELECT extraction_id, count(*) AS found, count(*) FILTER (NOT fed OR problem_id IS NULL OR thesis_id IS NULL) AS lacking FROM p GROUP BY 1),
a AS (SELECT ids.*, g.* EXCLUDE (extraction_id), coalesce(found, 0) AS found, coalesce(lacking, 0) AS lacking, split_part(t, ' ', 2) AS ext, split_part(t, ' ', 4) AS int_no, split_part(t, ' ', 6) AS ty, {_DAY.format(y="split_part(t, ' ', 6)", m="trim(split_part(d, ' ', 1), '()')", d="trim(split_part(d, ' ', 2), '()')")} AS dd, {_DAY.format(y="regexp_extract(w, '(\\d{4})\\D*$', 1)", m="regexp_extract(w, 'DIAN: *\\d+ de (\\S+) de', 1)", d="regexp_extract(w, 'DIAN: *(\\d+)', 1)")} AS wd FROM ids JOIN g USING (extraction_id) LEFT JOIN c USING (extraction_id)),
r AS (SELECT *, CASE WHEN document_type <> 'CONCEPTO' OR nt <> 1 THEN 'NA' WHEN CAST(ext AS BIGINT) <> number OR CAST(ty AS INT) <> year THEN 'DOCTRINE_TITLE_IDENTITY_CONFLICT' WHEN nd <> 1 OR nw <> 1 THEN 'DOCTRINE_DATE_EVIDENCE_AMBIGUOUS' WHEN dd IS NULL OR wd IS NULL THEN 'DOCTRINE_DATE_INVALID' WHEN lacking > 0 THEN 'INCOMPLETE_DOCTRINE_POSITIONS' END AS why FROM a),
ok AS (SELECT *, why IS NULL OR why = 'INCOMPLETE_DOCTRINE_POSITIONS' AS good FROM r)"""
_G = f"""{ctes('line')}, lines AS ({_LINES.format(line='line')}), s AS ({_GUIDANCE.format(lines='lines')}), x AS ({_READ.format(lines='lines')}), o AS (SELECT *, sum(CASE WHEN segment_type = 'question' THEN 1 ELSE 0 END) OVER w AS ordinal, max(CASE WHEN segment_type = 'section_heading' THEN sequence_no ELSE 0 END) OVER w AS last_head, max(CASE WHEN segment_type = 'question' THEN sequence_no ELSE 0 END) OVER w AS last_q FROM s WINDOW w AS (PARTITION BY extraction_id ORDER BY sequence_no)),
k AS (SELECT * FROM o WHERE segment_type = 'question' OR (segment_type = 'answer' AND last_q > last_head)), n AS (SELECT extraction_id, ordinal, count(*) AS n FROM k GROUP BY 1, 2), c AS (SELECT extraction_id, count(*) AS questions, count(*) FILTER (n = 1) AS bare FROM n GROUP BY 1),
st AS (SELECT x.*, coalesce(questions, 0) AS questions, CASE WHEN extractor = 'generic_html' THEN 'unsupported_extractor' WHEN version = 'beta' THEN 'non_numeric_version' WHEN version = '1' THEN 'version_too_old' WHEN x.extraction_id = -1 THEN 'no_segments' WHEN x.extraction_id % 21 = 0 THEN 'unexpected_heading' WHEN coalesce(questions, 0) <> 13 THEN 'question_count' WHEN bare > 0 THEN 'question_without_answer' WHEN document_id IS NOT NULL THEN 'linked_elsewhere' ELSE 'registered' END AS state FROM x LEFT JOIN c USING (extraction_id))"""
ORACLES = {
    "doctrine_metadata": f"{_D} SELECT extraction_id, document_id, CASE WHEN why = 'NA' THEN 'not_applicable' WHEN NOT good THEN 'unresolved' WHEN why IS NULL THEN 'registered' ELSE 'partial' END AS status, nullif(why, 'NA') AS reason, CASE WHEN good THEN t END AS title, CASE WHEN good THEN ext END AS external_number, CASE WHEN good THEN CAST(CAST(ext AS BIGINT) AS VARCHAR) END AS normalized_number, CASE WHEN good THEN int_no END AS internal_number, CASE WHEN good THEN CAST(dd AS VARCHAR) END AS doctrine_date, CASE WHEN good THEN CAST(wd AS VARCHAR) END AS web_date, CASE WHEN good THEN found END AS positions FROM ok",
    "doctrine_positions": f"{_D} SELECT document_id, ordinal, extraction_id, problem_id, problem_text, thesis_id, thesis_text FROM p JOIN ok USING (extraction_id) WHERE good AND problem_id IS NOT NULL AND thesis_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, ordinal ORDER BY extraction_id DESC) = 1",
    "doctrine_evidence": f"{_D}, f AS (SELECT p.* FROM p JOIN ok USING (extraction_id) WHERE good AND problem_id IS NOT NULL AND thesis_id IS NOT NULL) SELECT extraction_id, ti AS segment_id, 'document_identity' AS role FROM ok WHERE good UNION ALL SELECT extraction_id, di, 'doctrine_date' FROM ok WHERE good UNION ALL SELECT extraction_id, wi, 'web_publication_date' FROM ok WHERE good UNION ALL SELECT extraction_id, problem_id, 'problem_' || ordinal FROM f UNION ALL SELECT extraction_id, thesis_id, 'thesis_' || ordinal FROM f",
    "guidance_pages": f"{_G} SELECT extraction_id, manifestation_id, state, questions, CASE WHEN state = 'registered' THEN false ELSE document_id = 'DOC-other' END AS elsewhere FROM st",
    "guidance_rows": f"{_G} SELECT extraction_id, ordinal, row_number() OVER (PARTITION BY extraction_id, ordinal ORDER BY sequence_no) - 1 AS answer_order, segment_id, text FROM k SEMI JOIN (SELECT * FROM st WHERE state = 'registered') USING (extraction_id)",
}
QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
