"""A document registry derived from the given tables, in SQL that Spark and DuckDB both read.

Each row of the given tables becomes a document, a manifestation, an
extraction, a segment with Spanish legal wording, a provision, a mention and so
on, so that all tables grow with the data; keys clash, point nowhere or
disagree in a part of the rows, as they do in a registry that needs audits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from veritrail.sources.shared import written

_MONTH = "split_part('enero,febrero,marzo,abril,mayo,junio,julio,agosto,septiembre,octubre,noviembre,diciembre', ',', CAST(1 + {0} % 12 AS INT))"
_S = "CAST({0} AS STRING)"


def _s(x: str) -> str:
    return _S.format(x)


_TYPE_NAME = "CASE {0} % 4 WHEN 0 THEN 'Ley' WHEN 1 THEN 'Decreto' WHEN 2 THEN 'Resolución' ELSE 'Circular' END"
#: Issuers as citations of resolutions name them.
_BY = "CASE WHEN {0} % 4 <> 2 THEN '' ELSE CASE {1} % 7 WHEN 0 THEN ' DIAN' WHEN 1 THEN ' Banco de la República' WHEN 2 THEN ' Banco de la República Junta Directiva' WHEN 3 THEN ' Presidencia de la República' WHEN 4 THEN ' MinComercio' WHEN 5 THEN ' MinTIC No.' ELSE '' END END"
_ACT = f"{_TYPE_NAME.format('l_partkey')} || {_BY.format('l_partkey', 'l_suppkey')} || ' ' || {_s('l_partkey % 97 + 1')} || ' de ' || {_s('1990 + l_suppkey % 25')}"
_ACT2 = f"{_TYPE_NAME.format('l_suppkey')} || {_BY.format('l_suppkey', 'l_partkey')} || ' ' || {_s('l_suppkey % 97 + 1')} || ' de ' || {_s('1990 + l_partkey % 25')}"
_DATE = f"{_s('1 + l_partkey % 28')} de {{0}} de {{1}}"

#: Derived tables in order: a table reads given tables and those before it.
TABLES = {
    "line": """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_discount) AS l_discount FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "doc": """SELECT c_custkey AS document_id, CASE c_custkey % 4 WHEN 0 THEN 'LEY' WHEN 1 THEN 'DECRETO' WHEN 2 THEN 'RESOLUCION' ELSE 'CIRCULAR' END AS document_type,
 c_custkey % 97 + 1 AS number, 1990 + c_nationkey AS year, CASE WHEN c_custkey % 4 >= 2 THEN CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'MINHACIENDA' ELSE 'DIAN' END END AS issuer, c_name AS title FROM customer""",
    "ident": f"""SELECT document_id * 10 AS identifier_id, document_id, 'primary' AS identifier_type, CASE WHEN document_id % 13 = 0 THEN 'CO:' || document_type ELSE 'CO:' || coalesce(issuer || ':', '') || document_type || ':' || {_s('number')} || ':' || {_s('year')} END AS identifier_value FROM doc
 UNION ALL SELECT document_id * 10 + 1, document_id, 'alias', 'CO:' || document_type || ':' || {_s('number')} || ':' || {_s('year')} FROM doc WHERE document_id % 3 = 0""",
    "src": f"""SELECT s_suppkey AS source_id, CASE s_suppkey % 3 WHEN 0 THEN 'https://normograma.example.com/normograma/docs/decreto_' WHEN 1 THEN 'https://www.example.org/docs/ley_' ELSE 'https://blog.example.net/nota_' END || {_s('s_suppkey')} || '.htm' AS source_url FROM supplier""",
    "man": f"""SELECT o_orderkey AS manifestation_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS document_id, 1 + o_custkey % 120 AS source_id, md5({_s('o_orderkey % 5000')}) AS sha256,
 CASE WHEN o_orderkey % 17 = 0 THEN 'raw/' ELSE 'raw/sha256/' || substr(md5({_s('o_orderkey % 5000')}), 1, 2) || '/' END || md5({_s('o_orderkey % 5000')}) AS local_path, o_orderkey % 5000 AS byte_size, o_orderdate AS retrieved_at FROM orders""",
    "ext": """SELECT o_orderkey AS extraction_id, o_orderkey - o_orderkey % 2 AS manifestation_id, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'success' END AS status, o_orderdate AS created_at, o_custkey % 7 AS segment_count FROM orders""",
    "seg": f"""SELECT *, CASE WHEN segment_id % 53 = 0 THEN md5('x') ELSE md5(text) END AS text_hash,
 substr(max(CASE WHEN segment_type IN ('document_heading', 'article', 'section_heading') THEN {_s('100 + sequence_no')} || substr(text, 1, 500) END) OVER (PARTITION BY extraction_id ORDER BY sequence_no), 4) AS section_path FROM (SELECT l_orderkey * 10 + l_linenumber AS segment_id, l_orderkey AS extraction_id, l_linenumber AS sequence_no,
 CASE (l_suppkey + l_linenumber) % 7 WHEN 0 THEN 'article' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'editorial_note' WHEN 3 THEN 'article' WHEN 4 THEN 'document_heading' WHEN 5 THEN 'closing' ELSE 'section_heading' END AS segment_type,
 CASE (l_suppkey + l_linenumber) % 7 WHEN 0 THEN 'ARTÍCULO ' || {_s('l_partkey % 30 + 1')} || '. DISPOSICIONES VARIAS. Modifíquese el artículo ' || {_s('l_partkey % 12 + 1')} || ' de la ' || {_ACT} || '. Deróguese la ' || {_ACT2} || '.'
 WHEN 1 THEN 'Que según los artículos ' || {_s('l_partkey % 9 + 1')} || ', ' || {_s('l_partkey % 9 + 2')} || ' y ' || {_s('l_partkey % 9 + 4')} || ' de la ' || {_ACT} || ', y conforme al ' || {_ACT2} || ', procede.'
 WHEN 2 THEN '<Artículo modificado por el artículo ' || {_s('l_suppkey % 12 + 1')} || ' de la ' || {_ACT} || '> Texto vigente.'
 WHEN 3 THEN 'ARTÍCULO ' || {_s('l_partkey % 30 + 1')} || '. Vigencia. La presente ' || {_ACT2} || CASE WHEN l_partkey % 5 = 0 THEN ' rige a partir del 1 de enero de 2030' ELSE ' rige a partir de la fecha de su publicación en el Diario Oficial' END || ' y no podrá exceder de ' || {_s('l_partkey % 9 + 1')} || '.' || {_s('l_suppkey % 900 + 100')} || ' UVT; ni ser inferior a ' || {_s('l_suppkey % 90')} || ',5 UVT.'
 WHEN 4 THEN CASE WHEN l_suppkey % 13 = 0 THEN 'Notas de Vigencia. ' WHEN l_suppkey % 11 = 0 THEN 'Ley 5 de 1990. ' ELSE '' END || 'Diario Oficial No. 50.' || {_s('l_suppkey % 900 + 100')} || ' de ' || {_s('1 + l_partkey % 31')} || ' de ' || CASE WHEN l_partkey % 2 = 0 THEN replace({_MONTH.format('l_suppkey')}, 'sept', 'set') ELSE {_MONTH.format('l_suppkey')} END || ' de ' || {_s('1990 + l_partkey % 25')}
 WHEN 5 THEN 'PUBLÍQUESE Y CÚMPLASE. ' || CASE WHEN l_suppkey % 2 = 0 THEN 'Dado en Bogotá, D. C., a ' ELSE 'Dada en Medellín, ' END || {_s('1 + l_suppkey % 31')} || ' de ' || {_MONTH.format('l_partkey')} || ' de ' || {_s('1990 + l_suppkey % 25')} || '.'
 ELSE 'CAPÍTULO ' || {_s('l_linenumber')} END AS text FROM line) AS plain""",
    "prov": f"""SELECT p_partkey AS provision_id, 1 + p_partkey % 1600 AS document_id, {_s('p_size % 12 + 1')} AS designation FROM part""",
    "obs": """SELECT l_orderkey * 10 + l_linenumber AS observation_id, l_partkey AS provision_id, l_orderkey - CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 0 END AS extraction_id, l_orderkey * 10 + l_linenumber AS segment_id, md5(CAST(l_returnflag AS STRING)) AS text_hash FROM line""",
    "mention": f"""SELECT l_orderkey * 10 + l_linenumber AS mention_id, l_orderkey * 10 + l_linenumber - CASE WHEN l_partkey % 23 = 0 THEN 100000000 ELSE 0 END AS segment_id, CASE WHEN l_suppkey % 3 = 0 THEN 'document' ELSE 'article' END AS mention_type,
 CASE l_partkey % 4 WHEN 0 THEN 'LEY' WHEN 1 THEN 'DECRETO' WHEN 2 THEN 'RESOLUCION' ELSE 'CIRCULAR' END AS target_type, l_partkey % 97 + 1 AS target_number, 1990 + l_suppkey % 25 AS target_year, CASE WHEN l_suppkey % 7 = 0 THEN 'DIAN' END AS target_issuer,
 CASE WHEN l_suppkey % 29 = 0 THEN '' ELSE {_s('l_suppkey % 14 + 1')} END AS article, l_linestatus = 'O' AND l_partkey % 31 = 0 AS review FROM line""",
    "rel": """SELECT l_orderkey * 10 + l_linenumber AS relation_id, CASE l_linenumber % 2 WHEN 0 THEN 'document' ELSE 'provision' END AS source_type, CASE l_linenumber % 2 WHEN 0 THEN l_suppkey ELSE l_partkey END AS source_id,
 CASE WHEN l_linenumber % 3 = 0 THEN 'provision' WHEN l_linenumber = 7 THEN 'topic' ELSE 'document' END AS target_type, l_partkey + CASE WHEN l_suppkey % 41 = 0 THEN 100000000 ELSE 0 END AS target_id,
 CASE l_partkey % 15 WHEN 0 THEN 'modifies' WHEN 1 THEN 'repeals' WHEN 2 THEN 'adds' WHEN 3 THEN 'conflicts_with' WHEN 4 THEN 'cites' WHEN 5 THEN 'Modified-By' WHEN 6 THEN 'repealed_by' WHEN 7 THEN ' Supersedes ' WHEN 8 THEN 'excepted by' WHEN 9 THEN 'defines' WHEN 10 THEN 'inconsistent_with' WHEN 11 THEN 'suspends' WHEN 12 THEN 'annuls' WHEN 13 THEN 'replaces' ELSE 'amends' END AS relation_type, CASE l_returnflag WHEN 'R' THEN 'candidate' ELSE 'validated' END AS status, CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS evidence_id, l_discount * 10 AS confidence FROM line""",
    "evid": """SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_orderkey * 10 + l_linenumber AS segment_id, l_orderkey - l_orderkey % 2 + CASE WHEN l_suppkey % 43 = 0 THEN 1 ELSE 0 END AS manifestation_id, md5(CAST(l_orderkey % 5000 AS STRING)) AS source_sha256, CASE WHEN l_linenumber % 3 = 0 THEN 'claim' ELSE 'relation' END AS owner_type, l_orderkey * 10 + l_linenumber AS owner_id FROM line""",
    "event": """SELECT e.event_id, 1 + e.user_id % 1500 AS document_id, CASE e.event_type WHEN 'click' THEN 'issued' WHEN 'view' THEN 'published' WHEN 'signup' THEN 'enters_into_force' WHEN 'purchase' THEN 'modified' ELSE 'repealed' END AS event_type, CAST(e.ts AS DATE) AS event_date, CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE CAST(e.ts AS DATE) END AS effective_from, e.event_id % 9 = 0 AS review FROM events e""",
    "files": f"""SELECT DISTINCT 'raw/sha256/' || substr(md5({_s('n')}), 1, 2) || '/' || md5({_s('n')}) AS path, n + CASE WHEN n % 14 = 0 THEN 1 ELSE 0 END AS byte_size, CASE WHEN n % 22 = 0 THEN md5('x') ELSE md5({_s('n')}) END AS content_hash FROM (SELECT o_orderkey % 5000 AS n FROM orders) AS counted WHERE n % 12 <> 0""",
    "res": """SELECT l_orderkey * 10 + l_linenumber AS mention_id, CASE l_suppkey % 6 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN l_suppkey % 6 >= 2 AND l_partkey % 11 <> 0 THEN l_partkey % 1500 END AS target_document_id, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS target_provision_id,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE 'exact' END AS method, CASE WHEN l_suppkey % 6 < 2 AND l_partkey % 13 <> 0 THEN 'TARGET_DOCUMENT_NOT_FOUND' END AS reason FROM line""",
    "review": """SELECT o_orderkey AS review_id, CASE o_custkey % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'provision' WHEN 2 THEN 'mention' ELSE 'note' END AS entity_type, o_custkey + CASE WHEN o_orderkey % 47 = 0 THEN 100000000 ELSE 0 END AS entity_id, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status FROM orders""",
    "recorded": """SELECT document_id, event_type, count(*) + CASE WHEN document_id % 37 = 0 THEN 1 ELSE 0 END AS n, coalesce(sum(CASE WHEN review THEN 1 ELSE 0 END), 0) AS n_review FROM event GROUP BY document_id, event_type""",
    "fts": """SELECT segment_id, extraction_id, text FROM seg WHERE segment_id % 97 <> 0 UNION ALL SELECT -o_orderkey, o_orderkey, 'stray' FROM orders WHERE o_orderkey % 101 = 0""",
}
GIVEN = ("customer", "supplier", "orders", "lineitem", "part", "events")


def _needs(name: str) -> list[str]:
    """A derived table and those that it reads, in order."""
    inner = [t for t in TABLES if t != name and re.search(rf"\bFROM {t}\b", TABLES[name])]
    return [*dict.fromkeys(x for t in inner for x in _needs(t)), name]


def derived(spark: SparkSession, sf_dir: str, *names: str, once: bool = False) -> tuple[DataFrame, ...]:
    """Derived tables as DataFrames; ``once``: lines are written, for queries that read several tables of them and no texts."""
    made: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in GIVEN}
    for t in dict.fromkeys(x for n in names for x in _needs(n)):
        reads = {r: made[r] for r in (*GIVEN, *TABLES) if r in made and re.search(rf"\bFROM {r}\b", TABLES[t])}
        text = TABLES[t]
        if t == "line":
            # By order from the start: rows of an extraction then lie together, and no text moves to be numbered, summed or joined by it.
            reads["lineitem"] = reads["lineitem"].repartition("l_orderkey")
        for r in reads:
            text = re.sub(rf"\bFROM {r}\b", f"FROM {{{r}}}", text)
        made[t] = spark.sql(text, **reads)
        if t == "line" and once:
            made[t] = written(made[t], "lines")
    return tuple(made[n] for n in names)


def ctes(*names: str) -> str:
    """The same tables as the head of a DuckDB query: ``WITH doc AS (…), …``."""
    needed = dict.fromkeys(x for n in names for x in _needs(n))
    return "WITH " + ", ".join(f"{t} AS ({TABLES[t]})" for t in needed)
