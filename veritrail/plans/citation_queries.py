"""Citations over the derived registry, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions.forms import MARKED, PLAIN
from veritrail.operators import citations, ledger
from veritrail.plans.corpus import ctes, derived


def _texts(spark, d):
    (seg,) = derived(spark, d, "seg")
    return seg.select(F.col("segment_id").alias("text_id"), "text", "segment_type")


def q_mention_spans(spark, d):
    return citations.mentions(_texts(spark, d)).select("text_id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "normalized")


def q_announced_relations(spark, d):
    """Relations that verbs announce in operational segments."""
    texts = _texts(spark, d).where(citations.operational(F.col("segment_type"), F.col("text")))
    return citations.announced(citations.mentions(texts), citations.triggers(texts)).select("text_id", F.col("char_start").cast("long").alias("char_start"), "normalized", "relation_type")


def q_editorial_relations(spark, d):
    texts = _texts(spark, d).where(citations.may_note(F.col("text")))
    return citations.noted(texts, citations.mentions(texts)).select("text_id", F.col("char_start").cast("long").alias("char_start"), "normalized", "relation_type")


def _resolved(spark, d):
    doc, prov, mention, review = derived(spark, d, "doc", "prov", "mention", "review")
    key = F.concat_ws(":", F.lit("CO"), "document_type", F.col("number").cast("string"), F.col("year").cast("string"))
    asked = mention.select("mention_id", "mention_type", F.concat_ws(":", F.lit("CO"), "target_type", F.col("target_number").cast("string"), F.col("target_year").cast("string")).alias("target_key"), "target_issuer", "article")
    conflicts = review.where("status = 'open' AND entity_type = 'provision'").join(prov, F.col("entity_id") == F.col("provision_id")).select("document_id", "designation")
    return asked, doc.select("document_id", key.alias("key"), "issuer"), prov, conflicts


def q_reference_resolution(spark, d):
    return citations.resolve(*_resolved(spark, d))


def q_resolution_reasons(spark, d):
    return citations.resolve(*_resolved(spark, d)).groupBy("status", F.coalesce("reason", F.lit("-")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_late_reconciliation(spark, d):
    """Mentions that only documents of the last year could settle."""
    asked, documents, prov, conflicts = _resolved(spark, d)
    return citations.late(asked, documents.where(F.col("key").endswith(":2014")), prov, conflicts)


def _relations(spark, d):
    rel, res = derived(spark, d, "rel", "res")
    relations = rel.select(F.col("relation_id").alias("mention_id"), F.when(F.col("relation_id") % 19 != 0, F.col("source_id") % 1600 + 1).alias("source_document"), (F.col("source_id") % 12 + 1).cast("string").alias("source_article"), "relation_type", "confidence")
    resolutions = res.where("method IS NOT NULL").select("mention_id", "status", F.col("target_document_id").alias("document_id"), F.col("target_provision_id").alias("provision_id"), (F.col("mention_id") % 31 == 0).alias("review"), F.lit(0.9).alias("resolution_confidence"))
    return relations, resolutions


def q_operational_promotions(spark, d):
    (prov,) = derived(spark, d, "prov")
    return citations.promote_partial(*_relations(spark, d), prov, True).select("mention_id", "outcome", "source_provision", "target_document", "target_provision", F.round(F.col("confidence") * 100).cast("long").alias("confidence_e2"))


def q_editorial_promotions(spark, d):
    (prov,) = derived(spark, d, "prov")
    return citations.promote_partial(*_relations(spark, d), prov, False).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count("target_document").alias("n_document"))


def q_strict_promotions(spark, d):
    """All relations that strict promotion accepts together: those of wholly resolved, review-free provisions."""
    relations, resolutions = _relations(spark, d)
    whole = resolutions.where("status = 'resolved' AND provision_id IS NOT NULL AND NOT review")
    ready = relations.where("source_document IS NOT NULL").join(whole.select("mention_id").distinct(), "mention_id", "left_semi")
    return citations.promote_strict(ready, resolutions).select("mention_id", "source_document", "target_provision", F.round(F.col("confidence") * 100).cast("long").alias("confidence_e2"))


def q_endpoint_documents(spark, d):
    rel, prov = derived(spark, d, "rel", "prov")
    both = citations.owning_document(citations.owning_document(rel, "source", prov), "target", prov)
    return both.select("relation_id", "source_document", "target_document")


def q_document_edges(spark, d):
    rel, prov = derived(spark, d, "rel", "prov")
    return citations.touching(rel, prov).groupBy("document_id").agg(F.count(F.lit(1)).alias("edges"))


def q_reference_expansion(spark, d):
    """Documents that each benchmark question reaches in two steps from the document of its number, over resolved, review-free references."""
    res, ext, man = derived(spark, d, "res", "ext", "man")
    links = res.where("status = 'resolved' AND method IS NOT NULL AND target_document_id IS NOT NULL").select((F.floor(F.col("mention_id") / 10) % 1500).cast("long").alias("document_id"), F.col("target_document_id").alias("target")).distinct()
    seeds = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("question"), F.col("item_id").cast("long").alias("document_id"))
    return citations.expand(seeds, links).select("question", "document_id", F.col("depth").cast("long").alias("depth"))


def q_detection_runs(spark, d):
    """What one more job adds to a ledger that holds a third of the extractions, some of them by an older version."""
    (seg,) = derived(spark, d, "seg")
    held = seg.where("extraction_id % 3 = 0").select("extraction_id").distinct()
    version = F.when(F.col("extraction_id") % 5 == 0, "2").otherwise(ledger.VERSION)
    run = F.when(F.col("extraction_id") % 5 == 0, ledger.run_id(F.col("extraction_id"), version="2")).otherwise(ledger.run_id(F.col("extraction_id")))
    runs = held.select(run.alias("run_id"), "extraction_id", version.alias("version"))
    return ledger.detect(seg, runs)["runs"].select("extraction_id", "version", "mention_count", "relation_count")


_LOW = f"translate(lower(text), '{MARKED}', '{PLAIN}')"
_BY = r"(?: +(?:dian|banco +de +la +republica(?: +junta +directiva)?|presidencia(?: +de +la +republica)?|mincit|mincomercio|mintic|sgcan|dapr))?"
_NUMBER = r" +(?:(?:numero|no\.?|nro\.?) *)?[0-9]+[a-z]? +de +[0-9]{4}\b"
_ACTS = rf"\b(?:ley|decreto|resolucion|circular|concepto|oficio)(?: +unico(?: +reglamentario)?)?{_BY}{_NUMBER}"
_SCOPES = rf"\barticulos? +[0-9][0-9.\- ,;yº°o]*? +(?:del|de +la) +(?:ley|decreto|resolucion)(?: +unico(?: +reglamentario)?)?{_BY}{_NUMBER}"
_ISSUER = "CASE WHEN contains(raw, 'junta directiva') THEN 'BANREP_JD:' WHEN contains(raw, ' banco de') THEN 'BANREP:' WHEN contains(raw, ' dian ') THEN 'DIAN:' WHEN contains(raw, ' presidencia') THEN 'PRESIDENCIA:' WHEN contains(raw, ' mincomercio') OR contains(raw, ' mincit') THEN 'MINCIT:' WHEN contains(raw, ' mintic') THEN 'MINTIC:' ELSE '' END"
_WHOLE = f"{_ISSUER} || upper(regexp_extract(raw, '(ley|decreto|resolucion|circular|concepto|oficio) ', 1)) || ':' || regexp_extract(raw, ' ([0-9]+) +de +[0-9]{{4}}$', 1) || ':' || right(raw, 4)"


def _at(pattern: str, source: str, text: str, keep: str) -> str:
    """Matches of a pattern with their places, by what stands between them."""
    return f"SELECT {keep}, raw[i] AS raw, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(raw[1:i-1], lambda r: length(r))), 0) AS pos FROM (SELECT {keep}, raw, gaps, unnest(range(1, len(raw) + 1)) AS i FROM (SELECT {keep}, regexp_extract_all({text}, '{pattern}') AS raw, string_split_regex({text}, '{pattern}') AS gaps FROM {source}))"


_MENTIONS = f"""{{head}}, low AS (SELECT segment_id AS text_id, segment_type, {_LOW} AS low FROM seg), acts AS ({_at(_ACTS, 'low', 'low', 'text_id')}),
scopes AS ({_at(_SCOPES, 'low', 'low', 'text_id')}), listed AS (SELECT text_id, 'CO:' || {_WHOLE} AS target_key, pos + length(regexp_extract(raw, '^articulos? +', 0)) AS base, regexp_extract(raw, '^articulos? +([0-9][0-9.\\- ,;yº°o]*?) +(?:del|de +la) ', 1) AS nums FROM scopes),
tokens AS ({_at('[0-9]+', 'listed', 'nums', 'text_id, target_key, base')}),
mentions AS (SELECT DISTINCT text_id, CAST(pos AS BIGINT) AS char_start, CAST(pos + length(raw) AS BIGINT) AS char_end, 'CO:' || {_WHOLE} AS normalized, 'document' AS mention_type FROM acts UNION SELECT text_id, CAST(base + pos AS BIGINT), CAST(base + pos + length(raw) AS BIGINT), target_key || ':ART:' || raw, 'article' FROM tokens)"""
_M = _MENTIONS.replace("{head}", ctes("seg"))
_VERBS = "sustituyase|sustituyanse|sustituye|modifiquese|modifiquense|modifica|adicionese|adicionense|adiciona|deroguense|deroguese|deroga"
_NOTES = "<(?:articulo|paragrafo|numeral|inciso)[^<>]{0,160}? +(?:modificado|adicionado|derogado|sustituido) +por +[^<>]{1,700}?>"
_RES = f"""{ctes('doc', 'prov', 'mention', 'review')}, asked AS (SELECT *, 'CO:' || target_type || ':' || target_number || ':' || target_year AS target_key FROM mention), docs AS (SELECT document_id, issuer, 'CO:' || document_type || ':' || number || ':' || year AS key FROM doc),
one AS (SELECT mention_id, mention_type, article, target_key, count(DISTINCT document_id) FILTER (target_issuer IS NULL OR issuer = target_issuer) AS n_doc, min(document_id) FILTER (target_issuer IS NULL OR issuer = target_issuer) AS document_id FROM asked LEFT JOIN {{docs}} ON key = target_key GROUP BY ALL),
conflict AS (SELECT DISTINCT document_id, designation FROM review JOIN prov ON entity_id = provision_id WHERE status = 'open' AND entity_type = 'provision'),
held AS (SELECT document_id, designation, count(*) AS n_prov, min(provision_id) AS provision_id FROM prov GROUP BY ALL),
r AS (SELECT mention_id, mention_type, target_key, n_doc, one.document_id, provision_id,
 CASE WHEN n_doc = 0 THEN 'TARGET_DOCUMENT_NOT_FOUND' WHEN n_doc > 1 THEN 'AMBIGUOUS_DOCUMENT_ID' WHEN mention_type = 'document' THEN NULL WHEN article = '' THEN 'TARGET_PROVISION_NOT_FOUND' WHEN conflict.document_id IS NOT NULL THEN 'AMBIGUOUS_PROVISION_DESIGNATION' WHEN n_prov IS NULL THEN 'TARGET_PROVISION_NOT_FOUND' WHEN n_prov > 1 THEN 'AMBIGUOUS_PROVISION_DESIGNATION' END AS reason FROM one LEFT JOIN held ON held.document_id = one.document_id AND held.designation = article LEFT JOIN conflict ON conflict.document_id = one.document_id AND conflict.designation = article),
resolved AS (SELECT mention_id, target_key, CASE WHEN reason IS NULL THEN 'resolved' WHEN starts_with(reason, 'AMBIGUOUS') THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n_doc = 1 THEN document_id END AS document_id, CASE WHEN n_doc = 1 AND reason IS NULL AND mention_type <> 'document' THEN provision_id END AS provision_id, reason FROM r)"""
_REL = f"""{ctes('rel', 'res', 'prov')}, relations AS (SELECT relation_id AS mention_id, CASE WHEN relation_id % 19 <> 0 THEN source_id % 1600 + 1 END AS source_document, CAST(source_id % 12 + 1 AS STRING) AS source_article, confidence FROM rel),
resolutions AS (SELECT mention_id, status, target_document_id AS document_id, target_provision_id AS provision_id, mention_id % 31 = 0 AS review FROM res WHERE method IS NOT NULL), known AS (SELECT document_id AS source_document, designation AS source_article, count(*) AS n, min(provision_id) AS one FROM prov GROUP BY ALL),
promoted AS (SELECT mention_id, CASE WHEN source_document IS NULL THEN 'skipped_unbound' WHEN status IS DISTINCT FROM 'resolved' OR review THEN 'unresolved' WHEN coalesce(n, 0) <> 1 THEN 'review_source_provision' ELSE 'promoted' END AS outcome, one, document_id, provision_id, least(confidence, 0.9) AS confidence FROM relations {{kind}} JOIN resolutions USING (mention_id) LEFT JOIN known USING (source_document, source_article))"""
ORACLES = {
    "mention_spans": f"{_M} SELECT text_id, char_start, char_end, normalized FROM mentions",
    "announced_relations": f"""{_M}, acting AS (SELECT text_id, low FROM low WHERE segment_type = 'article' AND (contains(low, 'el presente decreto') OR regexp_matches(low, '\\b({_VERBS})\\b'))), verbs AS ({_at(f'\\b(?:{_VERBS})\\b', 'acting', 'low', 'text_id')}),
placed AS (SELECT m.*, coalesce(max(CASE WHEN mention_type = 'article' THEN char_end END) OVER (PARTITION BY text_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM mentions m JOIN acting USING (text_id))
SELECT DISTINCT text_id, char_start, normalized, CASE left(raw, 4) WHEN 'sust' THEN 'substitutes' WHEN 'modi' THEN 'modifies' WHEN 'adic' THEN 'adds' ELSE 'repeals' END AS relation_type FROM placed JOIN verbs USING (text_id) WHERE pos < char_start AND pos >= CASE WHEN b <= char_start THEN b ELSE 0 END""",
    "editorial_relations": f"{_M}, notes AS ({_at(_NOTES, 'low', 'low', 'text_id')}) SELECT text_id, char_start, normalized, CASE regexp_extract(raw, '(modificado|adicionado|derogado|sustituido) +por', 1) WHEN 'modificado' THEN 'modified_by' WHEN 'adicionado' THEN 'added_by' WHEN 'derogado' THEN 'repealed_by' ELSE 'substituted_by' END AS relation_type FROM mentions JOIN notes USING (text_id) WHERE char_start >= pos AND char_end <= pos + length(raw)",
    "reference_resolution": f"{_RES.replace('{docs}', 'docs')} SELECT mention_id, status, document_id, provision_id, reason FROM resolved",
    "resolution_reasons": f"{_RES.replace('{docs}', 'docs')} SELECT status, coalesce(reason, '-') AS reason, count(*) AS n FROM resolved GROUP BY ALL",
    "late_reconciliation": f"{_RES.replace('{docs}', '(SELECT * FROM docs WHERE year_of(key))').replace('year_of(key)', 'key LIKE $$%:2014$$')} SELECT mention_id, status, document_id, provision_id, reason FROM resolved WHERE target_key IN (SELECT key FROM docs WHERE key LIKE '%:2014')",
    "operational_promotions": f"{_REL.replace('{kind}', 'LEFT')} SELECT mention_id, outcome, CASE WHEN outcome = 'promoted' THEN one END AS source_provision, CASE WHEN outcome = 'promoted' THEN document_id END AS target_document, CASE WHEN outcome = 'promoted' THEN provision_id END AS target_provision, CASE WHEN outcome = 'promoted' THEN CAST(round(confidence * 100) AS BIGINT) END AS confidence_e2 FROM promoted",
    "editorial_promotions": f"{_REL.replace('{kind}', '')} SELECT outcome, count(*) AS n, count(CASE WHEN outcome = 'promoted' THEN document_id END) AS n_document FROM promoted GROUP BY outcome",
    "strict_promotions": f"{_REL.replace('{kind}', '')} SELECT mention_id, source_document, provision_id AS target_provision, CAST(round(least(confidence, 0.9) * 100) AS BIGINT) AS confidence_e2 FROM relations JOIN resolutions USING (mention_id) WHERE source_document IS NOT NULL AND status = 'resolved' AND provision_id IS NOT NULL AND NOT review",
    "endpoint_documents": f"{ctes('rel', 'prov')} SELECT relation_id, CASE source_type WHEN 'document' THEN source_id WHEN 'provision' THEN p.document_id END AS source_document, CASE target_type WHEN 'document' THEN target_id WHEN 'provision' THEN q.document_id END AS target_document FROM rel LEFT JOIN prov p ON source_id = p.provision_id LEFT JOIN prov q ON target_id = q.provision_id",
    "document_edges": f"{ctes('rel', 'prov')}, e AS (SELECT relation_id, CASE source_type WHEN 'document' THEN source_id WHEN 'provision' THEN p.document_id END AS a, CASE target_type WHEN 'document' THEN target_id WHEN 'provision' THEN q.document_id END AS b FROM rel LEFT JOIN prov p ON source_id = p.provision_id LEFT JOIN prov q ON target_id = q.provision_id) SELECT document_id, count(DISTINCT relation_id) AS edges FROM (SELECT a AS document_id, relation_id FROM e UNION ALL SELECT b, relation_id FROM e) WHERE document_id IS NOT NULL GROUP BY document_id",
    "reference_expansion": f"{ctes('res').replace('WITH', 'WITH RECURSIVE')}, links AS (SELECT DISTINCT CAST(floor(mention_id / 10) % 1500 AS BIGINT) AS document_id, target_document_id AS target FROM res WHERE status = 'resolved' AND method IS NOT NULL AND target_document_id IS NOT NULL), walk AS (SELECT item_id AS question, CAST(item_id AS BIGINT) AS document_id, 0 AS depth FROM benchmark UNION SELECT question, target, depth + 1 FROM walk JOIN links USING (document_id) WHERE depth < 2) SELECT question, document_id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY ALL",
}
_RUNS = ORACLES["announced_relations"].replace("SELECT DISTINCT text_id, char_start, normalized, CASE left", ", said AS (SELECT DISTINCT text_id, char_start, normalized, CASE left") + ")"
_NOTED = f", notes AS ({_at(_NOTES, 'low', 'low', 'text_id')}), noted AS (SELECT text_id, char_start, normalized, CASE regexp_extract(raw, '(modificado|adicionado|derogado|sustituido) +por', 1) WHEN 'modificado' THEN 'modified_by' WHEN 'adicionado' THEN 'added_by' WHEN 'derogado' THEN 'repealed_by' ELSE 'substituted_by' END AS relation_type FROM mentions JOIN notes USING (text_id) WHERE mention_type = 'article' AND char_start >= pos AND char_end <= pos + length(raw))"
ORACLES["detection_runs"] = f"""{_RUNS}{_NOTED}, todo AS (SELECT DISTINCT extraction_id FROM seg WHERE NOT (extraction_id % 3 = 0 AND extraction_id % 5 <> 0)), mc AS (SELECT extraction_id, count(*) AS n FROM mentions JOIN seg ON text_id = segment_id GROUP BY 1), rc AS (SELECT extraction_id, count(*) AS n FROM (SELECT * FROM said UNION SELECT * FROM noted) JOIN seg ON text_id = segment_id GROUP BY 1)
SELECT extraction_id, '3' AS version, coalesce(mc.n, 0) AS mention_count, coalesce(rc.n, 0) AS relation_count FROM todo LEFT JOIN mc USING (extraction_id) LEFT JOIN rc USING (extraction_id)"""
QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
