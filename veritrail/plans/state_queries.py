"""Identity, dates, coverage, schedules and snapshots over the derived registry, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import forms, text
from veritrail.operators import citations, coverage, merge, queue, registry, research, temporal
from veritrail.plans.corpus import ctes, derived
from veritrail.plans.form_queries import FAMILY_SQL

NOW = "2024-02-01 00:00:00"


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def q_first_identifiers(spark, d):
    (ident,) = derived(spark, d, "ident")
    return registry.first_identifier(ident)


def q_segment_provenance(spark, d):
    out = registry.provenance(*derived(spark, d, "seg", "ext", "man", "src", "doc"))
    return out.select("segment_id", "manifestation_id", "source_url", "document_id", "title")


def q_document_sources(spark, d):
    man, src = derived(spark, d, "man", "src")
    return registry.sources_of(man, src).select("document_id", "manifestations", F.size("sources").cast("long").alias("sources"), F.md5(F.array_join("sources", "|")).alias("digest"))


def q_generic_identity(spark, d):
    man, src, doc = derived(spark, d, "man", "src", "doc")
    family = F.nullif(F.upper(F.regexp_extract("source_url", "/(ley|decreto)_[0-9]+", 1)), F.lit(""))
    met = man.join(src, "source_id").join(doc, "document_id", "left")
    state = registry.identity(family, F.lit(None).cast("long"), F.lit(None).cast("long"), F.col("document_type"), F.col("number"), F.col("year"), F.col("issuer"), F.col("document_type").isin("RESOLUCION", "CIRCULAR"))
    return met.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def q_family_identity(spark, d):
    (seg,) = derived(spark, d, "seg")
    c = seg.select(F.col("extraction_id").alias("document"), (F.col("sequence_no") * 3).alias("sequence_no"), F.when(F.col("segment_type") == "document_heading", F.left("text", F.lit(45))).alias("heading"), F.when(F.col("segment_type") == "document_heading", F.col("segment_id") % 3 > 0).alias("compatible"))
    return registry.family_identity(c)


def q_equivalent_keys(spark, d):
    (doc,) = derived(spark, d, "doc")
    padded = F.concat(F.when(F.col("document_id") % 6 == 0, "00").otherwise(""), F.col("number").cast("string"))
    out = registry.equivalent_keys(doc.select("document_id", "document_type", padded.alias("number"), "year", "issuer"))
    return out.select("document_id", "representative", "copies", F.array_join(F.transform("compatible", lambda x: x.cast("string")), ",").alias("compatible"))


def q_issuer_split(spark, d):
    doc, man = derived(spark, d, "doc", "man")
    claims = doc.select("document_id", F.col("issuer").alias("own_issuer")).join(man.select("document_id", F.when(F.col("source_id") % 40 == 0, "MINHACIENDA").when(F.col("source_id") % 3 > 0, "DIAN").alias("issuer")), "document_id")
    return registry.issuer_split(claims)


def q_provision_index(spark, d):
    prov, obs = derived(spark, d, "prov", "obs")
    return registry.provision_index(prov, obs).select("provision_id", "designation", "observations", "texts", "extractions")


def q_designation_counts(spark, d):
    (prov,) = derived(spark, d, "prov")
    return prov.groupBy("document_id", "designation").agg(F.count(F.lit(1)).alias("n"))


def q_exact_lookup(spark, d):
    rel, doc, prov = derived(spark, d, "rel", "doc", "prov")
    return registry.exact_lookup(rel.select(F.col("relation_id").alias("ref"), F.col("target_type").alias("kind"), F.col("target_id").alias("id")), doc, prov)


def q_segment_provisions(spark, d):
    obs, seg = derived(spark, d, "obs", "seg")
    return registry.provision_for_segment(obs, seg)


def q_boundaries(spark, d):
    (seg,) = derived(spark, d, "seg")
    return registry.boundaries(seg).select("extraction_id", F.col("first_article").cast("long").alias("first_article"), "segments")


def q_main_headings(spark, d):
    (seg,) = derived(spark, d, "seg")
    return registry.main_heading(seg, text.uppercase_ratio(F.col("text")), F.col("segment_type").isin("section_heading", "document_heading"))


def q_paired_rows(spark, d):
    (seg,) = derived(spark, d, "seg")
    return registry.paired_rows(seg, F.col("segment_type").isin("section_heading", "document_heading"))


def _roles(spark, d):
    seg, ext, man = derived(spark, d, "seg", "ext", "man")
    found = registry.date_candidates(seg).join(ext.select("extraction_id", "manifestation_id"), "extraction_id").join(man.select("manifestation_id", F.col("document_id").alias("document")), "manifestation_id").where("document IS NOT NULL")
    return found, temporal.resolve_roles(found.select("document", "role", "value", "is_trusted"))


def q_date_candidates(spark, d):
    (seg,) = derived(spark, d, "seg")
    return registry.date_candidates(seg).select("segment_id", "role", "value", "is_trusted", "context")


def q_temporal_roles(spark, d):
    return _roles(spark, d)[1]


def q_promoted_events(spark, d):
    return registry.promoted_events(_roles(spark, d)[1])


def q_superseded_events(spark, d):
    (event,) = derived(spark, d, "event")
    new = event.where("event_id % 5 = 0").select(F.col("document_id").alias("document"), "event_type", "event_date")
    return registry.superseded(event.where("event_id % 5 <> 0").select("event_id", "document_id", "event_type", "event_date"), new).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_relation_dates(spark, d):
    rel, prov, event = derived(spark, d, "rel", "prov", "event")
    own = citations.owning_document(rel, "source", prov).withColumn("relation_type", F.when(F.col("relation_id") % 4 == 0, F.concat("relation_type", F.lit("_by"))).otherwise(F.col("relation_type")))
    dates = event.groupBy(F.col("document_id").alias("document")).agg(F.min(F.when(F.col("event_type") == "issued", F.col("event_date"))).alias("issued"), F.min(F.when(F.col("event_type") == "enters_into_force", F.col("event_date"))).alias("in_force"))
    return registry.relation_dates(own, dates)


def _trace(spark, d):
    li = _table(spark, d, "lineitem")
    outcome = F.when(F.col("l_quantity") < 2, "blocked").when(F.col("l_quantity") < 6, "budget_exhausted").when(F.col("l_tax") > 0.06, "no_hits").otherwise("hits")
    return li.select(
        F.col("l_orderkey").alias("aspect"), F.col("l_linenumber").alias("task"), F.col("l_partkey").alias("round"), outcome.alias("outcome"),
        F.when(F.col("l_discount") > 0.09, "incomplete").when(F.col("l_discount") > 0.02, "ready").alias("context_status"),
        F.when(F.col("l_suppkey") % 31 == 0, "conflicting").when(F.col("l_suppkey") % 23 == 0, "ambiguous").when(F.col("l_suppkey") % 13 == 0, "partial").when(F.col("l_suppkey") % 4 > 0, "resolved").alias("authority_status"),
        F.when(F.col("l_partkey") % 41 == 0, "ambiguous").when(F.col("l_partkey") % 3 > 0, "effective_as_of").when(F.col("l_partkey") % 9 == 0, "not_effective").alias("temporal_status"),
        F.when(F.col("l_partkey") % 17 == 0, "missing").when(F.col("l_partkey") % 29 == 0, "ambiguous").when(F.col("l_partkey") % 5 == 0, "sufficient").alias("fact_state"),
    )


def _ledger(spark, d):
    rows = _trace(spark, d)
    return coverage.ledger(rows, research.execution_status(rows.select("aspect", "task", "round", "outcome"), "aspect", "task"))


def q_coverage_ledger(spark, d):
    return coverage.limitation_codes(_ledger(spark, d))


def q_research_status(spark, d):
    return coverage.result_status(_ledger(spark, d).withColumn("question", F.col("aspect") % 977), "question")


def q_omissions(spark, d):
    rows = _trace(spark, d).select((F.col("aspect") * 10 + F.col("task")).alias("task"), "round", F.when(F.col("round") % 7 > 0, F.col("outcome")).alias("outcome"))
    planned = _table(spark, d, "orders").select((F.col("o_orderkey") * 10 + 1).alias("task"))
    return coverage.omissions(planned, rows)


def q_relation_relevance(spark, d):
    rel, prov = derived(spark, d, "rel", "prov")
    edges = citations.owning_document(citations.owning_document(rel, "source", prov), "target", prov).withColumn("family", forms.relation_family(F.col("relation_type")))
    chosen = _table(spark, d, "part").select(F.when(F.col("p_size") < 5, F.col("p_partkey") % 1600 + 1).alias("document_id"), F.when(F.col("p_size") == 7, F.col("p_partkey")).alias("provision_id"))
    return coverage.relevance(edges, prov, chosen)


def q_task_schedule(spark, d):
    tasks = _table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("question"), (F.col("l_partkey") % 20).alias("aspect"), F.col("l_orderkey").alias("task")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("lane"))
    return coverage.schedule(tasks).groupBy("lane", "round", "turn").agg(F.count(F.lit(1)).alias("n"), F.min("task").alias("first_task"))


def q_profile_matches(spark, d):
    questions = _table(spark, d, "documents").select(F.col("doc_id").alias("question"), text.tokens(F.col("text")).alias("terms"))
    profiles = _table(spark, d, "benchmark").select(F.col("item_id").alias("profile"), F.slice(text.query_terms(F.col("text")), 1, 3).alias("terms")).where(F.size("terms") > 0)
    return coverage.profile_matches(questions, profiles)


def q_merged_candidates(spark, d):
    li = _table(spark, d, "lineitem").select(F.col("l_partkey").alias("segment"), (F.col("l_suppkey") % 40).alias("query"), F.col("l_linenumber").alias("task"))
    return coverage.merged_candidates(li).select("segment", F.array_join(F.transform("queries", lambda x: x.cast("string")), ",").alias("queries"), F.array_join(F.transform("tasks", lambda x: x.cast("string")), ",").alias("tasks"))


def q_overflowing(spark, d):
    li = _table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return coverage.with_overflow(li, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 10).select("o_custkey", "o_orderkey", "overflow")


def q_recent_errors(spark, d):
    return _table(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "user_id")


def q_event_settings(spark, d):
    """Settings read from JSON, with those that are no such object."""
    parsed = F.from_json("props", "k int")
    return _table(spark, d, "events").select("event_id", parsed["k"].cast("long").alias("k"), parsed["k"].isNull().alias("invalid"))


def q_deletions(spark, d):
    """What three delete rules do to orders when every ninth customer leaves."""
    orders, customers = _table(spark, d, "orders").select("o_orderkey", "o_custkey"), _table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    stay, leave = customers.where("o_custkey % 9 <> 0"), customers.where("o_custkey % 9 = 0")
    kept, nulled, named = merge.cascade(orders, stay, "o_custkey"), merge.set_null(orders, stay, "o_custkey"), merge.restricted(orders, leave, "o_custkey")
    one = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n"), F.count("o_custkey").alias("with_key")).select(F.lit(rule).alias("rule"), "n", "with_key")
    return one(kept, "cascade").unionAll(one(nulled, "set_null")).unionAll(one(named, "restrict"))


def q_rule_violations(spark, d):
    (res,) = derived(spark, d, "res")
    resolved = F.col("status") == "resolved"
    return merge.violations(res, "mention_id", {"known_status": F.col("status").isin("resolved", "ambiguous", "unresolved"), "resolved_has_target": resolved == F.col("target_document_id").isNotNull(), "reason_unless_resolved": resolved != F.col("reason").isNotNull()})


def q_drift_plan(spark, d):
    seg, fts = derived(spark, d, "seg", "fts")
    return merge.drift(fts.select("segment_id", F.md5("text").alias("h")), seg.select("segment_id", F.col("text_hash").alias("h")), "segment_id", "h")


def q_state_delta(spark, d):
    rel, res = derived(spark, d, "rel", "res")
    return merge.delta(res.select("status"), res.select(F.when(F.col("mention_id") % 5 == 0, "resolved").otherwise(F.col("status")).alias("status")), "status")


def q_new_rows_guarded(spark, d):
    """Documents that a second, identical delivery with some more rows adds."""
    doc = derived(spark, d, "doc")[0].select("document_id", "title")
    more = doc.unionByName(_table(spark, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("document_id"), F.col("s_name").alias("title")))
    return merge.refuse_differing(doc, more, "document_id", "title")


def _queue(spark, d):
    e = _table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "done").otherwise("pending")
    return e.select(F.concat(F.when(F.col("event_id") % 4 == 0, "https://a.example/").otherwise("https://b.example/"), F.col("event_id").cast("string")).alias("url"), F.when(F.col("event_id") % 10 == 0, "index").otherwise("document").alias("item_type"), (F.col("user_id") % 4).alias("depth"), status.alias("status"), (F.col("user_id") % 3).alias("attempts"), F.col("ts").alias("due"), F.col("ts").alias("first_seen"), F.col("ts").alias("started"))


def q_queue_claim(spark, d):
    out = queue.claim(_queue(spark, d), F.lit(NOW).cast("timestamp"), 200)
    return out.groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n"))


def q_queue_rearm(spark, d):
    return queue.rearm(_queue(spark, d)).select("url", F.unix_timestamp("due").alias("due"))


def q_queue_scope(spark, d):
    return queue.in_scope(_queue(spark, d), "://a.example/").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_enqueue(spark, d):
    """Links of events that the queue lacks, at their least depth."""
    found = _table(spark, d, "events").select(F.concat(F.lit("https://a.example/"), (F.col("event_id") + 4 - F.col("user_id") % 9).cast("string")).alias("url"), (F.col("user_id") % 5).alias("depth"), F.col("event_id").alias("parent"))
    return queue.enqueue(_queue(spark, d), found)


_MARKS = "NOTAS? DE VIGENCIA|NOTA: VIGENCIA|MODIFICAD[OA] POR|DEROGAD[OA] POR|ADICIONAD[OA] POR|JURISPRUDENCIA|CONCORDANCIA"
_DAY = "[0-9]{1,2} de [a-z]+ de [0-9]{4}"
_FOUND = "SELECT *, '{0}' AS role, unnest(regexp_extract_all(low, '{1}')) AS quote FROM p"
_MONTH_NO = "list_position(['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'], replace(split_part(d, ' ', 3), 'setiembre', 'septiembre'))"
_ROLE = f"""{{head}}, low AS (SELECT *, strip_accents(lower(text)) AS low, upper(strip_accents(coalesce(section_path, ''))) AS path, upper(strip_accents(text)) AS key FROM seg),
b AS (SELECT extraction_id, coalesce(min(sequence_no) FILTER (segment_type = 'article'), count(*) + 1) AS first_article FROM seg GROUP BY extraction_id),
p AS (SELECT low.*, first_article, bool_or(segment_type = 'closing') OVER (PARTITION BY low.extraction_id ORDER BY sequence_no RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS closing, regexp_matches(low, '\\b(ley|decreto|resolucion|circular|sentencia|concepto|oficio)\\s+(numero\\s+)?[a-z0-9._/-]+(\\s+de\\s+[0-9]{{4}})?\\b') AS cites FROM low JOIN b USING (extraction_id)),
f AS ({_FOUND.format('publication', f'diario oficial no[.]? *[0-9.]+ de {_DAY}')} UNION ALL {_FOUND.format('issued', f'dad[oa] en .+?, *(?:a )?{_DAY}')} UNION ALL {_FOUND.format('commencement', 'rige a partir de la fecha de su publicacion(?: en el diario oficial)?')}),
g AS (SELECT *, regexp_extract(quote, '{_DAY}$') AS d FROM f),
c AS (SELECT segment_id, extraction_id, role, try_cast(split_part(d, ' ', 5) || '-' || lpad(CAST({_MONTH_NO} AS STRING), 2, '0') || '-' || lpad(split_part(d, ' ', 1), 2, '0') AS DATE) AS value,
 CASE WHEN regexp_matches(path || ' ' || key, '{_MARKS}') THEN 'editorial_history' WHEN role = 'publication' AND sequence_no < first_article AND sequence_no <= 30 AND segment_type IN ('document_heading', 'section_heading', 'text', 'table_row') AND NOT cites THEN 'publication_metadata'
 WHEN role = 'issued' AND (segment_type = 'closing' OR (closing AND NOT cites)) THEN 'primary_document_date' WHEN role = 'commencement' AND (segment_type = 'article' OR (starts_with(path, 'ARTICULO') AND (contains(path, 'VIGENCIA') OR contains(key, 'RIGE')))) THEN 'commencement_clause' WHEN cites THEN 'quoted_cited_norm' ELSE 'unknown' END AS context FROM g),
cand AS (SELECT *, context IN ('publication_metadata', 'primary_document_date', 'commencement_clause') AS is_trusted FROM c)"""
_ROLES = _ROLE.replace("{head}", ctes("seg", "ext", "man")) + """, roles AS (SELECT document_id AS document, role, count(*) AS candidates, CAST(count(*) FILTER (is_trusted) AS BIGINT) AS trusted, CASE WHEN count(*) FILTER (is_trusted) = 1 THEN 'resolved' WHEN count(*) FILTER (is_trusted) > 1 OR count(*) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN count(*) FILTER (is_trusted) = 1 THEN max(value) FILTER (is_trusted) END AS value FROM cand JOIN ext USING (extraction_id) JOIN man USING (manifestation_id) WHERE document_id IS NOT NULL GROUP BY ALL)"""
_TRACE = """WITH trace AS (SELECT l_orderkey AS aspect, l_linenumber AS task, l_partkey AS round, CASE WHEN l_quantity < 2 THEN 'blocked' WHEN l_quantity < 6 THEN 'budget_exhausted' WHEN l_tax > 0.06 THEN 'no_hits' ELSE 'hits' END AS outcome, CASE WHEN l_discount > 0.09 THEN 'incomplete' WHEN l_discount > 0.02 THEN 'ready' END AS context,
 CASE WHEN l_suppkey % 31 = 0 THEN 'conflicting' WHEN l_suppkey % 23 = 0 THEN 'ambiguous' WHEN l_suppkey % 13 = 0 THEN 'partial' WHEN l_suppkey % 4 > 0 THEN 'resolved' END AS auth, CASE WHEN l_partkey % 41 = 0 THEN 'ambiguous' WHEN l_partkey % 3 > 0 THEN 'effective_as_of' WHEN l_partkey % 9 = 0 THEN 'not_effective' END AS temp, CASE WHEN l_partkey % 17 = 0 THEN 'missing' WHEN l_partkey % 29 = 0 THEN 'ambiguous' WHEN l_partkey % 5 = 0 THEN 'sufficient' END AS fact FROM lineitem)"""
_LEDGER = _TRACE + """, last AS (SELECT aspect, task, max((round, outcome)) AS r FROM trace GROUP BY ALL), ex AS (SELECT aspect, CASE WHEN bool_or(r[2] = 'blocked') THEN 'blocked' WHEN bool_or(r[2] = 'budget_exhausted') THEN 'budget_exhausted' ELSE 'complete' END AS execution FROM last GROUP BY aspect),
s AS (SELECT aspect, CASE WHEN bool_or(context = 'incomplete') THEN 'context_incomplete' WHEN bool_or(context = 'ready') THEN 'context_ready' WHEN bool_or(outcome = 'hits') THEN 'candidate_only' WHEN bool_or(outcome = 'no_hits') THEN 'none_found' ELSE 'not_assessed' END AS evidence,
 CASE WHEN bool_or(auth = 'conflicting') THEN 'conflicting' WHEN bool_or(auth = 'ambiguous') THEN 'ambiguous' WHEN count(auth) = 0 THEN 'unassessed' WHEN bool_or(auth = 'partial') THEN 'partial' ELSE 'resolved' END AS authority, CASE WHEN count(temp) = 0 THEN 'unassessed' WHEN bool_or(temp = 'ambiguous') THEN 'ambiguous' WHEN count(DISTINCT temp) > 1 THEN 'mixed' ELSE 'assessed' END AS temporal,
 CASE WHEN count(fact) = 0 THEN 'not_required' WHEN bool_or(fact = 'ambiguous') THEN 'ambiguous' WHEN bool_or(fact = 'missing') THEN 'missing' ELSE 'sufficient' END AS facts FROM trace GROUP BY aspect),
y AS (SELECT *, CASE WHEN facts IN ('missing', 'ambiguous') THEN 'requires_facts' WHEN evidence = 'context_ready' THEN 'requires_interpretive_synthesis' ELSE 'unsupported' END AS synthesis FROM s JOIN ex USING (aspect)), ledger AS (SELECT *, CASE WHEN execution = 'complete' AND evidence = 'context_ready' AND authority = 'resolved' AND temporal = 'assessed' AND synthesis <> 'unsupported' THEN 'complete' ELSE 'incomplete' END AS closure FROM y)"""
_Q = """WITH q AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'https://a.example/' ELSE 'https://b.example/' END || event_id AS url, CASE WHEN event_id % 10 = 0 THEN 'index' ELSE 'document' END AS item_type, user_id % 4 AS depth, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' WHEN 'view' THEN 'done' ELSE 'pending' END AS status, user_id % 3 AS attempts, ts FROM events)"""
_OWN = "CASE {0}_type WHEN 'document' THEN {0}_id WHEN 'provision' THEN {1}.document_id END"
_FAMILY = FAMILY_SQL
_TOK = r"regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{L}\p{N}]+')"
ORACLES = {
    "first_identifiers": f"{ctes('ident')} SELECT document_id, arg_min(identifier_value, identifier_id) AS identifier_value FROM ident WHERE identifier_type = 'primary' GROUP BY document_id",
    "segment_provenance": f"{ctes('seg', 'ext', 'man', 'src', 'doc')} SELECT segment_id, manifestation_id, source_url, man.document_id, title FROM seg JOIN ext USING (extraction_id) JOIN man USING (manifestation_id) JOIN src USING (source_id) LEFT JOIN doc ON doc.document_id = man.document_id WHERE status = 'success'",
    "document_sources": f"{ctes('man', 'src')} SELECT document_id, count(*) AS manifestations, count(DISTINCT source_url) AS sources, md5(string_agg(DISTINCT source_url, '|' ORDER BY source_url)) AS digest FROM man JOIN src USING (source_id) WHERE document_id IS NOT NULL GROUP BY document_id",
    "generic_identity": f"{ctes('man', 'src', 'doc')}, m AS (SELECT nullif(upper(regexp_extract(source_url, '/(ley|decreto)_[0-9]+', 1)), '') AS f, document_type AS t, issuer FROM man JOIN src USING (source_id) LEFT JOIN doc USING (document_id)) SELECT CASE WHEN f IS NULL THEN CASE WHEN t IS NOT NULL THEN 'IDENTITY_CONFLICT' ELSE 'IDENTITY_UNRESOLVED' END WHEN t IS NULL THEN 'IDENTITY_UNRESOLVED' WHEN f <> t THEN 'IDENTITY_CONFLICT' WHEN t IN ('RESOLUCION', 'CIRCULAR') AND issuer IS NULL THEN 'ISSUER_IDENTITY_UNRESOLVED' ELSE 'accepted' END AS state, count(*) AS n FROM m GROUP BY ALL",
    "family_identity": f"{ctes('seg')}, h AS (SELECT extraction_id AS document, CASE WHEN segment_type = 'document_heading' THEN left(text, 45) END AS heading, CASE WHEN segment_type = 'document_heading' AND sequence_no * 3 <= 12 THEN segment_id % 3 > 0 END AS fits FROM seg) SELECT document, CASE WHEN count(DISTINCT heading) FILTER (fits) > 1 THEN 'FAMILY_IDENTITY_AMBIGUOUS' WHEN count(DISTINCT heading) FILTER (fits) = 1 THEN 'accepted' WHEN count(*) FILTER (NOT fits) > 0 THEN 'IDENTITY_CONFLICT' ELSE 'IDENTITY_UNRESOLVED' END AS state FROM h GROUP BY document",
    "equivalent_keys": f"{ctes('doc')}, c AS (SELECT document_id, document_type AS t, number AS n, year AS y, issuer, min(document_id) OVER w AS representative, count(*) OVER w AS copies FROM doc WINDOW w AS (PARTITION BY document_type, number, year, issuer)), k AS (SELECT DISTINCT t, n, y, issuer, representative FROM c) SELECT document_id, representative, copies, coalesce((SELECT string_agg(k.representative::VARCHAR, ',' ORDER BY k.representative) FROM k WHERE k.t = c.t AND k.n = c.n AND k.y = c.y AND (k.issuer IS NULL) <> (c.issuer IS NULL)), '') AS compatible FROM c",
    "issuer_split": f"{ctes('doc', 'man')}, c AS (SELECT doc.document_id, doc.issuer AS own, CASE WHEN source_id % 40 = 0 THEN 'MINHACIENDA' WHEN source_id % 3 > 0 THEN 'DIAN' END AS claimed FROM doc JOIN man ON man.document_id = doc.document_id) SELECT document_id, CASE WHEN count(DISTINCT claimed) > 1 THEN 'split' WHEN count(DISTINCT claimed) = 0 THEN 'keep' WHEN own IS NULL THEN 'backfill' WHEN own <> min(claimed) THEN 'conflict' ELSE 'keep' END AS plan, count(DISTINCT claimed) AS issuers FROM c GROUP BY document_id, own",
    "provision_index": f"{ctes('prov', 'obs')} SELECT p.provision_id, p.designation, count(o.provision_id) AS observations, count(DISTINCT text_hash) AS texts, count(DISTINCT extraction_id) AS extractions FROM prov p LEFT JOIN obs o USING (provision_id) GROUP BY ALL",
    "designation_counts": f"{ctes('prov')} SELECT document_id, designation, count(*) AS n FROM prov GROUP BY ALL",
    "exact_lookup": f"{ctes('rel', 'doc', 'prov')} SELECT relation_id AS ref, CASE WHEN target_type NOT IN ('document', 'provision') THEN 'unsupported_kind' WHEN coalesce(d.document_id, p.provision_id) IS NULL THEN 'not_found' WHEN target_type = 'provision' AND h.document_id IS NULL THEN 'inconsistent_target' ELSE 'found' END AS state, coalesce(d.document_id, h.document_id) AS document_id, p.provision_id FROM rel LEFT JOIN doc d ON target_type = 'document' AND target_id = d.document_id LEFT JOIN prov p ON target_type = 'provision' AND target_id = p.provision_id LEFT JOIN doc h ON h.document_id = p.document_id",
    "segment_provisions": f"{ctes('obs', 'seg')} SELECT s.segment_id, CASE WHEN count(DISTINCT provision_id) FILTER (o.extraction_id = s.extraction_id) = 1 THEN 'citable' WHEN count(DISTINCT provision_id) FILTER (o.extraction_id = s.extraction_id) > 1 THEN 'ambiguous' WHEN count(provision_id) > 0 THEN 'unverified' ELSE 'missing' END AS state, CASE WHEN count(DISTINCT provision_id) FILTER (o.extraction_id = s.extraction_id) = 1 THEN min(provision_id) FILTER (o.extraction_id = s.extraction_id) END AS provision_id FROM seg s LEFT JOIN obs o USING (segment_id) GROUP BY s.segment_id",
    "boundaries": f"{ctes('seg')} SELECT extraction_id, CAST(coalesce(min(sequence_no) FILTER (segment_type = 'article'), count(*) + 1) AS BIGINT) AS first_article, count(*) AS segments FROM seg GROUP BY extraction_id",
    "main_headings": rf"{ctes('seg')}, r AS (SELECT *, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) < 0.8 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS low FROM seg WHERE segment_type IN ('section_heading', 'document_heading')) SELECT extraction_id, arg_min(segment_id, (low, sequence_no, segment_id)) AS segment_id FROM r GROUP BY extraction_id",
    "paired_rows": f"{ctes('seg')}, n AS (SELECT segment_id, segment_type IN ('section_heading', 'document_heading') AS l, lead(segment_id) OVER w AS next_id, lead(segment_type IN ('section_heading', 'document_heading')) OVER w AS nl FROM seg WINDOW w AS (PARTITION BY extraction_id ORDER BY sequence_no)) SELECT segment_id, next_id FROM n WHERE l AND NOT coalesce(nl, true)",
    "date_candidates": _ROLE.replace("{head}", ctes("seg")) + " SELECT segment_id, role, value, is_trusted, context FROM cand",
    "temporal_roles": _ROLES + " SELECT * FROM roles",
    "promoted_events": _ROLES + ", w AS (SELECT document, max(value) FILTER (role = 'issued' AND status = 'resolved') AS i, max(value) FILTER (role = 'publication' AND status = 'resolved') AS p, bool_or(role = 'commencement' AND status = 'resolved') AS c FROM roles GROUP BY document) SELECT document, 'issued' AS event_type, i AS event_date FROM w WHERE i IS NOT NULL UNION ALL SELECT document, 'published', p FROM w WHERE p IS NOT NULL UNION ALL SELECT document, 'enters_into_force', p FROM w WHERE p IS NOT NULL AND c",
    "superseded_events": f"{ctes('event')}, n AS (SELECT document_id, event_type, list(event_date) AS days FROM event WHERE event_id % 5 = 0 GROUP BY ALL) SELECT CASE WHEN days IS NULL OR list_contains(days, event_date) THEN 'active' ELSE 'superseded' END AS status, count(*) AS n FROM event LEFT JOIN n USING (document_id, event_type) WHERE event_id % 5 <> 0 GROUP BY 1",
    "relation_dates": f"{ctes('rel', 'prov', 'event')}, o AS (SELECT relation_id, relation_type, {_OWN.format('source', 'p')} AS doc FROM rel LEFT JOIN prov p ON source_id = p.provision_id), t AS (SELECT document_id, min(event_date) FILTER (event_type = 'issued') AS i, min(event_date) FILTER (event_type = 'enters_into_force') AS f FROM event GROUP BY document_id) SELECT relation_id, CASE WHEN relation_id % 4 <> 0 AND NOT ends_with(relation_type, '_by') THEN i END AS asserted, f AS effective FROM o LEFT JOIN t ON doc = document_id",
    "coverage_ledger": _LEDGER + " SELECT *, array_to_string(list_filter([CASE WHEN execution <> 'complete' THEN 'EXECUTION_INCOMPLETE' END, CASE WHEN evidence <> 'context_ready' THEN 'EVIDENCE_INCOMPLETE' END, CASE WHEN authority <> 'resolved' THEN 'AUTHORITY_UNRESOLVED' END, CASE WHEN temporal <> 'assessed' THEN 'TEMPORAL_UNASSESSED' END, CASE WHEN facts IN ('missing', 'ambiguous') THEN 'FACTS_OPEN' END], lambda x: x IS NOT NULL), ',') AS codes FROM ledger",
    "research_status": _LEDGER + " SELECT aspect % 977 AS question, CASE WHEN bool_or(execution = 'blocked') THEN 'blocked' WHEN bool_and(closure = 'complete') THEN 'complete' ELSE 'partial' END AS status, count(*) AS aspects FROM ledger GROUP BY 1",
    "omissions": _TRACE + ", l AS (SELECT aspect * 10 + task AS task, max(({'r': round, 'o': coalesce(CASE WHEN round % 7 > 0 THEN outcome END, '')})).o AS outcome FROM trace GROUP BY 1), p AS (SELECT o_orderkey * 10 + 1 AS task FROM orders) SELECT task, reason FROM (SELECT p.task, CASE WHEN l.task IS NULL THEN 'not_executed' WHEN outcome = '' THEN 'no_outcome' WHEN outcome NOT IN ('hits', 'no_hits') THEN outcome END AS reason FROM p LEFT JOIN l USING (task)) WHERE reason IS NOT NULL",
    "relation_relevance": f"""{ctes('rel', 'prov')}, e AS (SELECT rel.*, {_OWN.format('source', 'p')} AS sd, {_OWN.format('target', 'q')} AS td, {_FAMILY} AS family FROM rel LEFT JOIN prov p ON source_id = p.provision_id LEFT JOIN prov q ON target_id = q.provision_id), cd AS (SELECT DISTINCT p_partkey % 1600 + 1 AS d FROM part WHERE p_size < 5), cp AS (SELECT p_partkey AS p FROM part WHERE p_size = 7), hd AS (SELECT DISTINCT document_id AS d FROM prov),
x AS (SELECT *, sd IN (SELECT d FROM cd) AS s, td IN (SELECT d FROM cd) AS t FROM e) SELECT relation_id, CASE WHEN (source_type = 'provision' AND source_id IN (SELECT p FROM cp)) OR (target_type = 'provision' AND target_id IN (SELECT p FROM cp)) THEN 'exact_provision' WHEN s AND t THEN 'selected_authorities' WHEN family IS NULL THEN 'irrelevant' WHEN (s AND source_type = 'document') OR (t AND target_type = 'document') THEN 'document_scope_conservative' WHEN (s AND sd NOT IN (SELECT d FROM hd)) OR (t AND td NOT IN (SELECT d FROM hd)) THEN 'unspecified_provision_conservative' ELSE 'irrelevant' END AS relevance FROM x""",
    "task_schedule": "WITH t AS (SELECT l_suppkey % 50 AS question, l_partkey % 20 AS aspect, l_orderkey AS task, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS lane FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lane, question, aspect ORDER BY task) AS round FROM t), u AS (SELECT *, row_number() OVER (PARTITION BY lane, question, round ORDER BY aspect) AS turn FROM r) SELECT lane, round, turn, count(*) AS n, min(task) AS first_task FROM u GROUP BY ALL",
    "profile_matches": f"WITH q AS (SELECT doc_id AS question, list_distinct({_TOK}) AS terms FROM documents), b AS (SELECT item_id AS profile, list_filter({_TOK}[:64], lambda t: regexp_full_match(t, '[0-9]+') OR length(t) >= 3) AS x FROM benchmark), p AS (SELECT profile, list_filter(x, lambda t, i: NOT list_contains(x[:i - 1], t))[:3] AS terms FROM b) SELECT question, profile FROM q, p WHERE len(p.terms) > 0 AND list_has_all(q.terms, p.terms)",
    "merged_candidates": "SELECT l_partkey AS segment, array_to_string(list_sort(list(DISTINCT l_suppkey % 40)), ',') AS queries, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS tasks FROM lineitem GROUP BY 1",
    "overflowing": "SELECT o_custkey, o_orderkey, n > 10 AS overflow FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 10",
    "recent_errors": "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10",
    "event_settings": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NULL AS invalid FROM events",
    "deletions": "SELECT 'cascade' AS rule, count(*) AS n, count(o_custkey) AS with_key FROM orders WHERE o_custkey % 9 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'set_null', count(*), count(*) FILTER (o_custkey % 9 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)) FROM orders UNION ALL SELECT 'restrict', count(DISTINCT o_custkey), count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 9 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)",
    "rule_violations": f"{ctes('res')} SELECT mention_id, 'resolved_has_target' AS rule FROM res WHERE (status = 'resolved') <> (target_document_id IS NOT NULL) UNION ALL SELECT mention_id, 'reason_unless_resolved' FROM res WHERE (status = 'resolved') = (reason IS NOT NULL)",
    "drift_plan": f"{ctes('seg', 'fts')} SELECT coalesce(s.segment_id, f.segment_id) AS segment_id, CASE WHEN f.segment_id IS NULL THEN 'add' WHEN s.segment_id IS NULL THEN 'drop' ELSE 'rewrite' END AS action FROM fts f FULL JOIN seg s ON f.segment_id = s.segment_id WHERE f.segment_id IS NULL OR s.segment_id IS NULL OR md5(f.text) <> s.text_hash",
    "state_delta": f"{ctes('res')} SELECT status, count(*) FILTER (k = 'b') AS before, count(*) FILTER (k = 'a') AS after FROM (SELECT status, 'b' AS k FROM res UNION ALL SELECT CASE WHEN mention_id % 5 = 0 THEN 'resolved' ELSE status END, 'a' FROM res) GROUP BY status",
    "new_rows_guarded": "SELECT s_suppkey + 10000000 AS document_id, s_name AS title FROM supplier",
    "queue_claim": _Q + ", h AS (SELECT url FROM q WHERE status IN ('pending', 'done', 'error') AND ts <= TIMESTAMP '2024-02-01' ORDER BY item_type <> 'index', depth, ts, url LIMIT 200) SELECT CASE WHEN h.url IS NULL THEN status ELSE 'running' END AS status, attempts + CASE WHEN h.url IS NULL THEN 0 ELSE 1 END AS attempts, count(*) AS n FROM q LEFT JOIN h USING (url) GROUP BY 1, 2",
    "queue_rearm": _Q + " SELECT url, CAST(floor(epoch(ts)) + CASE WHEN item_type = 'index' THEN 21600 ELSE 604800 END AS BIGINT) AS due FROM q WHERE status = 'done'",
    "queue_scope": _Q + " SELECT status, count(*) AS n FROM q WHERE contains(url, '://a.example/') GROUP BY status",
    "enqueue": _Q + " SELECT 'https://a.example/' || (event_id + 4 - user_id % 9) AS url, min(user_id % 5) AS depth FROM events WHERE 'https://a.example/' || (event_id + 4 - user_id % 9) NOT IN (SELECT url FROM q) GROUP BY 1",
}
QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
