"""Blocks, bodies and bundles over pages and the derived registry, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritrail.functions.forms import key_form
from veritrail.functions.ids import canonical_json
from veritrail.operators import blocks, bundle, citations, markup
from veritrail.plans.corpus import ctes, derived
from veritrail.sources import bundle_store
from veritrail.sources.shared import fresh_path

#: Segments as the blocks of a page: headings, footers and portal notes among them.
_BLOCK = "CASE WHEN sequence_no = 1 AND extraction_id % 3 = 0 THEN 'Decreto 5 de 1990' WHEN sequence_no = 2 AND extraction_id % 5 > 0 THEN 'DECRETO NÚMERO 12 DE 1995' WHEN sequence_no = 6 THEN 'Compilación Jurídica DIAN' WHEN sequence_no = 4 AND extraction_id % 7 = 0 THEN '<Consultar la vigencia de esta norma directamente en los artículos que modifica y/o adiciona>' WHEN sequence_no = 4 AND extraction_id % 7 = 1 THEN 'Consultar la vigencia de esta norma en la página' WHEN sequence_no = 1 AND extraction_id % 32 = 5 THEN 'SENTENCIA C-123/05' WHEN sequence_no = 3 AND extraction_id % 32 = 5 THEN 'I. ANTECEDENTES ' || rpad('', CAST(extraction_id % 320 + 200 AS INT), 'la demanda ') WHEN sequence_no = 4 AND extraction_id % 32 = 5 THEN 'R E S U E L V E : ' || rpad('', 150, 'declarar exequible ') WHEN sequence_no = 5 AND extraction_id % 2 = 0 THEN 'Publíquese y cúmplase' WHEN sequence_no = 3 AND extraction_id % 4 = 0 THEN 'CONSIDERANDO:' WHEN sequence_no = 3 AND extraction_id % 4 = 1 THEN '1.2. Un numeral' ELSE text END"


def _blocks(spark, d):
    (seg,) = derived(spark, d, "seg")
    return seg.select(F.col("extraction_id").alias("doc"), F.col("sequence_no").alias("seq"), F.expr(_BLOCK).alias("text"), F.when(F.col("segment_id") % 29 == 0, "table_row").otherwise("p").alias("kind"), "segment_id")


def q_page_blocks(spark, d):
    out = blocks.visible(spark.read.parquet(f"{d}/pages.parquet"))
    return out.select("page_id", F.col("seq").cast("long").alias("seq"), F.md5("text").alias("digest"))


def q_parsed_blocks(spark, d):
    """The blocks of ``page_blocks``, read element by element."""
    out = markup.blocks(spark.read.parquet(f"{d}/pages.parquet"))
    return out.select("page_id", F.col("seq").cast("long").alias("seq"), F.md5("text").alias("digest"))


def q_eleven_types(spark, d):
    keyed = _blocks(spark, d).withColumn("key", key_form(F.col("text")))
    return keyed.select("segment_id", blocks.segment_type(F.col("text"), F.col("kind"), F.col("key")).alias("segment_type"))


def q_legal_bodies(spark, d):
    family = F.when(F.col("doc") % 32 == 5, blocks.COURT_FAMILY)
    return blocks.legal_body(_blocks(spark, d).withColumn("family", family), 3, "family")


def q_sections(spark, d):
    b = _blocks(spark, d)
    return blocks.section_between(b, F.col("text").startswith("DECRETO N"), F.col("text").startswith("Compil"), F.col("text").contains("artículo"), 1, 1)


def q_rule_fragments(spark, d):
    res, doc = derived(spark, d, "res", "doc")
    refs = res.select("mention_id", "status", (F.floor(F.col("mention_id") / 10) % 1500).cast("long").alias("source_document"), F.col("target_document_id").alias("target_document"))
    return bundle.rule_fragments(refs, doc.where("year < 2000"))


def q_case_support(spark, d):
    evid, ext, man, rel, prov = derived(spark, d, "evid", "ext", "man", "rel", "prov")
    found = evid.where("owner_type = 'claim'").join(man.select("manifestation_id", "document_id"), "manifestation_id").select(F.col("owner_id").alias("claim_id"), "document_id")
    claims = rel.select((F.col("relation_id") % 500).alias("case_id"), F.col("relation_id").alias("claim_id"))
    edges = citations.owning_document(citations.owning_document(rel.where("status = 'validated'"), "source", prov), "target", prov).select((F.col("relation_id") % 500).alias("case_id"), "source_document", "target_document")
    return bundle.support(claims, found, edges)


def q_ownerless_evidence(spark, d):
    rel, evid, man = derived(spark, d, "rel", "evid", "man")
    edges = rel.groupBy((F.col("relation_id") % 9000).alias("relation_id")).agg(F.collect_set("evidence_id").alias("evidence_ids"))
    evidence = evid.select("evidence_id", F.col("manifestation_id").alias("owner_id"))
    return bundle.without_owner(edges, evidence, man.where("document_id IS NOT NULL AND document_id % 3 > 0").select(F.col("manifestation_id").alias("owner_id")))


def q_dangling_refs(spark, d):
    rel, doc, prov = derived(spark, d, "rel", "doc", "prov")
    refs = rel.select((F.col("relation_id") % 500).alias("bundle_id"), F.col("target_type").alias("kind"), F.col("target_id").alias("ref"))
    return bundle.dangling(refs, {"document": (doc, "document_id"), "provision": (prov, "provision_id")}).groupBy("bundle_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def q_linked_resources(spark, d):
    """Documents of large customers, their manifestations, extractions and segments, counted."""
    man, ext, seg = derived(spark, d, "man", "ext", "seg")
    chosen = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 9000").select(F.col("c_custkey").alias("document_id"))
    found = bundle.linked(chosen, (man, "document_id", "document_id"), (ext, "manifestation_id", "manifestation_id"), (seg, "extraction_id", "extraction_id"))
    out = None
    for name, rows in zip(("manifestation", "extraction", "segment"), found, strict=True):
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def q_readiness(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return bundle.readiness(li.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("gate"), F.when(F.col("l_tax") < 0.075, F.col("l_discount") < 0.08).alias("passed")))


def q_case_errors(spark, d):
    (rel,) = derived(spark, d, "rel")
    kind = F.when(F.col("relation_id") % 10 == 1, "claim").when(F.col("relation_id") % 10 == 2, "note").otherwise("relation")
    items = rel.select((F.col("relation_id") % 500).alias("case_id"), kind.alias("kind"), F.col("evidence_id").isNotNull().cast("int").alias("n_evidence"), "status", F.when(F.col("source_id") % 9 > 0, F.col("source_id")).alias("source_id"), (F.col("confidence") + 0.15).alias("confidence"), (F.col("relation_id") % 3 == 0).alias("review"))
    return bundle.case_errors(items).groupBy("case_id", "code").agg(F.count(F.lit(1)).alias("n"))


def q_context_fingerprint(spark, d):
    doc, prov = derived(spark, d, "doc", "prov")
    return bundle.context_fingerprint({"documents": doc.select("document_id", "document_type", "issuer"), "provisions": prov.select("provision_id", "designation")})


def q_stored_bundles(spark, d):
    """A bundle for each extraction, stored, read back with faults in some recipes, and verified."""
    (seg,) = derived(spark, d, "seg")
    ref = F.concat(F.lit("bundle:"), F.col("extraction_id").cast("string"))
    name = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("extraction_id").cast("string"))
    one = [("case_input", canonical_json(question=name("case"))), ("intake_draft", canonical_json(intake_ref=name("intake"))), ("research_plan", canonical_json(plan_ref=name("plan"))), ("research_result", canonical_json(result_ref=name("result")))]
    singles = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(0).alias("ordinal"), p.alias("payload")) for k, p in one])
    whole = seg.select("extraction_id").distinct().select(ref.alias("bundle_ref"), F.inline(singles))
    place = F.row_number().over(Window.partitionBy("extraction_id").orderBy("sequence_no")) - 1
    spans = seg.select(ref.alias("bundle_ref"), F.lit("evidence_span").alias("kind"), place.alias("ordinal"), canonical_json(evidence_ref=F.concat(F.lit("evidence:"), F.col("segment_id").cast("string")), quote=F.col("text")).alias("payload"))
    store = bundle_store.BundleStore(spark, fresh_path(spark, "bundles"))
    store.persist(whole.unionByName(spans))
    case = F.substring_index("bundle_ref", ":", -1).cast("long")
    read = store.recipes().withColumn("case", case).where("NOT (kind = 'research_plan' AND case % 11 = 0)")
    read = read.withColumn("role", F.when((F.col("kind") == "intake_draft") & (F.col("case") % 13 == 1), "platform_research").otherwise(F.col("role"))).withColumn("ordinal", F.when((F.col("kind") == "evidence_span") & (F.col("case") % 17 == 2), F.col("ordinal") + 1).otherwise(F.col("ordinal")))
    out = bundle_store.verify(store.bundles(), read.drop("case"), store.objects())
    return out.join(store.bundles().select("bundle_ref", "bundle_sha256"), "bundle_ref")


_HEAD = r"^(DECRETO|RESOLUCION|CONCEPTO|OFICIO|LEY|SENTENCIA|CIRCULAR)\s+(NUMERO\s+)?[A-Z0-9._/-]+\s+DE\s+[0-9]{4}\b"
_B = f"{ctes('seg')}, b AS (SELECT extraction_id AS doc, sequence_no AS seq, segment_id, segment_id % 29 = 0 AS tr, {_BLOCK} AS text FROM seg), k AS (SELECT *, upper(strip_accents(trim(text))) AS key, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS up, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS lt FROM b)"
_UN = "{}"
for _a, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _UN = f"replace({_UN}, '{_a}', '{_c}')"
_HTML = "html"
for _p, _r, _f in ((r"<(script|style|noscript|svg|template)\b[^>]*>.*?</(script|style|noscript|svg|template)\s*>", " ", "gis"), (r"<!--.*?-->", " ", "gs"), (r"[\r\n\t]+", " ", "g"), (r"</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ", "gi"), (rf"</?({blocks.BLOCK_TAGS})\b[^>]*>", "\n", "gi"), ("<[^>]*>", "", "g")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_r}', '{_f}')"
ORACLES = {
    "stored_bundles": f"""{ctes('seg')}, p AS (SELECT DISTINCT extraction_id AS e, kind, 0 AS o, CASE kind WHEN 'case_input' THEN '{{"question":"case:' || extraction_id WHEN 'intake_draft' THEN '{{"intake_ref":"intake:' || extraction_id WHEN 'research_plan' THEN '{{"plan_ref":"plan:' || extraction_id ELSE '{{"result_ref":"result:' || extraction_id END || '"}}' AS payload FROM seg, (VALUES ('case_input'), ('intake_draft'), ('research_plan'), ('research_result')) v(kind)
 UNION ALL SELECT extraction_id, 'evidence_span', row_number() OVER (PARTITION BY extraction_id ORDER BY sequence_no) - 1, '{{"evidence_ref":"evidence:' || segment_id || '","quote":"' || text || '"}}' FROM seg), l AS (SELECT e, kind || ':' || lpad(CAST(o AS VARCHAR), 9, '0') || ':' || sha256(payload) AS line FROM p)
SELECT 'bundle:' || e AS bundle_ref, sha256(string_agg(line, chr(10) ORDER BY line)) AS bundle_sha256, count(*) - CASE WHEN e % 11 = 0 THEN 1 ELSE 0 END AS artifacts, CASE WHEN e % 13 = 1 THEN 'ownership_mismatch' WHEN e % 17 = 2 THEN 'ordinals_not_contiguous' WHEN e % 11 = 0 THEN 'single_part_count' ELSE 'verified' END AS state FROM l GROUP BY e""",
    "page_blocks": f"WITH l AS (SELECT page_id, list_filter(list_transform(string_split({_HTML}, chr(10)), lambda x: trim(regexp_replace({_UN.format('x')}, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages), k AS (SELECT page_id, list_filter(l, lambda x, i: i = 1 OR l[i - 1] <> x) AS l FROM l) SELECT page_id, unnest(range(len(l))) AS seq, md5(unnest(l)) AS digest FROM k",
    "eleven_types": f"""{_B} SELECT segment_id, CASE WHEN tr THEN 'table_row' WHEN regexp_matches(key, '{_HEAD}') OR regexp_matches(key, '^SENTENCIA C-[0-9]{{1,4}}/[0-9]{{2,4}}\\b') THEN 'document_heading' WHEN starts_with(key, 'ARTICULO ') THEN 'article' WHEN regexp_matches(text, '^[0-9]+(\\.[0-9]+)*\\.\\s') THEN 'numeral' WHEN key = 'CONSIDERANDO:' THEN 'structural_heading' WHEN starts_with(key, 'PUBLIQUESE') THEN 'closing' WHEN length(text) <= 240 AND up >= 0.9 * lt THEN 'section_heading' WHEN starts_with(key, 'QUE ') THEN 'consideration' ELSE 'text' END AS segment_type FROM k""",
    "legal_bodies": f"""{_B}, s AS (SELECT doc, arg_min(seq, (up < 0.8 * lt, seq)) AS first FROM k WHERE CASE WHEN doc % 32 = 5 THEN regexp_matches(key, '^SENTENCIA C-[0-9]{{1,4}}/[0-9]{{2,4}}\\b') ELSE regexp_matches(key, '{_HEAD}') END GROUP BY doc), e AS (SELECT k.*, first, min(CASE WHEN key = 'COMPILACION JURIDICA DIAN' AND seq > first THEN seq END) OVER (PARTITION BY doc) AS stop FROM k LEFT JOIN s USING (doc)), i AS (SELECT *, seq >= first AND (stop IS NULL OR seq < stop) AND NOT starts_with(trim(key, '<> '), 'CONSULTAR LA VIGENCIA DE ESTA NORMA DIRECTAMENTE EN LOS ARTICULOS QUE MODIFICA Y/O ADICIONA') AS ok FROM e)
SELECT doc, CASE WHEN min(first) IS NULL THEN 'no_heading' WHEN CASE WHEN doc % 32 = 5 THEN coalesce(sum(length(text)) FILTER (ok), 0) < 500 OR coalesce(bool_or(contains(key, 'ANTECEDENTES')) FILTER (ok), false)::INT + coalesce(bool_or(contains(key, 'CONSIDERACIONES')) FILTER (ok), false)::INT + coalesce(bool_or(contains(key, 'DECISION') OR starts_with(regexp_replace(key, '[^A-Z]', '', 'g'), 'RESUELVE')) FILTER (ok), false)::INT < 2 ELSE count(*) FILTER (ok) < 3 END THEN 'too_short' ELSE 'body' END AS state, min(first) AS first, max(seq) FILTER (ok) AS last, count(*) FILTER (ok) AS blocks FROM i GROUP BY doc""",
    "sections": f"""{_B}, s AS (SELECT doc, count(*) AS starts, min(seq) AS first FROM b WHERE starts_with(text, 'DECRETO N') GROUP BY doc), e AS (SELECT doc, count(*) AS ends, min(seq) AS last FROM b JOIN s USING (doc) WHERE starts_with(text, 'Compil') AND seq > first GROUP BY doc), n AS (SELECT doc, starts, ends, count(CASE WHEN seq > first AND seq < last THEN 1 END) AS n, count(CASE WHEN seq > first AND seq < last AND contains(text, 'artículo') THEN 1 END) AS questions FROM b LEFT JOIN s USING (doc) LEFT JOIN e USING (doc) GROUP BY ALL)
SELECT doc, CASE WHEN coalesce(starts, 0) <> 1 THEN 'start_not_unique' WHEN coalesce(ends, 0) <> 1 THEN 'end_not_unique' WHEN n < 1 THEN 'too_few_blocks' WHEN questions < 1 THEN 'too_few_questions' ELSE 'section' END AS state, questions FROM n""",
    "rule_fragments": f"{ctes('res', 'doc')}, r AS (SELECT mention_id, CAST(floor(mention_id / 10) % 1500 AS BIGINT) AS source_document, target_document_id AS target_document FROM res WHERE status = 'resolved') SELECT * FROM r WHERE source_document IN (SELECT document_id FROM doc WHERE year < 2000) AND target_document IN (SELECT document_id FROM doc WHERE year < 2000)",
    "case_support": f"{ctes('evid', 'man', 'rel', 'prov')} SELECT DISTINCT case_id, document_id FROM (SELECT relation_id % 500 AS case_id, document_id FROM rel JOIN evid ON owner_id = relation_id AND owner_type = 'claim' JOIN man ON man.manifestation_id = evid.manifestation_id UNION ALL SELECT relation_id % 500, CASE source_type WHEN 'document' THEN source_id ELSE p.document_id END FROM rel LEFT JOIN prov p ON source_id = provision_id WHERE status = 'validated' UNION ALL SELECT relation_id % 500, CASE target_type WHEN 'document' THEN target_id WHEN 'provision' THEN p.document_id END FROM rel LEFT JOIN prov p ON target_id = provision_id WHERE status = 'validated') WHERE document_id IS NOT NULL",
    "ownerless_evidence": f"{ctes('rel', 'evid', 'man')}, e AS (SELECT relation_id % 9000 AS relation_id, r.evidence_id, m.manifestation_id AS ok FROM rel r LEFT JOIN evid USING (evidence_id) LEFT JOIN man m ON m.manifestation_id = evid.manifestation_id AND m.document_id % 3 > 0) SELECT relation_id, CASE WHEN count(ok) = 0 THEN 'unresolved' WHEN count(ok) < count(evidence_id) THEN 'reduced' ELSE 'whole' END AS state, count(ok) AS kept FROM e GROUP BY relation_id",
    "dangling_refs": f"{ctes('rel', 'doc', 'prov')} SELECT relation_id % 500 AS bundle_id, target_type AS kind, count(*) AS n FROM rel WHERE NOT (target_type = 'document' AND target_id IN (SELECT document_id FROM doc)) AND NOT (target_type = 'provision' AND target_id IN (SELECT provision_id FROM prov)) GROUP BY ALL",
    "linked_resources": f"{ctes('man', 'ext', 'seg')}, m AS (SELECT manifestation_id FROM man JOIN customer ON c_custkey = document_id WHERE c_acctbal > 9000), e AS (SELECT extraction_id FROM ext WHERE manifestation_id IN (SELECT manifestation_id FROM m)) SELECT 'manifestation' AS kind, count(*) AS n FROM m UNION ALL SELECT 'extraction', count(*) FROM e UNION ALL SELECT 'segment', count(*) FROM seg WHERE extraction_id IN (SELECT extraction_id FROM e)",
    "readiness": "SELECT l_orderkey AS run, bool_and(l_tax < 0.075 AND l_discount < 0.08) AS ready, count(*) FILTER (l_tax < 0.075 AND l_discount < 0.08) AS passed, count(*) AS gates FROM lineitem GROUP BY 1",
    "case_errors": f"{ctes('rel')}, i AS (SELECT relation_id % 500 AS case_id, CASE relation_id % 10 WHEN 1 THEN 'claim' WHEN 2 THEN 'note' ELSE 'relation' END AS kind, evidence_id, status, source_id % 9 > 0 AS has, confidence + 0.15 AS c, relation_id % 3 = 0 AS review FROM rel), e AS (SELECT case_id, 'CLAIM_WITHOUT_EVIDENCE' AS code FROM i WHERE kind = 'claim' AND evidence_id IS NULL UNION ALL SELECT case_id, 'VALIDATED_WITHOUT_SOURCE' FROM i WHERE status = 'validated' AND NOT has UNION ALL SELECT case_id, 'CONFIDENCE_OUT_OF_RANGE' FROM i WHERE c < 0 OR c > 1 UNION ALL SELECT case_id, 'UNKNOWN_KIND' FROM i WHERE kind = 'note' UNION ALL SELECT case_id, 'REVIEW_NOT_MARKED' FROM i WHERE c < 0.8 AND NOT review) SELECT case_id, code, count(*) AS n FROM e GROUP BY ALL",
    "context_fingerprint": f"{ctes('doc', 'prov')}, h AS (SELECT 'documents' AS part, md5(document_id || '|' || document_type || '|' || coalesce(issuer, '')) AS m FROM doc UNION ALL SELECT 'provisions', md5(provision_id || '|' || designation) FROM prov) SELECT part, count(*) AS rows, CAST(sum(('0x' || m[1:12])::HUGEINT) AS STRING) AS fingerprint FROM h GROUP BY part",
}
# ``parsed_blocks`` reads references to the end, with or without their semicolon; those of ``page_blocks`` have one and are read once.
_READ = "regexp_replace({}, '&((amp|AMP);?)+', '&', 'g')"
for _a, _c in (("nbsp;?", " "), ("(lt|LT);?", "<"), ("(gt|GT);?", ">"), ("(quot|QUOT);?", '"'), ("#39(;|\\b)", "''"), ("(copy|COPY);?", "©"), ("middot;?", "·")):
    _READ = f"regexp_replace({_READ}, '&{_a}', '{_c}', 'g')"
ORACLES["parsed_blocks"] = ORACLES["page_blocks"].replace(_UN.format("x"), _READ.format("x"))
QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
