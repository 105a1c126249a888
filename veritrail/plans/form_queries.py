"""Normal forms, parsers and decision maps over the given tables and the derived registry, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import forms, text
from veritrail.plans.corpus import ctes, derived


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def q_text_forms(spark, d):
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", F.md5(forms.strip_accents(t)).alias("stripped"), F.md5(forms.fold(t)).alias("folded"), F.md5(forms.key_form(t)).alias("key"), F.md5(forms.plain_form(t)).alias("plain"), F.ceil(F.length(t) / 4).cast("long").alias("token_estimate"))


def q_page_forms(spark, d):
    p = _table(spark, d, "pages").withColumn("title", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return p.select("page_id", forms.collapse(forms.unescape(F.col("title"))).alias("title"), forms.source_kind(F.col("url")).alias("kind"), F.md5(forms.markdown_escape(F.concat("title", F.lit(" | "), "url"))).alias("cell"), F.col("url").startswith("https://").alias("secure"), F.lower("url").contains("example.net").alias("net"))


def q_heading_forms(spark, d):
    (doc,) = derived(spark, d, "doc")
    label = F.initcap("document_type")
    written = F.concat(label, F.lit(" Número "), F.lpad(F.col("number").cast("string"), 4, "0"), F.lit(" de "), F.col("year").cast("string"))
    name = F.concat(F.lower("document_type"), F.lit("_"), F.coalesce(F.lower("issuer"), F.lit("x")), F.lit("_1.htm"))
    parsed = doc.withColumn("h", forms.heading(written))
    return parsed.select("document_id", F.col("h.doc_type").alias("doc_type"), F.col("h.number").alias("number"), F.col("h.year").alias("year"), forms.document_type(label).alias("type_key"), forms.issuer(F.concat(F.lit(" "), F.coalesce("issuer", F.lit("otra")))).alias("issuer_key"), forms.file_issuer(name).alias("file_issuer"), forms.lookup(F.col("document_type"), forms.FUNCTIONS).alias("legal_function"))


def q_key_parts(spark, d):
    (ident,) = derived(spark, d, "ident")
    ref = F.concat(F.when(F.col("identifier_id") % 3 == 0, "doc:").otherwise("prov:"), F.when(F.col("identifier_id") % 7 != 0, F.col("identifier_id").cast("string")).otherwise(""))
    return ident.withColumn("k", forms.primary_key(F.col("identifier_value"))).select("identifier_id", F.col("k.issuer").alias("issuer"), F.col("k.doc_type").alias("doc_type"), F.col("k.number").alias("number"), F.col("k.year").alias("year"), forms.typed_ref(ref, "doc").alias("doc_ref"), forms.is_identifier(F.col("identifier_value")).alias("named"), forms.is_digest(F.sha2("identifier_value", 256)).alias("digest"))


def q_article_parts(spark, d):
    (seg,) = derived(spark, d, "seg")
    return seg.withColumn("a", forms.article(F.col("text"))).where("a IS NOT NULL").select("segment_id", F.col("a.designation").alias("designation"), F.col("a.title").alias("title"), F.md5("a.body").alias("body"))


def q_amounts(spark, d):
    (seg,) = derived(spark, d, "seg")
    found = seg.where(F.col("text").contains("UVT")).select("segment_id", "text", F.posexplode(forms.amounts(F.col("text"))).alias("pos", "value"))
    grouped = forms.grouped_integer(F.regexp_extract("text", r"([0-9]+\.[0-9]{3}) UVT", 1))
    return found.select("segment_id", F.col("pos").cast("long").alias("pos"), (F.col("value") * 10).cast("long").alias("value_e1"), grouped.alias("grouped"), forms.operator_code(F.col("text")).alias("operator"))


def q_threshold_rules(spark, d):
    """Documents' limits against the amounts asked for: one rule that applies decides, several conflict, none leaves it open."""
    seg, ext, man = derived(spark, d, "seg", "ext", "man")
    limits = seg.where(F.col("text").contains("UVT")).withColumn("found", forms.amounts(F.regexp_extract("text", "exceder de ([^;]*);", 0))).where(F.size("found") == 1)
    owned = limits.join(ext.where("status = 'success'"), "extraction_id").join(man.select("manifestation_id", "document_id"), "manifestation_id")
    rules = owned.where("document_id IS NOT NULL").groupBy("document_id").agg(F.countDistinct(F.col("found")[0]).alias("rules"), F.min(F.col("found")[0]).alias("limit"))
    asked = _table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_acctbal").cast("decimal(18,2)")).alias("observed"))
    joined = asked.join(rules, "document_id", "left")
    state = F.when(F.col("rules").isNull(), "no_rule").when(F.col("rules") > 1, "conflicting_authority").when(F.col("observed") < 0, "invalid_fact").when(F.col("observed") <= F.col("limit"), "passes").otherwise("fails")
    decided = state.isin("passes", "fails")
    return joined.select("document_id", state.alias("state"), F.when(decided, text.decimal_text(F.col("limit") - F.col("observed"))).alias("margin"))


def q_event_dates(spark, d):
    (event,) = derived(spark, d, "event")
    written = F.when(F.col("event_id") % 6 == 0, "2024-02-30").when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("event_date").cast("string"))
    read = event.withColumn("d", forms.iso_date(written))
    return read.select("event_id", F.coalesce("effective_from", "event_date").alias("effective"), F.col("d.day").alias("day"), F.col("d.error").alias("error"))


def q_relation_families(spark, d):
    """Dependency families of relations, which need a person, and which name a conflict."""
    (rel,) = derived(spark, d, "rel")
    review = forms.needs_review(F.col("status"), F.col("confidence"), F.col("evidence_id").isNotNull().cast("int"))
    # A type's family is found once, not once a relation.
    counted = rel.groupBy("relation_type", review.alias("review")).agg(F.count(F.lit(1)).alias("n"))
    family = forms.relation_family(F.col("relation_type"))
    return counted.select("relation_type", F.coalesce(family, F.lit("-")).alias("family"), "review", "n", ((family == "conflict").cast("long") * F.col("n")).alias("conflicts"))


def q_topic_overlap(spark, d):
    """How far each turn repeats the topic of the one before it."""
    from pyspark.sql import Window

    c = _table(spark, d, "conversations").withColumn("terms", text.query_terms(F.col("text")))
    by = Window.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.lag("terms").over(by), F.array().cast("array<string>"))
    return c.withColumn("before", before).select("conv_id", "turn", F.round(forms.topic_overlap(F.col("terms"), F.col("before")) * 1e6).cast("long").alias("overlap_e6"))


def q_quote_candidates(spark, d):
    (seg,) = derived(spark, d, "seg")
    return seg.select("segment_id", F.posexplode(forms.quote_candidates(F.col("text"))).alias("pos", "quote")).select("segment_id", F.col("pos").cast("long").alias("pos"), "quote")


def q_questions(spark, d):
    """Benchmark texts and titles written as questions, some without their opening mark."""
    (doc,) = derived(spark, d, "doc")
    asked = doc.select("document_id", F.concat(F.when(F.col("document_id") % 3 > 0, "¿").otherwise(""), "title", F.when(F.col("document_id") % 5 > 0, "? ").otherwise(".")).alias("t"))
    return asked.select("document_id", text.is_question(F.col("t")).alias("question"))


def q_term_variants(spark, d):
    """Query terms of all benchmark texts with their plural and singular forms."""
    terms = _table(spark, d, "benchmark").select(F.explode(text.query_terms(F.col("text"))).alias("term")).distinct()
    return terms.select("term", F.array_join(forms.term_variants(F.col("term")), ",").alias("variants"))


def q_phrase_union(spark, d):
    """Phrases of each conversation without repeats that differ in case and marks only, in order of first use."""
    t = _table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"[.?!]\s*")).alias("pos", "phrase")).where(F.trim("phrase") != "")
    first = t.groupBy("conv_id", forms.fold(forms.collapse(F.col("phrase"))).alias("key")).agg(F.min(F.struct("turn", "pos")).alias("at"))
    return first.groupBy("conv_id").agg(F.count(F.lit(1)).alias("phrases"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]), "|")).alias("digest"))


_M = "regexp_replace({}, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+', ' ', 'g')"
_COL = lambda x: f"trim({_M.format(x)})"
_FOLD = "strip_accents(replace(replace(replace(lower({}), 'ß', 'ss'), 'º', 'o'), 'ª', 'a'))"
_TOK = rf"regexp_extract_all({_FOLD.format('text')}, '[\p{{L}}\p{{N}}]+')"
_TERMS = f"list_filter({_TOK}[:64], lambda t: regexp_full_match(t, '[0-9]+') OR length(t) >= 3)"
_FIRST = "list_filter({x}, lambda t, i: NOT list_contains({x}[:i - 1], t))[:18]"
_AMOUNT = """CAST(CASE WHEN regexp_full_match(x, '[0-9]{1,3}(\\.[0-9]{3})+') THEN replace(x, '.', '') WHEN regexp_full_match(x, '[0-9]+') THEN x ELSE replace(x, ',', '.') END AS DECIMAL(18,4))"""
#: Families by the normal form of the relation type; the lists are fixed values.
FAMILY_SQL = (
    "CASE WHEN {0} IN ('modification', 'modification_of', 'modifies', 'modified_by', 'amends', 'amended_by', 'replaces', 'replaced_by') THEN 'amendment' WHEN {0} IN ('repeal', 'repeal_of', 'repeals', 'repealed_by', 'revokes', 'revoked_by') THEN 'repeal'"
    " WHEN {0} IN ('supersession', 'supersession_of', 'supersedes', 'superseded_by') THEN 'supersession' WHEN {0} IN ('exception', 'exception_to', 'excepts', 'excepted_by') THEN 'exception' WHEN {0} IN ('definition', 'defines', 'defined_by', 'definition_for') THEN 'definition'"
    " WHEN {0} IN ('conflict', 'conflict_with', 'conflicts', 'conflicts_with', 'contradicts', 'inconsistent_with', 'incompatible_with') THEN 'conflict' WHEN {0} IN ('suspends', 'suspended_by', 'extends', 'extended_by', 'effective_from', 'expires') THEN 'temporal' END"
).format("trim(regexp_replace(lower(relation_type), '[^a-z0-9]+', '_', 'g'), '_')")
ORACLES = {
    "text_forms": f"SELECT doc_id, md5(strip_accents(text)) AS stripped, md5({_FOLD.format('text')}) AS folded, md5(upper(replace({_COL('strip_accents(text)')}, 'ß', 'SS'))) AS key, md5({_COL('lower(text)')}) AS plain, CAST(ceil(length(text) / 4) AS BIGINT) AS token_estimate FROM documents",
    "page_forms": f"""WITH p AS (SELECT *, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t FROM pages), u AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS x FROM p)
SELECT page_id, {_COL('x')} AS title, CASE WHEN contains(lower(url), '/normograma/') THEN 'normative_compilation' WHEN regexp_matches(lower(url), '\\.pdf($|[?#])') THEN 'official_document' WHEN regexp_matches(lower(url), '^https?://[^/]*blog') THEN 'blog' WHEN regexp_matches(lower(url), '/(en|fr|de|es)/') THEN 'article' ELSE 'web_page' END AS kind, md5(regexp_replace(replace(t || ' | ' || url, '|', '\\|'), '\\s*[\\r\\n]+\\s*', ' ', 'g')) AS cell, starts_with(url, 'https://') AS secure, contains(lower(url), 'example.net') AS net FROM u""",
    "heading_forms": f"{ctes('doc')} SELECT document_id, document_type AS doc_type, CAST(number AS BIGINT) AS number, CAST(year AS INT) AS year, document_type AS type_key, issuer AS issuer_key, CASE document_type WHEN 'LEY' THEN 'CONGRESO' WHEN 'DECRETO' THEN 'PRESIDENCIA' WHEN 'RESOLUCION' THEN CASE issuer WHEN 'DIAN' THEN 'DIAN' WHEN 'MINHACIENDA' THEN 'MINHACIENDA' END WHEN 'CIRCULAR' THEN CASE issuer WHEN 'DIAN' THEN 'DIAN' END END AS file_issuer, CASE document_type WHEN 'CIRCULAR' THEN 'administrative_instruction' ELSE 'binding_norm' END AS legal_function FROM doc",
    "key_parts": f"""{ctes('ident')}, s AS (SELECT *, string_split(identifier_value, ':') AS p, CASE WHEN identifier_id % 3 = 0 THEN 'doc:' ELSE 'prov:' END || CASE WHEN identifier_id % 7 <> 0 THEN identifier_id::STRING ELSE '' END AS ref FROM ident), g AS (SELECT *, len(p) IN (4, 5) AS good FROM s)
SELECT identifier_id, CASE WHEN good AND len(p) = 5 THEN p[2] END AS issuer, CASE WHEN good THEN p[-3] END AS doc_type, CASE WHEN good THEN p[-2] END AS number, CASE WHEN good THEN CAST(p[-1] AS INT) END AS year, CASE WHEN starts_with(ref, 'doc:') AND length(ref) > 4 THEN ref[5:] END AS doc_ref, regexp_full_match(identifier_value, '[A-Za-z][A-Za-z0-9_.:-]{{0,127}}') AS named, true AS digest FROM g""",
    "article_parts": f"""{ctes('seg')}, a AS (SELECT segment_id, text, regexp_extract(text, '^ARTÍCULO ([0-9]+)\\. ', 1) AS n, regexp_replace(text, '^ARTÍCULO [0-9]+\\.\\s+', '') AS rest FROM seg WHERE starts_with(text, 'ARTÍCULO '))
SELECT segment_id, n AS designation, CASE WHEN starts_with(rest, 'DISPOSICIONES VARIAS. ') THEN 'DISPOSICIONES VARIAS' END AS title, md5(CASE WHEN starts_with(rest, 'DISPOSICIONES VARIAS. ') THEN rest[23:] ELSE rest END) AS body FROM a""",
    "amounts": f"""{ctes('seg')}, f AS (SELECT segment_id, text, regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)*) UVT', 1) AS l FROM seg WHERE contains(text, 'UVT')), e AS (SELECT segment_id, text, unnest(l) AS x, unnest(range(len(l))) AS pos FROM f)
SELECT segment_id, pos, CAST({_AMOUNT} * 10 AS BIGINT) AS value_e1, CAST(replace(regexp_extract(text, '([0-9]+\\.[0-9]{{3}}) UVT', 1), '.', '') AS BIGINT) AS grouped, CASE WHEN contains(lower(text), 'inferior') THEN 'lt' END AS operator FROM e""",
    "threshold_rules": f"""{ctes('seg', 'ext', 'man')}, l AS (SELECT extraction_id, CAST(replace(regexp_extract(text, 'exceder de ([0-9.]+) UVT', 1), '.', '') AS DECIMAL(18,4)) AS lim FROM seg WHERE regexp_matches(text, 'exceder de [0-9.]+ UVT')), r AS (SELECT document_id, count(DISTINCT lim) AS rules, min(lim) AS lim FROM l JOIN ext USING (extraction_id) JOIN man USING (manifestation_id) WHERE status = 'success' AND document_id IS NOT NULL GROUP BY document_id),
s AS (SELECT c_custkey AS document_id, CAST(c_acctbal AS DECIMAL(18,2)) AS observed, rules, lim FROM customer LEFT JOIN r ON document_id = c_custkey), t AS (SELECT *, CASE WHEN rules IS NULL THEN 'no_rule' WHEN rules > 1 THEN 'conflicting_authority' WHEN observed < 0 THEN 'invalid_fact' WHEN observed <= lim THEN 'passes' ELSE 'fails' END AS state FROM s)
SELECT document_id, state, CASE WHEN state IN ('passes', 'fails') THEN regexp_replace(regexp_replace(CAST(CAST(lim - observed AS DECIMAL(18,4)) AS STRING), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END AS margin FROM t""",
    "event_dates": f"{ctes('event')} SELECT event_id, coalesce(effective_from, event_date) AS effective, CASE WHEN event_id % 6 <> 0 AND event_id % 5 <> 0 THEN event_date END AS day, CASE WHEN event_id % 6 = 0 THEN 'not a date: 2024-02-30' END AS error FROM event",
    "relation_families": f"{ctes('rel')}, f AS (SELECT *, {FAMILY_SQL} AS family FROM rel) SELECT relation_type, coalesce(family, '-') AS family, NOT (status = 'validated' AND confidence >= 0.8 AND evidence_id IS NOT NULL) AS review, count(*) AS n, CAST(sum(CASE WHEN family IS NULL THEN NULL WHEN family = 'conflict' THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM f GROUP BY ALL",
    "topic_overlap": f"""WITH c AS (SELECT conv_id, turn, {_TERMS} AS x FROM conversations), t AS (SELECT conv_id, turn, {_FIRST.format(x='x')} AS terms FROM c), b AS (SELECT *, coalesce(lag(terms) OVER (PARTITION BY conv_id ORDER BY turn), []) AS before FROM t)
SELECT conv_id, turn, CAST(round(CASE WHEN least(len(terms), len(before)) > 0 THEN len(list_intersect(terms, before)) / least(len(terms), len(before)) ELSE 0 END * 1e6) AS BIGINT) AS overlap_e6 FROM b""",
    "quote_candidates": f"{ctes('seg')}, q AS (SELECT segment_id, CASE WHEN len(regexp_extract_all(text, 'UVT')) >= 2 THEN list_filter(list_transform(string_split(text, ';'), lambda c: trim(c)), lambda c: contains(c, 'UVT')) ELSE [text] END AS l FROM seg WHERE contains(text, 'UVT')) SELECT segment_id, unnest(range(len(l))) AS pos, unnest(l) AS quote FROM q",
    "questions": f"{ctes('doc')} SELECT document_id, document_id % 3 > 0 AND document_id % 5 > 0 AS question FROM doc",
    "term_variants": f"""WITH c AS (SELECT {_TERMS} AS x FROM benchmark), t AS (SELECT DISTINCT unnest({_FIRST.format(x='x')}) AS term FROM c), v AS (SELECT term, CASE WHEN regexp_full_match(term, '[0-9]+') OR length(term) < 4 THEN term WHEN length(term) > 4 AND ends_with(term, 'es') THEN term[:-3] WHEN length(term) > 4 AND ends_with(term, 's') THEN term[:-2] WHEN regexp_matches(term, '[aeiou]$') THEN term || 's' ELSE term || 'es' END AS o FROM t) SELECT term, CASE WHEN o = term THEN term ELSE term || ',' || o END AS variants FROM v""",
    "phrase_union": f"""WITH p AS (SELECT conv_id, turn, unnest(x) AS phrase, unnest(range(len(x))) AS pos FROM (SELECT conv_id, turn, string_split_regex(text, '[.?!]\\s*') AS x FROM conversations)), k AS (SELECT conv_id, {_FOLD.format(_COL('phrase'))} AS key, min((turn, pos)) AS place FROM p WHERE trim(phrase) <> '' GROUP BY ALL) SELECT conv_id, count(*) AS phrases, md5(string_agg(key, '|' ORDER BY place)) AS digest FROM k GROUP BY conv_id""",
}
QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
