"""Registration of identities over the derived registry, with its DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators import identities
from veritrail.plans.corpus import ctes, derived

#: What each manifestation was found to be: mostly its own document, some a neighbour's act, some undecided.
_STATE = "CASE WHEN manifestation_id % 10 = 3 THEN 'IDENTITY_UNRESOLVED' WHEN document_type IN ('RESOLUCION', 'CIRCULAR') AND issuer IS NULL THEN 'ISSUER_IDENTITY_UNRESOLVED' ELSE 'accepted' END"
_PRESENT = "CASE WHEN manifestation_id % 4 = 1 THEN NULL ELSE 'D' || CAST(document_id AS STRING) END"
_SEEN = "document_id + CASE WHEN manifestation_id % 9 = 0 THEN 1 ELSE 0 END"
_NUMBER = "CASE WHEN document_id % 6 = 0 THEN '00' ELSE '' END || CAST(number AS STRING)"


def _tables(spark, d):
    man, doc, review = derived(spark, d, "man", "doc", "review")
    met = man.where("document_id IS NOT NULL").select("manifestation_id", F.expr(_SEEN).cast("long").alias("document_id")).join(doc, "document_id")
    assessed = met.select("manifestation_id", F.expr(_STATE).alias("state"), "document_type", F.col("number").cast("string").alias("number"), F.col("year").cast("int").alias("year"), "issuer", "title", (F.col("manifestation_id") % 5 == 0).alias("trusted_family"))
    manifestations = man.select("manifestation_id", F.expr(_PRESENT).alias("document_id"))
    key = F.concat_ws(":", F.lit("CO"), F.when(F.col("document_type").isin("RESOLUCION", "CIRCULAR") & (F.col("document_id") % 3 > 0), F.col("issuer")), "document_type", F.expr(_NUMBER), F.col("year").cast("string"))
    own = F.concat(F.lit("D"), F.col("document_id").cast("string"))
    identifiers = doc.select(F.col("document_id").cast("string").alias("identifier_id"), own.alias("document_id"), F.lit("canonical_key").alias("identifier_type"), key.alias("identifier_value"), F.when(F.col("document_id") % 4 > 0, F.col("issuer")).alias("issuer"), F.lit(True).alias("is_primary"))
    documents = doc.select(own.alias("document_id"), F.lit("UNKNOWN").alias("entity"), "document_type", "title")
    reviews = review.select(F.col("review_id").cast("string").alias("review_id"), F.lit("manifestation").alias("entity_type"), F.col("review_id").alias("entity_id"), F.when(F.col("review_id") % 3 == 0, "OTHER").otherwise("IDENTITY_CONFLICT").alias("reason"), F.lit(None).cast("string").alias("resolution"))
    return assessed, manifestations, documents, identifiers, reviews


def q_identity_decisions(spark, d):
    """What registration does with each manifestation."""
    return identities.register(*_tables(spark, d))["decisions"].select("manifestation_id", "outcome", "present_id", F.when(F.col("outcome") == "aliased", F.col("document_id")).alias("kept_id"), "primary_key", "reason")


def q_identity_tables(spark, d):
    """The tables after registration, counted."""
    out = identities.register(*_tables(spark, d))
    counted = lambda name, *what: out[name].agg(F.count(F.lit(1)).alias("rows"), F.count(what[0]).alias("marked")).select(F.lit(name).alias("table"), "rows", "marked")
    return counted("manifestations", "document_id").unionAll(counted("documents", F.when(F.col("entity") == "UNKNOWN", 1))).unionAll(counted("identifiers", F.when(F.col("is_primary"), 1))).unionAll(counted("reviews", "resolution"))


_SCOPED = "document_type IN ('RESOLUCION', 'CIRCULAR')"
_DECIDED = f"""{ctes('man', 'doc', 'review')}, seen AS (SELECT manifestation_id, {_SEEN} AS document_id FROM man WHERE document_id IS NOT NULL), a AS (SELECT manifestation_id, {_STATE} AS state, document_type, CAST(number AS STRING) AS number, year, issuer, title, manifestation_id % 5 = 0 AS trusted FROM seen JOIN doc USING (document_id)),
m AS (SELECT manifestation_id, {_PRESENT} AS present FROM man), k AS (SELECT 'D' || document_id AS present, document_type AS kt, number AS kn, year AS ky, CASE WHEN {_SCOPED} AND document_id % 3 > 0 THEN issuer END AS ki, CASE WHEN document_id % 4 > 0 THEN issuer END AS ri, document_id, 'CO:' || coalesce(CASE WHEN {_SCOPED} AND document_id % 3 > 0 THEN issuer || ':' END, '') || document_type || ':' || {_NUMBER} || ':' || year AS value FROM doc),
x AS (SELECT a.*, present, state = 'accepted' AS ok, 'CO:' || CASE WHEN {_SCOPED} THEN issuer || ':' ELSE '' END || document_type || ':' || number || ':' || year AS key FROM a JOIN m USING (manifestation_id)),
e AS (SELECT x.*, k.value AS same FROM x LEFT JOIN k ON ok AND k.present = x.present AND kt = document_type AND kn = CAST(number AS BIGINT) AND ky = year AND CASE WHEN ki IS NOT NULL THEN {_SCOPED} AND ki = issuer ELSE (NOT {_SCOPED} OR trusted) AND (ri IS NULL OR issuer IS NULL OR ri = issuer) END),
o AS (SELECT *, CASE WHEN NOT ok THEN 'unresolved' WHEN present IS NULL THEN 'registered' WHEN same IS NULL THEN 'conflict' ELSE 'aliased' END AS outcome FROM e),
dec AS (SELECT *, CASE WHEN outcome = 'aliased' AND NOT trusted THEN same WHEN outcome IN ('aliased', 'registered') THEN key END AS primary_key, CASE outcome WHEN 'unresolved' THEN state WHEN 'conflict' THEN 'SOURCE_IDENTITY_CONFLICT' END AS reason, CASE outcome WHEN 'aliased' THEN present WHEN 'registered' THEN 'N' || key END AS bound FROM o)"""
ORACLES = {
    "identity_decisions": f"{_DECIDED} SELECT manifestation_id, outcome, present AS present_id, CASE WHEN outcome = 'aliased' THEN present END AS kept_id, primary_key, reason FROM dec",
    "identity_tables": f"""{_DECIDED}, g AS (SELECT bound, value, bool_or(p) AS p FROM (SELECT bound, primary_key AS value, true AS p FROM dec WHERE bound IS NOT NULL UNION ALL SELECT bound, 'CO:' || document_type || ':' || number || ':' || year, false FROM dec WHERE bound IS NOT NULL AND 'CO:' || document_type || ':' || number || ':' || year <> primary_key) GROUP BY ALL),
ids AS (SELECT coalesce(g.p, true) AS p FROM (SELECT present AS bound, value FROM k) old FULL JOIN g USING (bound, value)), b AS (SELECT DISTINCT bound FROM dec WHERE bound IS NOT NULL), r AS (SELECT review_id, review_id % 3 > 0 AND review_id IN (SELECT manifestation_id FROM dec WHERE bound IS NOT NULL) AS closed FROM review)
SELECT 'manifestations' AS "table", count(*) AS rows, count(CASE WHEN dec.manifestation_id IS NOT NULL THEN bound ELSE m.present END) AS marked FROM m LEFT JOIN dec USING (manifestation_id) UNION ALL SELECT 'documents', count(*), count(CASE WHEN b.bound IS NULL THEN 1 END) FROM k FULL JOIN b ON b.bound = k.present UNION ALL SELECT 'identifiers', count(*), count(CASE WHEN p THEN 1 END) FROM ids UNION ALL SELECT 'reviews', (SELECT count(*) FROM review) + (SELECT count(*) FROM dec WHERE reason IS NOT NULL), (SELECT count(*) FROM r WHERE closed)""",
}
QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
