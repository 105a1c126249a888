"""Audits and joins over the derived registry, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import doctor
from veritrail.plans.corpus import TABLES, ctes, derived


def _family_mismatch(man: DataFrame, src: DataFrame, doc: DataFrame) -> DataFrame:
    family = F.upper(F.regexp_extract("source_url", "/(ley|decreto|resolucion|circular)_[^/]*$", 1))
    bound = man.join(src, "source_id").join(doc, "document_id")
    return bound.where((family != "") & (family != F.col("document_type"))).select(F.concat_ws(":", F.col("manifestation_id").cast("string"), "document_type").alias("example"))


def checks(t: dict[str, DataFrame]) -> dict[tuple[str, str], DataFrame]:
    """All audits of the registry's tables."""
    address = F.concat(F.lit("raw/sha256/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256")
    files = t["files"].withColumnsRenamed({"path": "local_path", "byte_size": "file_size"})
    primary = t["ident"].where("identifier_type = 'primary'")
    with_segment = t["evid"].join(t["seg"].select("segment_id", "extraction_id"), "segment_id", "left").join(t["ext"].select("extraction_id", F.col("manifestation_id").alias("via")), "extraction_id", "left")
    entities = {"document": (t["doc"], "document_id"), "provision": (t["prov"], "provision_id")}
    validated = t["rel"].where("status = 'validated'")
    actual = t["event"].groupBy("document_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("review").cast("long")), F.lit(0)).alias("n_review"))
    counted = t["recorded"].join(actual.select("document_id", "event_type", F.col("n").alias("a"), F.col("n_review").alias("b")), ["document_id", "event_type"], "left")
    return {
        ("DB-002", "db"): doctor.missing_parent(t["obs"], "extraction_id", t["ext"], "extraction_id", "observation_id", "extraction_id"),
        ("RAW-001", "raw"): doctor.missing_parent(t["man"].withColumn("local_path", address), "local_path", files, "local_path", "manifestation_id"),
        ("RAW-002", "raw"): doctor.differs(t["man"], files, "local_path", "byte_size", "file_size", "manifestation_id", "byte_size"),
        ("RAW-003", "raw"): t["man"].where(F.col("local_path") != address).select(F.col("manifestation_id").cast("string").alias("example")),
        ("RAW-004", "raw"): doctor.differs(t["man"], files, "local_path", "sha256", "content_hash", "manifestation_id"),
        ("ARTIFACT-003", "artifact"): t["seg"].where(F.md5("text") != F.col("text_hash")).select(F.col("segment_id").cast("string").alias("example")),
        ("PROV-001", "provenance"): doctor.differs(t["evid"], t["man"], "manifestation_id", "source_sha256", "sha256", "evidence_id"),
        ("PROV-002", "provenance"): with_segment.where(F.col("via").isNull() | (F.col("via") != F.col("manifestation_id"))).select(F.col("evidence_id").cast("string").alias("example")),
        ("PROV-003", "provenance"): doctor.missing_parent(validated.withColumn("claim", F.col("relation_id")), "claim", t["evid"].where("owner_type = 'claim'"), "owner_id", "relation_id"),
        ("IDENTITY-001", "identity"): doctor.more_than_one(primary, "identifier_value", "document_id"),
        ("IDENTITY-002", "identity"): doctor.key_shape(t["ident"]),
        ("IDENTITY-003", "identity"): _family_mismatch(t["man"], t["src"], t["doc"]),
        ("PROVISION-001", "provision"): doctor.differs(t["obs"], t["seg"], "segment_id", "extraction_id", "extraction_id", "observation_id"),
        ("REF-001", "reference"): doctor.missing_parent(t["mention"], "segment_id", t["seg"], "segment_id", "mention_id"),
        ("REF-002", "reference"): doctor.resolution_faults(t["res"]),
        ("REL-001", "relation"): doctor.registered(t["rel"], "target_type", "target_id", entities, "relation_id", "target_type"),
        ("REL-002", "relation"): validated.join(t["evid"].select("evidence_id", F.col("segment_id").alias("s")), "evidence_id", "left").where("s IS NULL").select(F.col("relation_id").cast("string").alias("example")),
        ("TEMP-001", "temporal"): doctor.missing_parent(t["event"], "document_id", t["doc"], "document_id", "event_id", "document_id"),
        ("TEMP-002", "temporal"): counted.where((F.col("a") != F.col("n")) | (F.col("b") != F.col("n_review")) | F.col("a").isNull()).select(F.concat_ws(":", F.col("document_id").cast("string"), "event_type").alias("example")),
        ("REVIEW-001", "review"): doctor.registered(t["review"], "entity_type", "entity_id", entities | {"mention": (t["mention"], "mention_id")}, "review_id", "entity_type"),
        ("FTS-001", "fts"): doctor.out_of_sync(t["seg"], t["fts"], "segment_id", "extraction_id"),
        ("CASE-001", "case"): doctor.registered(t["rel"], "source_type", "source_id", entities, "relation_id", "source_type"),
    }


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All derived tables; most checks read lines, which are written once.  No check moves a text."""
    return dict(zip(TABLES, derived(spark, d, *TABLES, once=True), strict=True))


def q_doctor_full(spark, d):
    """Every audit of the registry, with counts and the first ten examples."""
    return doctor.report(checks(_tables(spark, d)))


def q_doctor_scope(spark, d):
    """The audits of two scopes."""
    return doctor.report(checks(_tables(spark, d)), ["identity", "relation"]).select("check_id", "status", "n")


def q_duplicate_edges(spark, d):
    """Edges that occur twice or more, missing evidence compared as equal."""
    (rel,) = derived(spark, d, "rel")
    kind = F.coalesce(F.col("evidence_id") % 5, F.lit(-1)).alias("evidence")
    return doctor.duplicates(rel.select("source_type", "source_id", "relation_type", "target_id", kind), "source_type", "source_id", "relation_type", "target_id", "evidence")


_ADDRESS = "'raw/sha256/' || substr(sha256, 1, 2) || '/' || sha256"
_S = "CAST({} AS STRING)"
_CHECKS = f"""
SELECT 'DB-002' AS check_id, 'db' AS scope, 'ERROR' AS severity, observation_id || ':' || extraction_id AS example FROM obs WHERE extraction_id NOT IN (SELECT extraction_id FROM ext)
UNION ALL SELECT 'RAW-001', 'raw', 'ERROR', manifestation_id::STRING FROM man WHERE {_ADDRESS} NOT IN (SELECT path FROM files)
UNION ALL SELECT 'RAW-002', 'raw', 'ERROR', manifestation_id || ':' || man.byte_size FROM man JOIN files ON path = local_path WHERE man.byte_size <> files.byte_size
UNION ALL SELECT 'RAW-003', 'raw', 'ERROR', manifestation_id::STRING FROM man WHERE local_path <> {_ADDRESS}
UNION ALL SELECT 'RAW-004', 'raw', 'ERROR', manifestation_id::STRING FROM man JOIN files ON path = local_path WHERE content_hash <> sha256
UNION ALL SELECT 'ARTIFACT-003', 'artifact', 'ERROR', segment_id::STRING FROM seg WHERE md5(text) <> text_hash
UNION ALL SELECT 'PROV-001', 'provenance', 'ERROR', evidence_id::STRING FROM evid JOIN man USING (manifestation_id) WHERE source_sha256 <> sha256
UNION ALL SELECT 'PROV-002', 'provenance', 'ERROR', evidence_id::STRING FROM evid LEFT JOIN seg USING (segment_id) LEFT JOIN ext USING (extraction_id) WHERE ext.manifestation_id IS NULL OR ext.manifestation_id <> evid.manifestation_id
UNION ALL SELECT 'PROV-003', 'provenance', 'ERROR', relation_id::STRING FROM rel WHERE status = 'validated' AND NOT EXISTS (SELECT 1 FROM evid WHERE owner_type = 'claim' AND owner_id = relation_id)
UNION ALL SELECT 'IDENTITY-001', 'identity', 'ERROR', identifier_value FROM ident WHERE identifier_type = 'primary' GROUP BY identifier_value HAVING count(DISTINCT document_id) > 1
UNION ALL SELECT 'IDENTITY-002', 'identity', 'ERROR', identifier_id || ':' || identifier_value FROM ident WHERE identifier_type = 'primary' AND NOT regexp_full_match(identifier_value, 'CO:(LEY|DECRETO):[0-9]+[A-Z]?:[0-9]{{4}}|CO:[A-Z]+:[A-Z_]+:[0-9]+[A-Z]?:[0-9]{{4}}')
UNION ALL SELECT 'IDENTITY-003', 'identity', 'ERROR', manifestation_id || ':' || document_type FROM man JOIN src USING (source_id) JOIN doc USING (document_id) WHERE regexp_extract(source_url, '/(ley|decreto)_', 1) <> '' AND upper(regexp_extract(source_url, '/(ley|decreto)_', 1)) <> document_type
UNION ALL SELECT 'PROVISION-001', 'provision', 'ERROR', observation_id::STRING FROM obs JOIN seg USING (segment_id) WHERE obs.extraction_id <> seg.extraction_id
UNION ALL SELECT 'REF-001', 'reference', 'ERROR', mention_id::STRING FROM mention WHERE segment_id NOT IN (SELECT segment_id FROM seg)
UNION ALL SELECT 'REF-002', 'reference', 'ERROR', mention_id || ':' || unnest(list_filter([CASE WHEN status = 'resolved' AND target_document_id IS NULL THEN 'no_target' END, CASE WHEN status <> 'resolved' AND target_document_id IS NOT NULL THEN 'stray_target' END, CASE WHEN status <> 'resolved' AND reason IS NULL THEN 'no_reason' END, CASE WHEN status = 'resolved' AND reason IS NOT NULL THEN 'stray_reason' END, CASE WHEN method IS NULL THEN 'no_method' END], lambda x: x IS NOT NULL)) FROM res
UNION ALL SELECT 'REL-001', 'relation', CASE WHEN target_type IN ('document', 'provision') THEN 'ERROR' ELSE 'WARN' END, relation_id || ':' || target_type FROM rel WHERE NOT (target_type = 'document' AND target_id IN (SELECT document_id FROM doc)) AND NOT (target_type = 'provision' AND target_id IN (SELECT provision_id FROM prov))
UNION ALL SELECT 'REL-002', 'relation', 'ERROR', relation_id::STRING FROM rel LEFT JOIN evid USING (evidence_id) WHERE status = 'validated' AND segment_id IS NULL
UNION ALL SELECT 'TEMP-001', 'temporal', 'ERROR', event_id || ':' || document_id FROM event WHERE document_id NOT IN (SELECT document_id FROM doc)
UNION ALL SELECT 'TEMP-002', 'temporal', 'ERROR', r.document_id || ':' || r.event_type FROM recorded r LEFT JOIN (SELECT document_id, event_type, count(*) AS a, count(*) FILTER (review) AS b FROM event GROUP BY ALL) e USING (document_id, event_type) WHERE a <> n OR b <> n_review OR a IS NULL
UNION ALL SELECT 'REVIEW-001', 'review', CASE WHEN entity_type = 'note' THEN 'WARN' ELSE 'ERROR' END, review_id || ':' || entity_type FROM review WHERE NOT (entity_type = 'document' AND entity_id IN (SELECT document_id FROM doc)) AND NOT (entity_type = 'provision' AND entity_id IN (SELECT provision_id FROM prov)) AND NOT (entity_type = 'mention' AND entity_id IN (SELECT mention_id FROM mention))
UNION ALL SELECT 'FTS-001', 'fts', 'ERROR', CASE WHEN f.segment_id IS NULL THEN 'missing:' || s.segment_id WHEN s.segment_id IS NULL THEN 'stray:' || f.segment_id ELSE 'differs:' || s.segment_id END FROM seg s FULL JOIN fts f ON s.segment_id = f.segment_id WHERE s.segment_id IS NULL OR f.segment_id IS NULL OR s.extraction_id <> f.extraction_id
UNION ALL SELECT 'CASE-001', 'case', 'ERROR', relation_id || ':' || source_type FROM rel WHERE NOT (source_type = 'document' AND source_id IN (SELECT document_id FROM doc)) AND NOT (source_type = 'provision' AND source_id IN (SELECT provision_id FROM prov))"""
_NAMES = "('DB-002','db'),('RAW-001','raw'),('RAW-002','raw'),('RAW-003','raw'),('RAW-004','raw'),('ARTIFACT-003','artifact'),('PROV-001','provenance'),('PROV-002','provenance'),('PROV-003','provenance'),('IDENTITY-001','identity'),('IDENTITY-002','identity'),('IDENTITY-003','identity'),('PROVISION-001','provision'),('REF-001','reference'),('REF-002','reference'),('REL-001','relation'),('REL-002','relation'),('TEMP-001','temporal'),('TEMP-002','temporal'),('REVIEW-001','review'),('FTS-001','fts'),('CASE-001','case')"
_DOCTOR = f"{ctes(*TABLES)}, fail AS ({_CHECKS}), ranked AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY example) AS r FROM fail), every(check_id, scope) AS (VALUES {_NAMES})"

ORACLES = {
    "doctor_full": f"{_DOCTOR} SELECT e.check_id, e.scope, coalesce(min(severity), 'PASS') AS status, count(f.example) AS n, coalesce(string_agg(f.example, '; ' ORDER BY f.example) FILTER (r <= 10), '') AS examples FROM every e LEFT JOIN ranked f ON f.check_id = e.check_id GROUP BY e.check_id, e.scope",
    "doctor_scope": f"{_DOCTOR} SELECT e.check_id, coalesce(min(severity), 'PASS') AS status, count(f.example) AS n FROM every e LEFT JOIN fail f ON f.check_id = e.check_id WHERE e.scope IN ('identity', 'relation') GROUP BY e.check_id",
    "duplicate_edges": f"{ctes('rel')} SELECT source_type || ':' || source_id || ':' || relation_type || ':' || target_id || ':' || coalesce(evidence_id % 5, -1) AS example FROM rel GROUP BY source_type, source_id, relation_type, target_id, coalesce(evidence_id % 5, -1) HAVING count(*) > 1",
}
QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
