"""Provisions and citable context over the derived registry, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators import context, provisions
from veritrail.plans.corpus import ctes, derived
from veritrail.sources.shared import written

_DIALECT = "CASE CAST(extraction_id AS BIGINT) % 3 WHEN 0 THEN 'compiled' WHEN 1 THEN 'statute' ELSE 'simple' END"
#: Articles in the wording of their dialect, some with a note, some without a title.
_HEADED = (
    "CASE WHEN segment_type <> 'article' THEN text ELSE CASE CAST(extraction_id AS BIGINT) % 3 WHEN 0 THEN replace(text, 'ARTÍCULO ', 'ARTÍCULO 1.2.') WHEN 1 THEN replace(replace(text, '. DISPOSICIONES', '-1. <Artículo adicionado por la Ley 5 de 1990>  DISPOSICIONES'), '. Vigencia. ', 'a ')"
    " ELSE replace(replace(text, 'ARTÍCULO ', 'Artículo 0'), '. Vigencia. ', 'o. <Numeral 2 derogado> VIGENCIA. ') END END"
)
_TYPE = "CASE WHEN segment_type = 'article' AND CAST(extraction_id AS BIGINT) % 3 = 0 THEN 'regulatory_article' ELSE segment_type END"


def _articles(spark, d):
    seg, ext, man = derived(spark, d, "seg", "ext", "man")
    chain = seg.join(ext.where("status = 'success'").select("extraction_id", "manifestation_id"), "extraction_id").join(man.select("manifestation_id", "document_id"), "manifestation_id")
    return chain.select("segment_id", "extraction_id", "document_id", "sequence_no", F.expr(_TYPE).alias("segment_type"), F.expr(_HEADED).alias("text"), F.expr(_DIALECT).alias("dialect"))


def q_provision_observations(spark, d):
    """What each article says, apart from its title and notes."""
    return provisions.observe(_articles(spark, d)).select("segment_id", "dialect", "designation", "title", "editorial_note", "normative_sha256")


def q_registered_provisions(spark, d):
    return provisions.provisions_of(provisions.observe(_articles(spark, d))).select("document_id", "designation", "title", "observations")


def _places(spark, d):
    """Segments in places, some of them shared or of another document, with the provisions that they are seen for."""
    seg, ext, man = derived(spark, d, "seg", "ext", "man")
    chain = seg.join(ext.where("status = 'success'").select("extraction_id", "manifestation_id"), "extraction_id").join(man.select("manifestation_id", F.col("document_id").alias("own")), "manifestation_id")
    place = F.expr("CASE WHEN sequence_no = 5 AND extraction_id % 9 = 0 THEN 4 ELSE sequence_no END")
    document = F.expr("CASE WHEN sequence_no = 6 AND extraction_id % 5 = 0 THEN own + 1 ELSE own END").cast("long")
    segs = chain.select("segment_id", "extraction_id", place.alias("sequence_no"), document.alias("document_id"), "text", F.sha2(F.when(F.col("segment_id") % 53 == 0, "x").otherwise(F.col("text")), 256).alias("text_sha256"))
    said = F.when(F.col("segment_id") % 17 == 0, "e").otherwise(F.col("text"))
    seen = seg.where("segment_id % 11 <> 0").select("segment_id", F.expr("extraction_id * 10 + CAST(floor(sequence_no / 4) AS BIGINT)").alias("provision_id"), said.alias("normative_text"), F.sha2(said, 256).alias("normative_sha256"), F.explode(F.expr("CASE WHEN segment_id % 13 = 0 THEN array(1, 2) ELSE array(1) END")).alias("time"))
    return segs, seen.drop("time")


def q_citable_segments(spark, d):
    return context.citable(*_places(spark, d)).select("segment_id", "citable_state", "provision_id")


def q_citable_context(spark, d):
    """Context of every segment and of as many that are not there, with a budget of three."""
    # Written without its texts, as places, runs, targets and references all read it.
    state = written(context.citable(*_places(spark, d)).drop("text"), "citable")
    mention, res = derived(spark, d, "mention", "res")
    target = F.expr("CASE WHEN mention_id % 5 = 0 THEN NULL WHEN mention_id % 7 = 0 THEN -1 ELSE extraction_id * 10 + mention_id % 2 END")
    met = mention.join(res.select("mention_id", "status"), "mention_id").join(state.select("segment_id", "extraction_id", "document_id"), "segment_id")
    references = met.select("segment_id", "mention_id", F.col("status").alias("state"), F.col("document_id").alias("target_document_id"), target.alias("target_provision_id"))
    anchors = derived(spark, d, "seg")[0].select(F.col("segment_id").alias("anchor_id"), F.expr("CASE WHEN segment_id % 19 = 0 THEN CAST(7 AS BIGINT) END").alias("asked_provision"))
    out = context.context(anchors, state, references, 3)
    reasons = F.array_join(F.array_sort(F.array_distinct(F.transform("gaps", lambda g: g["reason"]))), ",")
    hits = F.array_join(F.transform("hits", lambda h: h["segment_id"].cast("string")), ",")
    return out.select("anchor_id", "status", hits.alias("hits"), reasons.alias("reasons"), F.size("gaps").cast("long").alias("gaps"), "exhausted", "candidates")


_CHAIN = "seg JOIN ext USING (extraction_id) JOIN man USING (manifestation_id)"
_OBSERVED = rf"""{ctes('seg', 'ext', 'man')}, a AS (SELECT segment_id, extraction_id, sequence_no, document_id, {_DIALECT} AS dialect, segment_type, trim({_HEADED}) AS text FROM {_CHAIN} WHERE status = 'success' AND document_id IS NOT NULL AND segment_type = 'article'),
h AS (SELECT *, CASE dialect WHEN 'compiled' THEN regexp_extract(text, '^ART[IÍ]CULO\s+([0-9]+(\.[0-9]+){{2,}})\s*\.?\s*', 0, 'i') WHEN 'statute' THEN regexp_extract(text, '^ART[IÍ]CULO\s+([0-9]+(-[0-9]+)?[A-Z]?)\s*\.?\s*', 0, 'i') ELSE regexp_extract(text, '^ART[IÍ]CULO\s+([0-9]+)[oOº°]?\s*\.\s*', 0, 'i') END AS head FROM a),
r AS (SELECT *, trim(text[length(head) + 1:]) AS rest FROM h WHERE head <> ''), n AS (SELECT *, nullif(regexp_extract(rest, '<((Art[ií]culo|Inciso|Numeral)[^>]+)>', 1), '') AS note FROM r),
s AS (SELECT *, CASE WHEN note IS NULL THEN rest ELSE trim(regexp_replace(replace(rest, '<' || note || '>', ' '), '\s+', ' ', 'g')) END AS said FROM n),
t AS (SELECT *, regexp_extract(said, '^([A-ZÁÉÍÓÚÜÑ0-9 ,;:/()-]+?)\.\s+(.+)$', 1) AS title FROM s),
o AS (SELECT segment_id, extraction_id, sequence_no, document_id, dialect, CASE dialect WHEN 'simple' THEN ltrim(regexp_extract(head, '[0-9]+'), '0') ELSE upper(regexp_extract(head, '\s([0-9]\S*?)\.?\s*$', 1)) END AS designation, nullif(trim(title), '') AS title, note AS editorial_note, CASE WHEN title = '' THEN said ELSE trim(said[length(title) + 2:]) END AS body FROM t)"""
_PLACED = f"""{ctes('seg', 'ext', 'man', 'mention', 'res').replace('WITH', 'WITH RECURSIVE')}, c0 AS (SELECT segment_id, extraction_id, CASE WHEN sequence_no = 5 AND extraction_id % 9 = 0 THEN 4 ELSE sequence_no END AS seq, CASE WHEN sequence_no = 6 AND extraction_id % 5 = 0 THEN document_id + 1 ELSE document_id END AS doc, text,
 CASE WHEN segment_id % 11 = 0 THEN 'no_observation' WHEN segment_id % 13 = 0 THEN 'several_observations' WHEN segment_id % 53 = 0 THEN 'fingerprint_mismatch' WHEN segment_id % 17 = 0 AND length(text) - length(replace(text, 'e', '')) <> 1 THEN 'no_single_anchor' ELSE 'citable' END AS state, extraction_id * 10 + CAST(floor(sequence_no / 4) AS BIGINT) AS p FROM {_CHAIN} WHERE status = 'success'),
c AS (SELECT *, CASE WHEN state = 'citable' THEN p END AS prov FROM c0)"""
_CONTEXT = f"""{_PLACED}, pos AS (SELECT extraction_id, seq, count(*) AS n, min(segment_id) AS sid, arg_min(doc, segment_id) AS doc, arg_min(prov, segment_id) AS prov FROM c GROUP BY ALL),
an AS (SELECT g.segment_id AS a, CASE WHEN g.segment_id % 19 = 0 THEN 7 END AS asked, c.extraction_id AS e, c.seq, c.doc, c.prov, pos.n, CASE WHEN c.segment_id IS NULL THEN 'anchor_missing' WHEN c.doc IS NULL THEN 'anchor_document_unresolved' WHEN c.prov IS NULL THEN 'anchor_provision_not_citable' WHEN g.segment_id % 19 = 0 AND c.prov <> 7 THEN 'anchor_provision_mismatch' END AS failed FROM seg g LEFT JOIN c ON c.segment_id = g.segment_id LEFT JOIN pos ON pos.extraction_id = c.extraction_id AND pos.seq = c.seq),
walk AS (SELECT a, e, doc, prov, d AS dir, seq, 0 AS step, a AS sid FROM an, (VALUES (1), (-1)) v(d) WHERE failed IS NULL AND n = 1 UNION ALL SELECT a, e, w.doc, w.prov, dir, pos.seq, step + 1, pos.sid FROM walk w JOIN pos ON pos.extraction_id = e AND pos.seq = w.seq + dir WHERE pos.n = 1 AND pos.doc = w.doc AND pos.prov = w.prov),
ends AS (SELECT a, e, doc, prov, dir, arg_max(seq, step) AS seq FROM walk GROUP BY ALL),
stops AS (SELECT a, dir, CASE WHEN pos.n > 1 THEN 'ambiguous_contiguous_sequence' WHEN pos.doc IS DISTINCT FROM ends.doc THEN 'document_boundary_mismatch' WHEN pos.prov IS NULL THEN 'unverified_contiguous_boundary' END AS reason, CASE WHEN pos.n > 1 THEN a ELSE sid END AS source FROM ends JOIN pos ON pos.extraction_id = e AND pos.seq = ends.seq + dir UNION ALL SELECT a, 1, 'ambiguous_contiguous_sequence', a FROM an WHERE failed IS NULL AND n > 1),
near AS (SELECT a, count(*) FILTER (step > 0) AS k FROM walk GROUP BY a), sources AS (SELECT a, CASE WHEN step = 0 THEN 0 WHEN dir = 1 THEN step ELSE 100 + step END AS place, sid AS source FROM walk JOIN near USING (a) WHERE k <= 3 AND (step > 0 OR dir = 1) UNION ALL SELECT a, 0, a FROM an WHERE failed IS NULL AND n > 1),
ref AS (SELECT m.segment_id AS source, m.mention_id, res.status, c.doc AS td, CASE WHEN m.mention_id % 5 = 0 THEN NULL WHEN m.mention_id % 7 = 0 THEN -1 ELSE c.extraction_id * 10 + m.mention_id % 2 END AS tp FROM mention m JOIN res USING (mention_id) JOIN c ON c.segment_id = m.segment_id),
tgt AS (SELECT *, row_number() OVER (PARTITION BY doc, prov ORDER BY extraction_id, seq, segment_id) AS hit FROM (SELECT * FROM c WHERE prov IS NOT NULL AND doc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, prov, extraction_id, text ORDER BY seq, segment_id) = 1)),
ev AS (SELECT a, CASE WHEN dir = 1 THEN 0 ELSE 1 END AS part, step AS place, 0 AS mention, 0 AS hit, sid, prov, NULL AS reason, a AS source, CAST(NULL AS BIGINT) AS mid FROM walk WHERE step > 0 UNION ALL SELECT a, CASE WHEN dir = 1 THEN 0 ELSE 1 END, 1000000, 0, 0, NULL, NULL, reason, source, NULL FROM stops WHERE reason IS NOT NULL
 UNION ALL SELECT a, 2, place, mention_id, coalesce(tgt.hit, 0), tgt.segment_id, tp, CASE WHEN status <> 'resolved' THEN 'reference_resolution_incomplete' WHEN td IS NULL OR tp IS NULL THEN 'reference_without_provision_target' WHEN tgt.segment_id IS NULL THEN 'reference_target_context_unavailable' END, source, mention_id FROM sources JOIN ref USING (source) LEFT JOIN tgt ON status = 'resolved' AND tgt.doc = td AND tgt.prov = tp AND tgt.hit <= 4),
num AS (SELECT *, CASE WHEN sid <> a AND row_number() OVER (PARTITION BY a, sid, prov ORDER BY part, place, mention, hit) = 1 THEN 1 ELSE 0 END AS new FROM ev), cum AS (SELECT *, sum(new) OVER (PARTITION BY a ORDER BY part, place, mention, hit) AS found FROM num), cut AS (SELECT * FROM cum WHERE found - new <= 3),
agg AS (SELECT a, coalesce(max(found), 0) AS k, coalesce(string_agg(sid::VARCHAR, ',' ORDER BY found) FILTER (new = 1 AND found <= 3), '') AS hits, list(DISTINCT {{'r': reason, 's': source, 'm': mid}}) FILTER (reason IS NOT NULL) AS g FROM cut GROUP BY a),
fin AS (SELECT an.a, coalesce(k, 0) AS k, coalesce(hits, '') AS hits, CASE WHEN failed IS NOT NULL THEN [failed] ELSE list_concat(coalesce(list_transform(g, lambda x: x.r), []), list_concat(CASE WHEN coalesce(k, 0) > 3 THEN ['budget_exhausted'] ELSE [] END, CASE WHEN coalesce(k, 0) = 0 AND g IS NULL THEN ['no_verified_context'] ELSE [] END)) END AS rs FROM an LEFT JOIN agg ON agg.a = an.a)
SELECT a AS anchor_id, CASE WHEN len(rs) = 0 THEN 'expanded_verified' ELSE 'incomplete' END AS status, hits, array_to_string(list_sort(list_distinct(rs)), ',') AS reasons, CAST(len(rs) AS BIGINT) AS gaps, k > 3 AS exhausted, CAST(k AS BIGINT) AS candidates FROM fin"""
ORACLES = {
    "provision_observations": f"{_OBSERVED} SELECT segment_id, dialect, designation, title, editorial_note, sha256(body) AS normative_sha256 FROM o",
    "registered_provisions": f"{_OBSERVED} SELECT document_id, designation, CASE WHEN bool_or(dialect <> 'compiled') THEN arg_min(title, (extraction_id, sequence_no)) FILTER (title IS NOT NULL) ELSE arg_max(title, (extraction_id, sequence_no)) FILTER (title IS NOT NULL) END AS title, count(*) AS observations FROM o GROUP BY document_id, designation",
    "citable_segments": f"{_PLACED} SELECT segment_id, state AS citable_state, prov AS provision_id FROM c",
    "citable_context": _CONTEXT,
}
QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
