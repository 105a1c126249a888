"""Documents through their stages over the derived registry, with the DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.plans.corpus import ctes, derived
from veritrail.streaming.stages import Stage, outcome, process


def _counted(due: DataFrame, rows: DataFrame, result, error=None, ends=None) -> DataFrame:
    """A stage over what belongs to each extraction: its outcome from sums over ``rows``."""
    return due.select("extraction_id").join(rows, "extraction_id").groupBy("extraction_id").agg(outcome(result, error, ends).alias("outcome"))


def document_stages(seg: DataFrame, mention: DataFrame, res: DataFrame, rel: DataFrame) -> list[Stage]:
    """Fetch, extract, register (or identify instead), detect, date, resolve, promote, discover."""
    own = F.floor(F.col("segment_id") / 10).alias("extraction_id")
    n, key = F.count(F.lit(1)), F.col("extraction_id")
    heading = F.count_if(F.col("segment_type") == "document_heading")
    cited = mention.select(F.floor(F.col("mention_id") / 10).alias("extraction_id"), "mention_id", "article")
    met = cited.join(res.select("mention_id", "status"), "mention_id")
    promoted = rel.select(F.floor(F.col("relation_id") / 10).alias("extraction_id"), "status", "evidence_id")
    chapters = F.count_if(F.col("segment_type") == "section_heading")
    return [
        Stage("fetch", outcome(F.col("sha256"), F.when(F.col("status") != "success", "not found"), F.when(key % 10 == 0, "no_page")), fatal=True),
        Stage("extract", lambda due: _counted(due, seg.select(own, "segment_type"), n, F.when((heading == 0) & (chapters == 0), "legal document heading was not detected"), F.when(heading == 0, "index")), ("fetch",), fatal=True),
        Stage("register_act", outcome(F.col("document_id"), F.when(F.col("document_id").isNull(), "no identity").when(key % 6 == 0, "other dialect")), ("extract",)),
        Stage("register_identity", outcome(F.col("document_id"), F.when(F.col("document_id").isNull(), "no identity")), ("extract",), instead_of="register_act"),
        Stage("detect", lambda due: _counted(due, cited, n, F.when(F.count_if(F.col("article") == "") > 0, "article without number")), ("extract",)),
        Stage("temporality", outcome(F.col("retrieved_at").cast("date"), F.when(key % 14 == 1, "no date")), ("extract",), when=F.col("document_id").isNotNull()),
        Stage("resolve", lambda due: _counted(due, met, F.count_if(F.col("status") == "resolved")), ("detect",)),
        Stage("promote", lambda due: _counted(due, promoted, F.count_if((F.col("status") == "validated") & F.col("evidence_id").isNotNull()), F.when(F.count_if(F.col("evidence_id").isNull()) > 1, "partial promotion refused")), ("detect", "resolve")),
        Stage("discover", outcome(key % 5, F.when(key % 17 == 0, "unreadable links")), ("extract",)),
    ]


def pages(ext: DataFrame, man: DataFrame) -> DataFrame:
    return ext.select("extraction_id", "manifestation_id", "status").join(man.select("manifestation_id", "document_id", "sha256", "retrieved_at"), "manifestation_id")


def q_staged_documents(spark, d):
    """Every document after all stages: its state, how far it came and what it warns of."""
    ext, man, *rest = derived(spark, d, "ext", "man", "seg", "mention", "res", "rel")
    out = process(pages(ext, man), document_stages(*rest), "extraction_id")
    done = F.array_join(F.transform("stages", lambda s: F.concat(s["stage"], F.lit("="), s["result"])), ",")
    return out.select("extraction_id", "state", "error", done.alias("stages"), F.array_join("warnings", ",").alias("warnings"))


_SQL = f"""{ctes('ext', 'man', 'seg', 'mention', 'res', 'rel')}, p AS (SELECT extraction_id AS k, status, document_id, sha256, CAST(retrieved_at AS DATE) AS day FROM ext JOIN man USING (manifestation_id)),
s AS (SELECT extraction_id AS k, count(*) AS n, count(*) FILTER (segment_type = 'document_heading') AS h, count(*) FILTER (segment_type = 'section_heading') AS c FROM seg GROUP BY 1), m AS (SELECT mention_id // 10 AS k, count(*) AS n, count(*) FILTER (article = '') AS bad FROM mention GROUP BY 1), r AS (SELECT mention_id // 10 AS k, count(*) FILTER (res.status = 'resolved') AS n FROM mention JOIN res USING (mention_id) GROUP BY 1),
v AS (SELECT relation_id // 10 AS k, count(*) FILTER (status = 'validated' AND evidence_id IS NOT NULL) AS n, count(*) FILTER (evidence_id IS NULL) AS bad FROM rel GROUP BY 1),
f AS (SELECT p.*, s.n AS segs, m.n AS cited, m.bad AS mbad, r.n AS met, v.n AS sent, v.bad AS vbad, CASE WHEN status <> 'success' THEN 'fetch: not found' WHEN k % 10 = 0 THEN NULL WHEN s.n IS NULL THEN 'extract: no result' WHEN h = 0 AND c = 0 THEN 'extract: legal document heading was not detected' END AS error, status = 'success' AS got, status = 'success' AND k % 10 <> 0 AND (h > 0 OR c > 0) AS read, h FROM p LEFT JOIN s USING (k) LEFT JOIN m USING (k) LEFT JOIN r USING (k) LEFT JOIN v USING (k)),
g AS (SELECT *, coalesce(read AND h > 0, false) AS goes FROM f), o AS (SELECT *, goes AND mbad = 0 AS det, CASE WHEN document_id IS NULL THEN 'no identity' WHEN k % 6 = 0 THEN 'other dialect' END AS reg FROM g)
SELECT k AS extraction_id, CASE WHEN error IS NOT NULL THEN 'failed' WHEN NOT goes AND k % 10 = 0 THEN 'no_page' WHEN NOT goes THEN 'index' ELSE 'processed' END AS state, error,
 concat_ws(',', CASE WHEN got THEN 'fetch=' || sha256 END, CASE WHEN read THEN 'extract=' || segs END, CASE WHEN goes AND reg IS NULL THEN 'register_act=' || document_id END, CASE WHEN goes AND reg = 'other dialect' THEN 'register_identity=' || document_id END, CASE WHEN det THEN 'detect=' || cited END, CASE WHEN goes AND document_id IS NOT NULL AND k % 14 <> 1 THEN 'temporality=' || day END, CASE WHEN det THEN 'resolve=' || met END, CASE WHEN det AND vbad <= 1 THEN 'promote=' || sent END, CASE WHEN goes AND k % 17 <> 0 THEN 'discover=' || k % 5 END) AS stages,
 concat_ws(',', CASE WHEN goes THEN 'register_act: ' || reg END, CASE WHEN goes AND reg = 'no identity' THEN 'register_identity: no identity' END, CASE WHEN goes AND NOT det THEN 'detect: article without number' END, CASE WHEN goes AND document_id IS NOT NULL AND k % 14 = 1 THEN 'temporality: no date' END, CASE WHEN det AND vbad > 1 THEN 'promote: partial promotion refused' END, CASE WHEN goes AND k % 17 = 0 THEN 'discover: unreadable links' END) AS warnings FROM o"""
ORACLES = {"staged_documents": _SQL}
QUERIES = {"staged_documents": q_staged_documents}
