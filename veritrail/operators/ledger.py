"""A ledger of detection runs: each extraction is read once by each version of a detector, however often the job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.ids import prefixed_id
from veritrail.operators import citations
from veritrail.sources.shared import written

#: What finds citations here, and the version whose results the ledger holds; a new version reads everything again.
DETECTOR, VERSION = "citations", "3"


def run_id(extraction: Column, detector: str = DETECTOR, version: str = VERSION) -> Column:
    return prefixed_id("RDR", extraction.cast("string"), F.lit(detector), F.lit(version))


def pending(segments: DataFrame, runs: DataFrame, version: str = VERSION) -> DataFrame:
    """Segments of extractions that this version has no run for; the ledger is met by run, not by segment."""
    fresh = segments.select("extraction_id").distinct().withColumn("run_id", run_id(F.col("extraction_id"), version=version)).join(runs.select("run_id"), "run_id", "left_anti")
    return segments.join(fresh, "extraction_id")


def detect(segments: DataFrame, runs: DataFrame, version: str = VERSION) -> dict[str, DataFrame]:
    """``mentions``, ``relations`` and ``runs`` that segments (segment_id, extraction_id, segment_type, text) add to the ledger ``runs`` (run_id, extraction_id, version, mention_count, relation_count).

    Only pending extractions are read.  Ids follow from run, segment and span,
    so a repeated job adds nothing, and a job that failed half-way adds the
    same rows.  An extraction in which nothing is found has a run of zeros.
    """
    todo = pending(segments, runs, version)
    texts = todo.select(F.col("segment_id").alias("text_id"), "text", "segment_type")
    own = todo.select(F.col("segment_id").alias("text_id"), "extraction_id", "run_id")
    # What is found is written once: counts, announced and noted relations all read it.
    spans = written(citations.mentions(texts), "mentions")
    acting = texts.where(citations.operational(F.col("segment_type"), F.col("text")))
    said = citations.announced(spans.join(acting.select("text_id"), "text_id", "left_semi"), citations.triggers(acting)).drop("at")
    noted = citations.noted(texts, spans.where("mention_type = 'article'"))
    mention_id = prefixed_id("REF", F.col("run_id"), F.col("text_id").cast("string"), F.col("mention_type"), F.col("char_start").cast("string"), F.col("char_end").cast("string"), F.col("normalized"))
    mentions = spans.join(own, "text_id").withColumn("mention_id", mention_id)
    edges = said.unionByName(noted).distinct().join(own, "text_id")
    relation_id = prefixed_id("RLM", F.col("run_id"), F.col("text_id").cast("string"), F.col("char_start").cast("string"), F.col("normalized"), F.col("relation_type"))
    relations = edges.withColumn("relation_id", relation_id)
    counted = mentions.select("run_id", F.lit(1).alias("m"), F.lit(0).alias("r")).unionAll(relations.select("run_id", F.lit(0), F.lit(1))).unionAll(own.select("run_id", F.lit(0), F.lit(0)).distinct())
    sums = counted.groupBy("run_id").agg(F.sum("m").alias("mention_count"), F.sum("r").alias("relation_count"))
    new = own.select("run_id", "extraction_id").distinct().join(sums, "run_id").select("run_id", "extraction_id", F.lit(version).alias("version"), "mention_count", "relation_count")
    return {"mentions": mentions, "relations": relations, "runs": new}
