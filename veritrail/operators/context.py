"""Citable context of a segment: its provision's neighbours and the provisions that it cites, with the reason wherever context ends early.

What may be walked is a state of runs, found once for all segments by windows
over an extraction; an anchor's walk is read from its run.  The candidates and
gaps of an anchor are one ordered stream, which its budget cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.text import only_offset
from veritrail.sources.shared import written

#: Ends of a walk that are no gap: no segment there, or another provision that is itself citable.
_END = "CAST(NULL AS struct<reason: string, source: bigint>)"


def citable(segments: DataFrame, observations: DataFrame) -> DataFrame:
    """``segments`` with ``provision_id`` and ``citable_state``.

    A segment is citable for a provision if that is its only observation, both
    texts have their recorded hashes, and the provision's text stands in the
    segment exactly once.  Otherwise the state names what is missing.
    """
    # An observation's hash stays behind; what travels is whether its text has it.
    seen = observations.select("segment_id", F.struct("provision_id", "normative_text", (F.sha2("normative_text", 256) == F.col("normative_sha256")).alias("whole")).alias("o"))
    seen = seen.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    met = segments.join(seen, "segment_id", "left")
    whole = F.col("o.whole") & (F.sha2("text", 256) == F.col("text_sha256"))
    state = (
        F.when(F.col("n").isNull(), "no_observation")
        .when(F.col("n") > 1, "several_observations")
        .when(~F.coalesce(whole, F.lit(False)), "fingerprint_mismatch")
        .when(only_offset(F.col("text"), F.col("o.normative_text")).isNull(), "no_single_anchor")
        .otherwise("citable")
    )
    return met.withColumn("citable_state", state).withColumn("provision_id", F.when(F.col("citable_state") == "citable", F.col("o.provision_id"))).drop("n", "o")


def runs(segments: DataFrame, most: int) -> DataFrame:
    """(segment_id, document_id, provision_id, ahead, behind, ahead_gap, behind_gap, n_ahead, n_behind) of citable segments (segment_id, extraction_id, sequence_no, document_id, provision_id).

    ``ahead`` and ``behind`` list the nearest ``most`` + 1 segments of the
    unbroken run of the same provision; the gaps say why a run ends, unless it
    ends with the text or before another citable provision.
    """
    place = segments.groupBy("extraction_id", "sequence_no").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("segment_id", "document_id", "provision_id")).alias("s"))
    place = place.select("extraction_id", "sequence_no", "n", "s.*")
    by = Window.partitionBy("extraction_id").orderBy("sequence_no")

    def joins(step: int) -> tuple[Column, Column]:
        """Whether the neighbour belongs to the run, and the gap if it doesn't."""
        other = lambda c: F.lag(c, step).over(by)
        there = F.coalesce(F.col("sequence_no") - other("sequence_no") == step, F.lit(False))
        alike = there & (F.col("n") == 1) & (other("n") == 1) & other("document_id").eqNullSafe(F.col("document_id")) & (other("provision_id") == F.col("provision_id"))
        gap = (
            F.when(~there, F.expr(_END))
            .when(other("n") > 1, F.struct(F.lit("ambiguous_contiguous_sequence").alias("reason"), F.col("segment_id").alias("source")))
            .when(~other("document_id").eqNullSafe(F.col("document_id")), F.struct(F.lit("document_boundary_mismatch").alias("reason"), other("segment_id").alias("source")))
            .when(other("provision_id").isNull(), F.struct(F.lit("unverified_contiguous_boundary").alias("reason"), other("segment_id").alias("source")))
        )
        return F.coalesce(alike, F.lit(False)), gap

    (follows, back_gap), (_, next_gap) = joins(1), joins(-1)
    placed = place.withColumn("back_gap", back_gap).withColumn("next_gap", next_gap).withColumn("starts", (~follows).cast("int"))
    placed = placed.withColumn("run", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("extraction_id", "run").orderBy("sequence_no")
    all_of_it = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = lambda a, b: F.collect_list("segment_id").over(run.rowsBetween(a, b))
    # An ambiguous gap names the anchor itself, so that its source is filled in later.
    out = placed.withColumn("ahead", near(1, most + 1)).withColumn("behind", F.reverse(near(-most - 1, -1)))
    out = out.withColumn("n_ahead", F.max("sequence_no").over(all_of_it) - F.col("sequence_no")).withColumn("n_behind", F.col("sequence_no") - F.min("sequence_no").over(all_of_it))
    out = out.withColumn("ahead_gap", F.last("next_gap").over(all_of_it)).withColumn("behind_gap", F.first("back_gap").over(all_of_it))
    return out.select("segment_id", "n", "document_id", "provision_id", "ahead", "behind", "ahead_gap", "behind_gap", "n_ahead", "n_behind")


def context(anchors: DataFrame, segments: DataFrame, references: DataFrame, most: int = 4) -> DataFrame:
    """One row an anchor: (anchor_id, status, document_id, provision_id, hits, gaps, exhausted, candidates).

    ``anchors`` are (anchor_id, asked_provision; null for any), ``segments``
    those of ``citable`` with document_id, ``references`` (segment_id,
    mention_id, state, target_document_id, target_provision_id).  Order of the
    stream: the run ahead, what ends it, the run behind, what ends it, then each
    source's references by mention.  ``most`` distinct candidates are hits; one
    more exhausts the budget, and nothing behind it counts.  A target gives at
    most its first ``most`` + 1 segments, copies of a text once.
    """
    state = segments.join(anchors.select(F.col("anchor_id").alias("segment_id")).distinct(), "segment_id", "left_semi").select(F.col("segment_id").alias("anchor_id"), F.col("document_id").alias("own_document"), F.col("provision_id").alias("own_provision"), F.lit(True).alias("there"))
    asked = anchors.select("anchor_id", "asked_provision").join(state, "anchor_id", "left")
    failed = (
        F.when(F.col("there").isNull(), "anchor_missing").when(F.col("own_document").isNull(), "anchor_document_unresolved").when(F.col("own_provision").isNull(), "anchor_provision_not_citable")
        .when(F.col("asked_provision") != F.col("own_provision"), "anchor_provision_mismatch")
    )
    asked = asked.withColumn("failed", failed)
    walked = asked.where("failed IS NULL").join(runs(segments, most).withColumnRenamed("segment_id", "anchor_id"), "anchor_id", "left")
    alone = F.coalesce(F.col("n"), F.lit(2)) > 1
    none = F.expr("CAST(array() AS array<bigint>)")
    walked = walked.withColumn("ahead", F.when(alone, none).otherwise(F.col("ahead"))).withColumn("behind", F.when(alone, none).otherwise(F.col("behind")))
    ambiguous = F.struct(F.lit("ambiguous_contiguous_sequence").alias("reason"), F.col("anchor_id").alias("source"))
    walked = walked.withColumn("ahead_gap", F.when(alone, ambiguous).otherwise(F.col("ahead_gap"))).withColumn("behind_gap", F.when(alone, F.expr(_END)).otherwise(F.col("behind_gap")))
    # Both sides of the stream and the references start from here.
    walked = written(walked.select("anchor_id", "own_provision", "ahead", "behind", "ahead_gap", "behind_gap"), "walked")

    def stream(part: int, side: str) -> DataFrame:
        gap = F.col(f"{side}_gap")
        source = F.when(gap["reason"] == "ambiguous_contiguous_sequence", F.col("anchor_id")).otherwise(gap["source"])
        steps = F.transform(side, lambda s, i: F.struct(i.alias("place"), s.alias("segment_id"), F.lit(None).cast("string").alias("reason"), F.col("anchor_id").alias("source")))
        end = F.when(gap.isNotNull(), F.array(F.struct(F.lit(1_000_000).alias("place"), F.lit(None).cast("bigint").alias("segment_id"), gap["reason"].alias("reason"), source.alias("source"))))
        rows = walked.select("anchor_id", F.col("own_provision").alias("provision_id"), F.inline(F.concat(steps, F.coalesce(end, F.slice(steps, 1, 0)))))
        return rows.select("anchor_id", F.struct(F.lit(part).alias("part"), "place", F.lit(None).cast("bigint").alias("mention"), F.lit(0).alias("hit")).alias("at"), "segment_id", "provision_id", "reason", "source", F.lit(None).cast("bigint").alias("mention_id"), F.lit("contiguous_provision").alias("basis"))

    sources = walked.where(F.size("ahead") + F.size("behind") <= most).select("anchor_id", F.posexplode(F.concat(F.array("anchor_id"), "ahead", "behind")).alias("place", "source"))
    of_target = Window.partitionBy("target_document_id", "target_provision_id").orderBy("extraction_id", "sequence_no", "segment_id")
    targets = segments.where("provision_id IS NOT NULL AND document_id IS NOT NULL").groupBy(F.col("document_id").alias("target_document_id"), F.col("provision_id").alias("target_provision_id"), "extraction_id", "text_sha256").agg(F.min(F.struct("sequence_no", "segment_id")).alias("s"))
    targets = targets.select("target_document_id", "target_provision_id", "extraction_id", "s.*").withColumn("hit", F.row_number().over(of_target)).where(F.col("hit") <= most + 1).select("target_document_id", "target_provision_id", F.col("segment_id").alias("found"), "hit")
    cited = sources.join(references.withColumnRenamed("segment_id", "source"), "source").join(targets, ["target_document_id", "target_provision_id"], "left")
    why = F.when(F.col("state") != "resolved", "reference_resolution_incomplete").when(F.col("target_document_id").isNull() | F.col("target_provision_id").isNull(), "reference_without_provision_target").when(F.col("found").isNull(), "reference_target_context_unavailable")
    cited = cited.withColumn("reason", why).withColumn("hit", F.when(F.col("reason").isNull(), F.col("hit")).otherwise(0)).where("reason IS NULL OR reason = 'reference_target_context_unavailable' OR coalesce(hit, 0) = 0")
    cited = cited.select("anchor_id", F.struct(F.lit(2).alias("part"), "place", F.col("mention_id").alias("mention"), F.coalesce("hit", F.lit(0)).alias("hit")).alias("at"), F.when(F.col("reason").isNull(), F.col("found")).alias("segment_id"), F.col("target_provision_id").alias("provision_id"), "reason", "source", "mention_id", F.lit("explicit_cross_reference").alias("basis"))
    # Dealt by anchor once, for all that numbers and cuts an anchor's events.
    events = stream(0, "ahead").unionByName(stream(1, "behind")).unionByName(cited.dropDuplicates(["anchor_id", "at", "reason", "segment_id"])).repartition("anchor_id")
    candidate = F.col("segment_id").isNotNull() & (F.col("segment_id") != F.col("anchor_id"))
    first = F.row_number().over(Window.partitionBy("anchor_id", "segment_id", "provision_id").orderBy("at")) == 1
    events = events.withColumn("new", (candidate & first).cast("int")).withColumn("found", F.sum("new").over(Window.partitionBy("anchor_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)))
    # Read for hits and for gaps.
    kept = written(events.where(F.col("found") - F.col("new") <= most), "events")
    hits = kept.where(candidate).groupBy("anchor_id", "segment_id", "provision_id").agg(F.min("at").alias("at"), F.min("found").alias("number"), F.sort_array(F.collect_set("basis")).alias("bases"), F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_set("mention_id")).alias("mentions"))
    hits = hits.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.when(F.col("number") <= most, F.struct("at", "segment_id", "provision_id", "bases", "sources", "mentions")))).alias("hits"), F.count(F.lit(1)).alias("candidates"))
    gaps = kept.where("reason IS NOT NULL").select("anchor_id", "reason", "source", "mention_id").distinct().groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("reason", "source", "mention_id"))).alias("gaps"))
    no_hit = F.from_json(F.lit("[]"), hits.schema["hits"].dataType)
    out = asked.join(hits, "anchor_id", "left").join(gaps, "anchor_id", "left")
    gap = lambda reason: F.array(F.struct(reason.alias("reason"), F.col("anchor_id").alias("source"), F.lit(None).cast("bigint").alias("mention_id")))
    no_gap = F.expr("CAST(array() AS array<struct<reason: string, source: bigint, mention_id: bigint>>)")
    exhausted = F.coalesce(F.col("candidates"), F.lit(0)) > most
    had = F.coalesce("gaps", no_gap)
    empty = (F.coalesce(F.size("hits"), F.lit(0)) <= 0) & (F.size(had) == 0) & ~exhausted
    every = F.when(F.col("failed").isNotNull(), gap(F.col("failed"))).otherwise(F.concat(had, F.when(exhausted, gap(F.lit("budget_exhausted"))).otherwise(no_gap), F.when(empty, gap(F.lit("no_verified_context"))).otherwise(no_gap)))
    out = out.withColumn("all_gaps", every).withColumn("exhausted", exhausted)
    status = F.when(F.size("all_gaps") == 0, "expanded_verified").otherwise("incomplete")
    return out.select("anchor_id", status.alias("status"), F.col("own_document").alias("document_id"), F.coalesce(F.when(F.col("failed") == "anchor_provision_mismatch", F.col("asked_provision")), "own_provision", "asked_provision").alias("provision_id"), F.coalesce("hits", no_hit).alias("hits"), F.col("all_gaps").alias("gaps"), "exhausted", F.coalesce("candidates", F.lit(0)).alias("candidates"))
