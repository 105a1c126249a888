"""Bundles of evidence: rules that two cited documents give, support of a case, integrity, readiness, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_fragments(references: DataFrame, cited: DataFrame) -> DataFrame:
    """(mention_id, source_document, target_document): resolved references both of whose documents are cited."""
    c = cited.select(F.col("document_id").alias("__c")).distinct()
    one = references.where("status = 'resolved' AND target_document IS NOT NULL").join(c, F.col("source_document") == F.col("__c"), "left_semi")
    return one.join(c, F.col("target_document") == F.col("__c"), "left_semi").select("mention_id", "source_document", "target_document")


def support(claims: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, document_id): documents that a case rests on, by its claims' evidence or as an end of its relations."""
    by_claim = claims.join(evidence, "claim_id").select("case_id", "document_id")
    by_edge = edges.select("case_id", F.explode(F.array("source_document", "target_document")).alias("document_id"))
    return by_claim.unionByName(by_edge).where("document_id IS NOT NULL").distinct()


def without_owner(edges: DataFrame, evidence: DataFrame, owners: DataFrame) -> DataFrame:
    """(relation_id, state, kept) of edges (relation_id, evidence_ids): evidence whose owner is gone is taken out; an edge left without any is unresolved."""
    good = evidence.join(owners.select("owner_id").distinct(), "owner_id", "left_semi").select(F.col("evidence_id").alias("__e"))
    each = edges.select("relation_id", F.explode_outer("evidence_ids").alias("__e")).join(good.withColumn("ok", F.lit(1)), "__e", "left")
    kept = each.groupBy("relation_id").agg(F.count("ok").alias("kept"), F.count("__e").alias("had"))
    return kept.select("relation_id", F.when(F.col("kept") == 0, "unresolved").when(F.col("kept") < F.col("had"), "reduced").otherwise("whole").alias("state"), "kept")


def unique_registry(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, which must have one row a key; raises otherwise."""
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")
    return rows


def dangling(refs: DataFrame, registries: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(bundle_id, kind, ref) that no registry of its kind has, and kinds without a registry."""
    known = None
    for kind, (rows, key) in registries.items():
        one = rows.select(F.lit(kind).alias("__k"), F.col(key).cast("long").alias("__r")).distinct()
        known = one if known is None else known.unionAll(one)
    return refs.join(known, (F.col("kind") == F.col("__k")) & (F.col("ref") == F.col("__r")), "left_anti").select("bundle_id", "kind", "ref")


def linked(selections: DataFrame, *steps: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """What a selection reaches: each step (rows, own key, key of the step before) keeps the rows that the step before it names."""
    out, before = [], selections
    for rows, own, other in steps:
        before = rows.join(before.select(F.col(other).alias("__o")).distinct(), F.col(own) == F.col("__o"), "left_semi")
        out.append(before)
    return out


def readiness(gates: DataFrame) -> DataFrame:
    """(run, ready, passed, gates) of gates (run, gate, passed): ready only if every gate passed; an unknown result is a failure."""
    ok = F.coalesce("passed", F.lit(False))
    return gates.groupBy("run").agg(F.bool_and(ok).alias("ready"), F.count(F.when(ok, F.lit(1))).alias("passed"), F.count(F.lit(1)).alias("gates"))


def case_errors(items: DataFrame) -> DataFrame:
    """(case_id, code) for each rule that a case's item breaks."""
    rules: dict[str, Column] = {
        "CLAIM_WITHOUT_EVIDENCE": (F.col("kind") == "claim") & (F.col("n_evidence") == 0),
        "VALIDATED_WITHOUT_SOURCE": (F.col("status") == "validated") & F.col("source_id").isNull(),
        "CONFIDENCE_OUT_OF_RANGE": (F.col("confidence") < 0) | (F.col("confidence") > 1),
        "UNKNOWN_KIND": ~F.col("kind").isin("claim", "relation"),
        "REVIEW_NOT_MARKED": (F.col("confidence") < 0.8) & ~F.col("review"),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return items.select("case_id", F.explode(codes).alias("code"))


def context_fingerprint(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, rows, fingerprint) of each table: an order-free sum of row hashes, so nothing is sorted or gathered."""
    out = None
    for name, rows in parts.items():
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])), 1, 12), 16, 10).cast("decimal(38,0)")
        one = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("fingerprint")).select(F.lit(name).alias("part"), "rows", "fingerprint")
        out = one if out is None else out.unionAll(one)
    return out
