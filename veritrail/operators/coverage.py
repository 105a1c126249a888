"""What a bounded research run covered: statuses by precedence, omissions, closure; fair schedules over lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_status() -> Column:
    """Of an aspect's selections (context_status, hit): incomplete context first, then ready, candidates only, none found."""
    context = F.col("context_status")
    return F.when(F.bool_or(context == "incomplete"), "context_incomplete").when(F.bool_or(context == "ready"), "context_ready").when(F.bool_or(F.col("outcome") == "hits"), "candidate_only").when(F.bool_or(F.col("outcome") == "no_hits"), "none_found").otherwise("not_assessed")


def authority_status() -> Column:
    a = F.col("authority_status")
    return F.when(F.bool_or(a == "conflicting"), "conflicting").when(F.bool_or(a == "ambiguous"), "ambiguous").when(F.count(a) == 0, "unassessed").when(F.bool_or(a == "unknown"), "unknown").when(F.bool_or(a == "partial"), "partial").otherwise("resolved")


def temporal_status() -> Column:
    t = F.col("temporal_status")
    return F.when(F.count(t) == 0, "unassessed").when(F.bool_or(t == "ambiguous"), "ambiguous").when(F.countDistinct(t) > 1, "mixed").when(F.bool_and(t == "unassessed"), "unassessed").otherwise("assessed")


def fact_status() -> Column:
    f = F.col("fact_state")
    return F.when(F.count(f) == 0, "not_required").when(F.bool_or(f == "ambiguous"), "ambiguous").when(F.bool_or(f == "missing"), "missing").otherwise("sufficient")


def ledger(rows: DataFrame, execution: DataFrame) -> DataFrame:
    """(aspect, execution, evidence, authority, temporal, facts, synthesis, closure) of rows (aspect, outcome, context_status, authority_status, temporal_status, fact_state) and each aspect's execution."""
    sums = rows.groupBy("aspect").agg(evidence_status().alias("evidence"), authority_status().alias("authority"), temporal_status().alias("temporal"), fact_status().alias("facts"))
    both = sums.join(execution.select("aspect", "execution"), "aspect", "left").fillna("not_started", ["execution"])
    both = both.withColumn("synthesis", F.when(F.col("facts").isin("missing", "ambiguous"), "requires_facts").when(F.col("evidence") == "context_ready", "requires_interpretive_synthesis").otherwise("unsupported"))
    whole = (F.col("execution") == "complete") & (F.col("evidence") == "context_ready") & (F.col("authority") == "resolved") & (F.col("temporal") == "assessed") & (F.col("synthesis") != "unsupported")
    return both.withColumn("closure", F.when(whole, "complete").otherwise("incomplete"))


def limitation_codes(covered: DataFrame) -> DataFrame:
    """``ledger`` rows with the codes of what limits them, in fixed order."""
    codes = [("EXECUTION_INCOMPLETE", F.col("execution") != "complete"), ("EVIDENCE_INCOMPLETE", F.col("evidence") != "context_ready"), ("AUTHORITY_UNRESOLVED", F.col("authority") != "resolved"), ("TEMPORAL_UNASSESSED", F.col("temporal") != "assessed"), ("FACTS_OPEN", F.col("facts").isin("missing", "ambiguous"))]
    return covered.withColumn("codes", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in codes])), ","))


def result_status(covered: DataFrame, question: str) -> DataFrame:
    """(question, status): blocked if an aspect is, complete if all are, else partial."""
    status = F.when(F.bool_or(F.col("execution") == "blocked"), "blocked").when(F.bool_and(F.col("closure") == "complete"), "complete").otherwise("partial")
    return covered.groupBy(question).agg(status.alias("status"), F.count(F.lit(1)).alias("aspects"))


def omissions(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    """(task, reason): planned tasks without a step, and those whose last step did not end."""
    last = steps.groupBy("task").agg(F.max(F.struct("round", "outcome"))["outcome"].alias("outcome"), F.lit(True).alias("seen"))
    met = tasks.join(last, "task", "left")
    reason = F.when(F.col("seen").isNull(), "not_executed").when(F.col("outcome").isNull(), "no_outcome").when(~F.col("outcome").isin("hits", "no_hits"), F.col("outcome"))
    return met.withColumn("reason", reason).where("reason IS NOT NULL").select("task", "reason")


def relevance(edges: DataFrame, provisions: DataFrame, selected: DataFrame) -> DataFrame:
    """(relation_id, relevance) of edges with owning documents and a dependency family, for selected authorities (document_id) and provisions (provision_id), first rule that applies."""
    docs = selected.where("document_id IS NOT NULL").select(F.col("document_id").alias("__d")).distinct()
    provs = selected.where("provision_id IS NOT NULL").select(F.col("provision_id").alias("__p")).distinct()
    has_provisions = provisions.select(F.col("document_id").alias("__h")).distinct()
    out = edges
    for side in ("source", "target"):
        is_provision = (F.col(f"{side}_type") == "provision") & (F.col(f"{side}_id") == F.col("__p"))
        out = out.join(provs, is_provision, "left").withColumnRenamed("__p", f"__{side}_p").join(docs, F.col(f"{side}_document") == F.col("__d"), "left").withColumnRenamed("__d", f"__{side}_d").join(has_provisions, F.col(f"{side}_document") == F.col("__h"), "left").withColumnRenamed("__h", f"__{side}_h")
    s, t = F.col("__source_d").isNotNull(), F.col("__target_d").isNotNull()
    kind = (
        F.when(F.col("__source_p").isNotNull() | F.col("__target_p").isNotNull(), "exact_provision")
        .when(s & t, "selected_authorities")
        .when(F.col("family").isNull(), "irrelevant")
        .when((s & (F.col("source_type") == "document")) | (t & (F.col("target_type") == "document")), "document_scope_conservative")
        .when((s & F.col("__source_h").isNull()) | (t & F.col("__target_h").isNull()), "unspecified_provision_conservative")
        .otherwise("irrelevant")
    )
    return out.select("relation_id", kind.alias("relevance"))


def schedule(tasks: DataFrame) -> DataFrame:
    """``tasks`` (question, aspect, task, lane) with ``round`` and ``turn``: inside a lane an aspect gives one task a round and a question one aspect a turn; sort by (lane, round, turn, question)."""
    by_aspect = Window.partitionBy("lane", "question", "aspect").orderBy("task")
    by_question = Window.partitionBy("lane", "question", "round").orderBy("aspect")
    return tasks.withColumn("round", F.row_number().over(by_aspect)).withColumn("turn", F.row_number().over(by_question))


def profile_matches(questions: DataFrame, profiles: DataFrame) -> DataFrame:
    """(question, profile) where a question has all terms of a profile (profile, terms array): matched by counting shared terms, not by comparing every pair."""
    asked = questions.select("question", F.explode(F.array_distinct("terms")).alias("term"))
    needed = profiles.select("profile", F.size(F.array_distinct("terms")).alias("need"), F.explode(F.array_distinct("terms")).alias("term"))
    return asked.join(needed, "term").groupBy("question", "profile", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need").select("question", "profile")


def merged_candidates(hits: DataFrame) -> DataFrame:
    """(segment, queries, tasks): one row a segment with all queries and tasks that found it, in order."""
    return hits.groupBy("segment").agg(F.sort_array(F.collect_set("query")).alias("queries"), F.sort_array(F.collect_set("task")).alias("tasks"))


def with_overflow(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with ``overflow``: whether there was one more."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= most + 1)
    return ranked.withColumn("overflow", F.max("__r").over(Window.partitionBy(group)) > most).where(F.col("__r") <= most).drop("__r")
