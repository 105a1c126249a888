"""Bounded research: fair schedules, budgets with omissions, coverage, closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def round_robin(tasks: DataFrame, question: str, order: str) -> DataFrame:
    """Tasks with ``turn``: each question's first, then each one's second, and so on; turns are counted within a round, so no global sort is needed."""
    return tasks.withColumn("turn", F.row_number().over(Window.partitionBy(question).orderBy(order)))


def within_budget(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Rows with ``selected``: the first ``most`` of each group in ``order``; the rest stay, marked as left out."""
    return rows.withColumn("selected", F.row_number().over(Window.partitionBy(group).orderBy(order)) <= most)


def execution_status(steps: DataFrame, aspect: str, task: str) -> DataFrame:
    """(aspect, tasks, execution) from trace steps (aspect, task, round, outcome), each task's latest step counting.

    blocked, then budget_exhausted, partial where a task has no step, complete
    where all are hits or no_hits, not_started without any step.
    """
    last = steps.groupBy(aspect, task).agg(F.max(F.struct("round", "outcome"))["outcome"].alias("outcome"))
    status = (
        F.when(F.count("outcome") == 0, "not_started")
        .when(F.bool_or(F.col("outcome").isin("integrity_failure", "blocked")), "blocked")
        .when(F.bool_or(F.col("outcome") == "budget_exhausted"), "budget_exhausted")
        .when(F.count("outcome") < F.count(F.lit(1)), "partial")
        .when(F.bool_and(F.col("outcome").isin("hits", "no_hits")), "complete")
        .otherwise("partial")
    )
    return last.groupBy(aspect).agg(F.count(F.lit(1)).alias("tasks"), status.alias("execution"))


def one_hop(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(node): ends of edges that touch a known node and are not known themselves; one hop, never more."""
    touching = edges.join(known.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).union(edges.join(known.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")))
    return touching.distinct().join(known, "node", "left_anti")


def edge_relevance(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges (a, b) with relevance: both ends selected, one, or none, by equi-joins on the ends."""
    s = selected.select("node").distinct()
    marked = edges.join(s.select(F.col("node").alias("a"), F.lit(1).alias("has_a")), "a", "left").join(s.select(F.col("node").alias("b"), F.lit(1).alias("has_b")), "b", "left")
    ends = F.coalesce("has_a", F.lit(0)) + F.coalesce("has_b", F.lit(0))
    return marked.select("a", "b", F.when(ends == 2, "selected_authorities").when(ends == 1, "document_scope_conservative").otherwise("irrelevant").alias("relevance"))
