"""Evidence-based dates: roles, events, effect at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_roles(candidates: DataFrame) -> DataFrame:
    """(document, role, candidates, trusted, status, value) from (document, role, value, is_trusted): one trusted candidate resolves; several of either are ambiguous."""
    grouped = candidates.groupBy("document", "role").agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.col("is_trusted").cast("long")).alias("trusted"), F.max(F.when(F.col("is_trusted"), F.col("value"))).alias("only"))
    status = F.when(F.col("trusted") == 1, "resolved").when((F.col("trusted") > 1) | (F.col("candidates") > 1), "ambiguous").otherwise("unresolved")
    return grouped.select("document", "role", "candidates", "trusted", status.alias("status"), F.when(status == "resolved", F.col("only")).alias("value"))


def effect_at(events: DataFrame, as_of: Column, terminating: list[str], starting: tuple[str, ...] = ("enters_into_force",)) -> DataFrame:
    """(document, state, in_effect) at ``as_of`` from (document, event_type, starts, ends, ambiguous_start).

    In order: an ambiguous start; a terminating event by then; several starts;
    not begun; one end; several ends; an open interval stays unresolved.  Only
    ``starting`` events begin or end an interval.
    """
    ended = F.bool_or(F.col("event_type").isin(*terminating) & (F.col("starts") <= as_of))
    is_start = F.col("event_type").isin(*starting)
    grouped = events.groupBy("document").agg(
        F.bool_or("ambiguous_start").alias("amb"), ended.alias("ended"), F.countDistinct(F.when(is_start, F.col("starts"))).alias("n_start"), F.min(F.when(is_start, F.col("starts"))).alias("start"),
        F.countDistinct(F.when(is_start, F.col("ends"))).alias("n_end"), F.min(F.when(is_start, F.col("ends"))).alias("stop"),
    )
    state = F.when(F.col("amb"), "ambiguous").when(F.col("ended"), "resolved").when(F.col("n_start") > 1, "ambiguous").when((F.col("n_start") == 1) & (as_of < F.col("start")), "resolved").when((F.col("n_start") == 1) & (F.col("n_end") == 1), "resolved").when(F.col("n_end") > 1, "ambiguous").otherwise("unresolved")
    effect = F.when(F.col("amb"), F.lit(None)).when(F.col("ended"), F.lit(False)).when(F.col("n_start") > 1, F.lit(None)).when((F.col("n_start") == 1) & (as_of < F.col("start")), F.lit(False)).when((F.col("n_start") == 1) & (F.col("n_end") == 1), as_of <= F.col("stop"))
    return grouped.select("document", state.alias("state"), effect.cast("boolean").alias("in_effect"))
