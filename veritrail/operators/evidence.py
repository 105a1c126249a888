"""Evidence around anchors: contained spans, citable context, document lifecycle, authority, doctor report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contained_spans(inner: DataFrame, outer: DataFrame, key: str, width: int = 64) -> DataFrame:
    """(key, inner_id, outer_id): spans of one text that lie within another, half-open.

    Texts are cut into stretches of ``width`` characters: an outer span stands
    in each that it touches, an inner one where it starts, so a long text with
    many spans is many join keys.
    """
    o = outer.select(key, F.col("span_id").alias("outer_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / width))).alias("__part"))
    i = inner.select(key, F.col("span_id").alias("inner_id"), "start", "end", F.floor(F.col("start") / width).alias("__part"))
    return i.join(o, [key, "__part"]).where((F.col("start") >= F.col("o_start")) & (F.col("end") <= F.col("o_end")) & (F.col("inner_id") != F.col("outer_id"))).select(key, "inner_id", "outer_id")


def expand_anchor(segs: DataFrame, is_anchor: Column, same: str, most: int) -> DataFrame:
    """(doc_id, anchor, seq, side, omitted) of the segments around each anchor in its unbroken run of equal ``same``, at most ``most``: forward first, then back; ``omitted`` tells that the run goes on.

    A run's segments are numbered without gaps, so an anchor's neighbours
    follow from its place and the run's length, without a join.
    """
    by = Window.partitionBy("doc_id").orderBy("seq")
    breaks = F.when((F.col("seq") - F.lag("seq").over(by) == 1) & F.col(same).eqNullSafe(F.lag(same).over(by)), 0).otherwise(1)
    runs = segs.withColumn("__anchor", is_anchor).select("doc_id", "seq", "__anchor", F.col(same)).withColumn("__b", breaks).withColumn("__run", F.sum("__b").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "__run")
    placed = runs.withColumn("first", F.min("seq").over(run)).withColumn("last", F.max("seq").over(run)).where("__anchor")
    ahead = F.least(F.col("last") - F.col("seq"), F.lit(most))
    behind = F.least(F.col("seq") - F.col("first"), F.lit(most) - ahead)
    near = F.concat(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.when((i > 0) & (i <= ahead), i)), F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.when((i > 0) & (i <= behind), -i)))
    out = placed.select("doc_id", F.col("seq").alias("anchor"), (F.col("last") - F.col("first") > most).alias("omitted"), F.explode(F.array_compact(near)).alias("step"))
    return out.select("doc_id", "anchor", (F.col("anchor") + F.col("step")).alias("seq"), F.when(F.col("step") > 0, "forward").otherwise("back").alias("side"), "omitted")


def lifecycle(documents: DataFrame) -> DataFrame:
    """Documents with their class from counts (manifestations, bindings, primary_keys, evidence, invalid_evidence, primary_evidence): retained while anything binds them, stale otherwise."""
    state = (
        F.when(F.col("manifestations") > 0, "retain_manifestation")
        .when(F.col("bindings") > 0, "retain_active")
        .when(F.col("primary_keys") != 1, "retain_conflict")
        .when((F.col("evidence") > 0) & ((F.col("invalid_evidence") > 0) | (F.col("primary_evidence") == 0)), "retain_conflict")
        .when(F.col("evidence") > 0, "retain_provenance")
        .otherwise("stale")
    )
    return documents.withColumn("lifecycle", state)


def authority_state(signals: DataFrame, key: str) -> DataFrame:
    """(key, function, state) from signals (key, function, family, issuer, review): conflicts are ambiguous, no function is unknown, a missing part is partial."""
    sets = signals.groupBy(key).agg(F.countDistinct("function").alias("f"), F.min("function").alias("one"), F.countDistinct("family").alias("fam"), F.countDistinct("issuer").alias("iss"), F.bool_or("review").alias("review"))
    state = F.when((F.col("iss") > 1) | (F.col("fam") > 1) | (F.col("f") > 1) | F.coalesce("review", F.lit(False)), "ambiguous").when(F.col("f") == 0, "unknown").when((F.col("iss") == 0) | (F.col("fam") == 0), "partial").otherwise("resolved")
    return sets.select(key, F.when(F.col("f") == 1, F.col("one")).otherwise("unknown").alias("function"), state.alias("state"))


def doctor_report(checks: Sequence[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """(check_id, severity, failures, first_failure) of checks (id, severity, failing rows, their key); clean ones say OK."""
    out = None
    for check, severity, failing, key in checks:
        row = failing.agg(F.count(F.lit(1)).alias("failures"), F.min(F.col(key).cast("string")).alias("first_failure")).select(F.lit(check).alias("check_id"), F.when(F.col("failures") > 0, severity).otherwise("OK").alias("severity"), "failures", "first_failure")
        out = row if out is None else out.unionAll(row)
    return out
