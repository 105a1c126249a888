"""Idempotent writes as snapshots: first wins, last wins, determinism guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key isn't there yet; of several with one key, the least row."""
    columns = [c for c in incoming.columns if c != key]
    one = incoming.groupBy(key).agg(F.min(F.struct(*columns)).alias("r")).select(key, *[F.col(f"r.`{c}`").alias(c) for c in columns])
    return one.join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, updated: Sequence[str]) -> DataFrame:
    """``existing`` with ``incoming`` merged by key: ``updated`` columns take the new value where there is one, others keep the old."""
    new = incoming.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in incoming.columns if c != key])
    both = existing.join(new, F.col(key) == F.col("__key"), "full_outer")
    has_old = F.col(key).isNotNull()
    value = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in updated else F.when(has_old, F.col(c)).otherwise(F.col(f"__{c}"))
    return both.select(F.coalesce(key, "__key").alias(key), *[value(c).alias(c) for c in existing.columns if c != key])


def differing(existing: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys that both have with different payloads; a deterministic rerun leaves none."""
    return existing.select(key, F.col(payload).alias("__old")).join(incoming.select(key, F.col(payload).alias("__new")), key).where(~F.col("__old").eqNullSafe(F.col("__new"))).select(key)


def refuse_differing(existing: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """``incoming`` rows that are new; raises if a key comes back with another payload."""
    if differing(existing, incoming, key, payload).limit(1).count():
        raise ValueError(f"a {key} comes back with another {payload}")
    return insert_new(existing, incoming, key)


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children that stay when those whose parent is gone are deleted; a null key has no parent to lose."""
    return children.where(F.col(key).isNull()).unionByName(children.join(parents.select(key), key, "left_semi").select(children.columns))


def set_null(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with the key nulled where the parent is gone."""
    known = parents.select(F.col(key).alias("__k")).distinct()
    return children.join(known, F.col(key) == F.col("__k"), "left").withColumn(key, F.col("__k")).drop("__k").select(children.columns)


def restricted(children: DataFrame, leaving: DataFrame, key: str) -> DataFrame:
    """Keys that must not leave, as children name them, with how many."""
    return children.join(leaving.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("children"))


def violations(rows: DataFrame, key: str, rules: dict[str, object]) -> DataFrame:
    """(key, rule) for each rule (name: condition that must not be false) that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def drift(recorded: DataFrame, actual: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, action) that brings ``recorded`` to ``actual``: add, drop, rewrite; equal rows need none."""
    both = recorded.select(key, F.col(payload).alias("__r"), F.lit(1).alias("__in_r")).join(actual.select(key, F.col(payload).alias("__a"), F.lit(1).alias("__in_a")), key, "full_outer")
    action = F.when(F.col("__in_r").isNull(), "add").when(F.col("__in_a").isNull(), "drop").when(~F.col("__r").eqNullSafe(F.col("__a")), "rewrite")
    return both.select(key, action.alias("action")).where("action IS NOT NULL")


def delta(before: DataFrame, after: DataFrame, state: str) -> DataFrame:
    """(state, before, after): how many rows have each state in two snapshots."""
    both = before.select(state, F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after.select(state, F.lit(0), F.lit(1)))
    return both.groupBy(state).agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
