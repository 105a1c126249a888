"""Integrity and ordering operators over any tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def ambiguous_latest(df: DataFrame, keys: Sequence[str], newest: str, identity: str) -> DataFrame:
    """Keys whose newest rows disagree in ``identity``: keys, how many identities."""
    top = df.groupBy(*keys).agg(F.max(newest).alias("__top"))
    return df.join(top, list(keys)).where(F.col(newest) == F.col("__top")).groupBy(*keys).agg(F.countDistinct(identity).alias("identities")).where("identities > 1")


def missing_parents(children: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(relation, missing, distinct_missing): foreign-key audit over (name, child, column, parent, key)."""
    out = None
    for name, child, column, parent, key in children:
        lost = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
        row = lost.agg(F.count(F.lit(1)).alias("missing"), F.countDistinct(column).alias("distinct_missing")).select(F.lit(name).alias("relation"), "missing", "distinct_missing")
        out = row if out is None else out.unionAll(row)
    return out


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").where(F.col("l").isNull() | F.col("r").isNull()).select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with several rows and several values: keys, observations, variants."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.countDistinct(value).alias("variants")).where("observations > 1 AND variants > 1")


def within_rows(df: DataFrame, key: str, order: str, marked: Column, reach: int, name: str) -> DataFrame:
    """``df`` with whether a marked row stands at most ``reach`` rows away."""
    near = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn(name, F.max(F.coalesce(marked, F.lit(False))).over(near))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row of its key at or before ``at``: one union and a running last, no range join."""
    events = right.select(key, F.col(since).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__value"), *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c != key])
    asked = left.select(key, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__value"), *[c for c in left.columns if c != key])
    run = Window.partitionBy(key).orderBy("__at", "__side", F.col("__value")).rowsBetween(Window.unboundedPreceding, 0)
    both = events.unionByName(asked).withColumn("as_of_value", F.last("__value", ignorenulls=True).over(run))
    return both.where("__side = 1").select(*left.columns, "as_of_value")


def first_examples(df: DataFrame, check: str, ref: str, most: int = 10) -> DataFrame:
    """(check, failures, examples): the first ``most`` refs of each check; the rank's bound lets Spark keep ``most`` rows of each partition before the shuffle, and counts are aggregated apart."""
    first = df.withColumn("__r", F.row_number().over(Window.partitionBy(check).orderBy(ref))).where(F.col("__r") <= most)
    examples = first.groupBy(check).agg(F.array_join(F.sort_array(F.collect_list(ref)), ",").alias("examples"))
    return df.groupBy(check).agg(F.count(F.lit(1)).alias("failures")).join(examples, check)
