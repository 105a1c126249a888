"""Audits of a document registry: each check returns its failing rows, one report joins them.

A check is a DataFrame of ``example`` (text that names the failing row) and, if
it has two grades, ``severity``.  Checks are joins on keys with the comparison
in a filter; no check gathers its failures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import forms
from veritrail.sources.shared import written

#: Document types whose key names the issuer.
ISSUER_SCOPED = ("RESOLUCION", "CIRCULAR", "CONCEPTO", "OFICIO", "SENTENCIA_C", "CONPES", "CONSTITUCION_POLITICA")


def _example(*parts: str) -> Column:
    return F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts]).alias("example")


def missing_parent(child: DataFrame, key: str, parent: DataFrame, parent_key: str, *name: str) -> DataFrame:
    """Rows whose key is set and has no parent."""
    known = parent.select(F.col(parent_key).alias("__known")).distinct()
    return child.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("__known"), "left_anti").select(_example(*name))


def differs(left: DataFrame, right: DataFrame, key: str, a: str, b: str, *name: str, missing: bool = False) -> DataFrame:
    """Rows of ``left`` whose ``a`` is not the ``b`` of the row of ``right`` with the same key; ``missing``: or that have no such row."""
    met = left.join(right.select(key, F.col(b).alias("__b"), F.lit(True).alias("__there")), key, "left" if missing else "inner")
    bad = ~F.col(a).eqNullSafe(F.col("__b"))
    return met.where((F.col("__there").isNull() | bad) if missing else bad).select(_example(*name))


def registered(rows: DataFrame, type_column: str, id_column: str, registry: dict[str, tuple[DataFrame, str]], *name: str) -> DataFrame:
    """Rows that name an entity (type, id) of no registry; an unknown type is a warning."""
    # A type meets its registry as a number, which is shorter to deal out than its name.
    known = reduce(DataFrame.unionByName, [t.select(F.lit(i).alias("__type"), F.col(c).cast("long").alias("__id")) for i, (t, c) in enumerate(registry.values())])
    place = F.coalesce(*[F.when(F.col(type_column) == k, F.lit(i)) for i, k in enumerate(registry)], F.lit(-1))
    lost = rows.withColumn("__place", place).join(known, (F.col("__place") == F.col("__type")) & (F.col(id_column) == F.col("__id")), "left_anti")
    return lost.select(_example(*name), F.when(F.col(type_column).isin(*registry), "ERROR").otherwise("WARN").alias("severity"))


def more_than_one(rows: DataFrame, key: str, counted: str) -> DataFrame:
    """Keys with several different values."""
    return rows.groupBy(key).agg(F.countDistinct(counted).alias("__n")).where("__n > 1").select(_example(key))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys, nulls compared as equal, that several rows have."""
    return rows.groupBy(*key).count().where("count > 1").select(_example(*key))


def key_shape(identifiers: DataFrame) -> DataFrame:
    """Primary identifiers that are no canonical key, or lack the issuer that their type needs."""
    parsed = forms.primary_key(F.col("identifier_value"))
    bad = parsed.isNull() | (parsed["doc_type"].isin(*ISSUER_SCOPED) & parsed["issuer"].isNull())
    return identifiers.where(F.col("identifier_type") == "primary").where(bad).select(_example("identifier_id", "identifier_value"))


def resolution_faults(resolutions: DataFrame) -> DataFrame:
    """One row for each broken rule of a resolution: targets only if resolved, a reason only if not, and always a method."""
    resolved = F.col("status") == "resolved"
    rules = {"no_target": resolved & F.col("target_document_id").isNull(), "stray_target": ~resolved & F.col("target_document_id").isNotNull(), "no_reason": ~resolved & F.col("reason").isNull(), "stray_reason": resolved & F.col("reason").isNotNull(), "no_method": F.col("method").isNull()}
    found = resolutions.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))))
    return found.select(_example("mention_id", "rule"))


def out_of_sync(base: DataFrame, index: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of either side that the other lacks or has with another value."""
    both = base.select(key, F.col(value).alias("__b"), F.lit(1).alias("__in_b")).join(index.select(key, F.col(value).alias("__i"), F.lit(1).alias("__in_i")), key, "full_outer")
    state = F.when(F.col("__in_i").isNull(), "missing").when(F.col("__in_b").isNull(), "stray").when(~F.col("__b").eqNullSafe(F.col("__i")), "differs")
    return both.withColumn("state", state).where(F.col("state").isNotNull()).select(_example("state", key))


def report(checks: dict[tuple[str, str], DataFrame], scopes: list[str] | None = None, most: int = 10) -> DataFrame:
    """(check_id, scope, status, n, examples) of each check, or of those in ``scopes``: worst severity, failures and the first ``most`` examples.

    Failures are written once, then counted and ranked; the rank's bound lets
    Spark keep ``most`` rows of each partition before the shuffle.
    """
    chosen = {k: v for k, v in checks.items() if scopes is None or k[1] in scopes}
    named = [(df if "severity" in df.columns else df.withColumn("severity", F.lit("ERROR"))).select(F.lit(i).alias("check_id"), "severity", "example") for (i, _), df in chosen.items()]
    failures = written(reduce(DataFrame.unionByName, named), "failures")
    counts = failures.groupBy("check_id").agg(F.count(F.lit(1)).alias("n"), F.min("severity").alias("worst"))
    first = failures.withColumn("__r", F.row_number().over(Window.partitionBy("check_id").orderBy("example"))).where(F.col("__r") <= most)
    examples = first.groupBy("check_id").agg(F.array_join(F.sort_array(F.collect_list("example")), "; ").alias("examples"))
    every = failures.sparkSession.createDataFrame(list(chosen), "check_id string, scope string")
    out = every.join(counts, "check_id", "left").join(examples, "check_id", "left")
    return out.select("check_id", "scope", F.coalesce("worst", F.lit("PASS")).alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))
