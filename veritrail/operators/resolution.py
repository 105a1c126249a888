"""References: mentions, targets, resolution by cardinality, promotion to relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import fold

#: Verbs that announce a relation, folded, and its type.
TRIGGERS = (("substit", "substitutes"), ("modific", "modifies"), ("adicion", "adds"), ("derog", "repeals"))


def mentions(texts: DataFrame) -> DataFrame:
    """(text_id, mention_no, raw, mention_type, article, doc_type, number, year): citations such as ``articulo 5 de la Ley 100 de 1993``."""
    act = r"(ley|decreto|resolucion|circular) ([0-9]{1,6}) de ([0-9]{4})"
    whole = rf"((?:articulo [0-9]+ (?:de la|del) )?{act})"
    found = texts.select("text_id", F.posexplode(F.regexp_extract_all(fold(F.col("text")), F.lit(whole), F.lit(1))).alias("mention_no", "raw"))
    article = F.regexp_extract("raw", "^articulo ([0-9]+) ", 1)
    return found.select("text_id", "mention_no", "raw", F.when(article != "", "article").otherwise("document").alias("mention_type"), F.nullif(article, F.lit("")).alias("article"), F.upper(F.regexp_extract("raw", act, 1)).alias("doc_type"), F.regexp_extract("raw", act, 2).cast("long").alias("number"), F.regexp_extract("raw", act, 3).cast("int").alias("year"))


def trigger_type(text: Column) -> Column:
    """Relation type of the first trigger in a text, by its place; null without one."""
    low = fold(text)
    places = F.array(*[F.struct(F.when(F.position(F.lit(stem), low) > 0, F.position(F.lit(stem), low)).otherwise(F.lit(1 << 30)).alias("at"), F.lit(kind).alias("kind")) for stem, kind in TRIGGERS])
    first = F.array_min(places)
    return F.when(first["at"] < (1 << 30), first["kind"])


def resolve(asked: DataFrame, targets: DataFrame, ref: str, key: str, target: str) -> DataFrame:
    """(ref, matches, status, resolved_target): 0, 1 or more targets are unresolved, resolved or ambiguous; nothing is guessed."""
    # Targets are counted by key before they are asked for, so a question costs one row whatever its key has.
    counted = targets.groupBy(key).agg(F.countDistinct(target).alias("n"), F.min(target).alias("one"))
    matched = asked.join(counted, key, "left").groupBy(ref).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.min("one").alias("one"))
    status = F.when(F.col("matches") == 0, "unresolved").when(F.col("matches") == 1, "resolved").otherwise("ambiguous")
    return matched.select(ref, "matches", status.alias("status"), F.when(F.col("matches") == 1, F.col("one")).alias("resolved_target"))


def resolution_state(rows: DataFrame, mention: str) -> DataFrame:
    """(mention, state) from resolution rows (mention, status, target, review): review first, then missing, ambiguous, unresolved, several targets, no target."""
    state = (
        F.when(F.bool_or("review"), "requires_review")
        .when(F.count("status") == 0, "missing_resolution")
        .when(F.bool_or(F.col("status") == "ambiguous"), "ambiguous")
        .when(F.bool_or(F.col("status") == "unresolved"), "unresolved")
        .when(F.countDistinct("target") > 1, "ambiguous")
        .when(F.count("target") == 0, "inconsistent_target")
        .otherwise("resolved")
    )
    return rows.groupBy(mention).agg(state.alias("state"))


def promote(relations: DataFrame, resolved: DataFrame, ref: str) -> DataFrame:
    """Relations with their promotion: resolved ones become edges with the smaller confidence of both, others say why not."""
    joined = relations.join(resolved, ref, "left")
    outcome = F.when(F.col("status") == "resolved", "promoted").when(F.col("status").isNull(), "missing_resolution").otherwise(F.concat(F.lit("skipped_"), F.col("status")))
    return joined.withColumn("outcome", outcome).withColumn("confidence", F.when(F.col("outcome") == "promoted", F.least("relation_confidence", "resolution_confidence")))
