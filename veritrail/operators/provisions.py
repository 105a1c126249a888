"""Provisions of legal acts: one article grammar for three dialects, registration with observation rows.

A dialect says how an article names itself, which notes may stand in it, and
how its title ends.  All dialects are read in one pass; what an article says
is kept apart from its title and from editorial notes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.ids import prefixed_id

PARSER_VERSION = "1"


@dataclass(frozen=True)
class Dialect:
    """How articles of a kind of act are written."""

    segment_type: str
    designation: str
    behind: str
    note: str
    title_end: str
    longest_title: int
    first_title_wins: bool


#: Article heads, notes and titles of compiled decrees, simple acts and the tax statute.
DIALECTS = {
    "compiled": Dialect("regulatory_article", r"[0-9]+(?:\.[0-9]+){2,}", r"\s*\.?\s*", r"(?:Art[ií]culo|Par[áa]grafo|Inciso)[ ]+[^>]+", r"\.[ ]+(.+)$", 220, False),
    "simple": Dialect("article", r"[0-9]+", r"(?:[oOº°])?\s*\.\s*", r"(?:Art[ií]culo|Par[áa]grafo|Inciso|Numeral)[^>]+", r"\.\s+(.+)$", 1_000, True),
    "statute": Dialect("article", r"[0-9]+(?:-[0-9]+)?[A-Z]?", r"\s*\.?\s*", r"(?:Art[ií]culo|Par[áa]grafo|Inciso)[^>]+", r"\.(?:\s+(.*))?$", 220, True),
}
TITLE = r"[A-ZÁÉÍÓÚÜÑ0-9 ,;:/()\-]+?"


def _by_dialect(pick) -> Column:
    """The value that ``pick`` gives for the row's dialect."""
    out = None
    for name, d in DIALECTS.items():
        out = F.when(F.col("dialect") == name, pick(d)) if out is None else out.when(F.col("dialect") == name, pick(d))
    return out


def _whole(d: Dialect) -> str:
    return rf"(?iu)^ART[IÍ]CULO\s+({d.designation}){d.behind}"


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` (text, dialect) that are articles of their dialect, with designation, title, body and note.

    Each step is a column of its own, so that no pattern runs twice on a text;
    the head's pattern is chosen by row, so that the filter on it stays one call.
    """
    out = rows.withColumn("__plain", F.btrim("text")).withColumn("__head", F.call_function("regexp_extract", "__plain", _by_dialect(lambda d: F.lit(_whole(d))), F.lit(0))).where(F.col("__head") != "")
    out = out.withColumn("designation", F.upper(_by_dialect(lambda d: F.regexp_extract("__head", _whole(d), 1)))).withColumn("__rest", F.btrim(F.substring("__plain", F.length("__head") + 1, F.length("__plain"))))
    out = out.withColumn("designation", F.when(F.col("dialect") == "simple", F.regexp_replace("designation", "^0+([0-9])", "$1")).otherwise(F.col("designation")))
    out = out.withColumn("__note", _by_dialect(lambda d: F.regexp_extract("__rest", rf"(?iu)<({d.note})>", 1)))
    mark = F.concat(F.lit("<"), "__note", F.lit(">"))
    behind = F.substring("__rest", F.position(mark, F.col("__rest")) + F.length(mark), F.length("__rest"))
    apart = F.btrim(F.regexp_replace(F.concat_ws(" ", F.substring("__rest", F.lit(1), F.position(mark, F.col("__rest")) - 1), behind), r"\s+", " "))
    out = out.withColumn("__said", F.when(F.col("__note") == "", F.col("__rest")).otherwise(apart))
    out = out.withColumn("__title", _by_dialect(lambda d: F.when(F.length(F.regexp_extract("__said", f"^({TITLE}){d.title_end}", 1)) <= d.longest_title, F.regexp_extract("__said", f"^({TITLE}){d.title_end}", 1))))
    titled = F.coalesce(F.col("__title"), F.lit("")) != ""
    body = F.when(titled, F.btrim(F.substring("__said", F.length("__title") + 2, F.length("__said")))).otherwise(F.col("__said"))
    out = out.withColumn("title", F.when(titled, F.btrim("__title"))).withColumn("body", body).withColumn("note", F.when(F.col("__note") != "", F.btrim("__note")))
    return out.drop("__plain", "__head", "__rest", "__note", "__said", "__title")


def observe(segments: DataFrame) -> DataFrame:
    """Observation rows of the articles among segments (segment_id, extraction_id, document_id, sequence_no, segment_type, text, dialect).

    Segments of the wrong type for their dialect, or that don't parse, are left
    out.  ``observation_id`` and ``provision_id`` follow from content, so a
    second run gives the same rows.
    """
    rows = parsed(segments.where(F.col("document_id").isNotNull() & (F.col("segment_type") == _by_dialect(lambda d: F.lit(d.segment_type)))))
    rows = rows.withColumn("provision_id", prefixed_id("PROV", F.col("document_id").cast("string"), F.lit("ARTICLE"), F.col("designation")))
    observation = prefixed_id("POBS", F.col("provision_id"), F.col("extraction_id").cast("string"), F.col("segment_id").cast("string"), F.lit(PARSER_VERSION))
    return rows.select(
        observation.alias("observation_id"), "provision_id", "document_id", "extraction_id", "segment_id", "sequence_no", "dialect", "designation", "title", F.col("body").alias("normative_text"),
        F.sha2("body", 256).alias("normative_sha256"), F.sha2("text", 256).alias("observed_sha256"), F.col("note").alias("editorial_note"),
    )


def provisions_of(observations: DataFrame) -> DataFrame:
    """(provision_id, document_id, designation, title, observations): one row each; of several titles the first or the last stays, as the dialect says."""
    place = F.struct("extraction_id", "sequence_no", "title")
    titled = F.col("title").isNotNull()
    keeps_first = F.col("dialect").isin(*[n for n, d in DIALECTS.items() if d.first_title_wins])
    first, last = F.min(F.when(titled, place)), F.max(F.when(titled, place))
    sums = observations.groupBy("provision_id").agg(F.min("document_id").alias("document_id"), F.min("designation").alias("designation"), F.bool_or(keeps_first).alias("keep"), first.alias("first"), last.alias("last"), F.count(F.lit(1)).alias("observations"))
    return sums.select("provision_id", "document_id", "designation", F.when(F.col("keep"), F.col("first.title")).otherwise(F.col("last.title")).alias("title"), "observations")


def register(provisions: DataFrame, observations: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provisions and observations after the articles of ``segments`` are registered too: what is there stays, so a second run changes nothing."""
    seen = observe(segments)
    new = seen.join(observations.select("observation_id"), "observation_id", "left_anti")
    after = observations.unionByName(new.dropDuplicates(["observation_id"]).select(observations.columns))
    found = provisions_of(seen).select("provision_id", *[F.col(c).alias(f"__{c}") for c in ("document_id", "designation", "title")])
    both = provisions.select("provision_id", "document_id", "designation", "title").join(found, "provision_id", "full_outer")
    merged = both.select("provision_id", *[F.coalesce(c, f"__{c}").alias(c) for c in ("document_id", "designation", "title")])
    return merged, after
