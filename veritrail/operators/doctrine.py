"""Doctrine and guidance pages as rows: title, dates, problems with their theses, questions with their answers, or the reason for a refusal.

A page counts only if its parts have the numbers that its form demands: one
title, one date of each kind, so many questions, an answer for each.  All
pages are read in one pass over their segments in order; a page is one
document, so it is ordered in one task, and different pages in different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.ids import prefixed_id
from veritrail.functions.text import document_number, spanish_date

#: How titles, dates and labels of positions are written, and the parser whose evidence this is.
TITLE = r"(?i)^CONCEPTO\s+(\d+)\s+int\s+(\d+)\s+DE\s+(\d{4})$"
MONTH_DAY = r"^\(?([A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+)\s+(\d{1,2})\)?$"
WEB_DATE = r"(?iu)Publicado\s+en\s+la\s+p[aá]gina\s+web\s+de\s+la\s+DIAN:\s*(\d{1,2})\s+de\s+([A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+)\s+de\s+(\d{4})"
LABEL = r"(?iu)(PROBLEMA\s+JUR[IÍ]DICO|TESIS\s+JUR[IÍ]DICA)(?:\s*\|)?\s+(?:PROBLEMA\s+JUR[IÍ]DICO|TESIS\s+JUR[IÍ]DICA)?\s*No\.\s*(\d+)\s*$"
DOCTRINE_PARSER, DOCTRINE_VERSION = "dian_doctrine_registry", "1"
GUIDANCE_PARSER, GUIDANCE_VERSION = "dian_rut_guidance_registry", "1"
#: The guidance page that is known, with what its extraction must be.
RUT_CANCELLATION = {"key": "CO:DIAN:TRAMITE:RUT_CANCELACION", "title": "Cancelación de la inscripción en el Registro Único Tributario (RUT)", "extractor": "dian_rut_cancellation_html", "least_version": 2, "questions": 13}

SEGMENT = ["segment_id", "sequence_no", "segment_type", "text"]


def evidence_id(segment: Column, parser: str, version: str, role: Column) -> Column:
    return prefixed_id("EVD", segment.cast("string"), F.lit(parser), F.lit(version), role)


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i))


def _written(day: Column, month: Column, year: Column) -> Column:
    return spanish_date(F.concat_ws(" de ", day, month, year))


def positions(segments: DataFrame) -> DataFrame:
    """(extraction_id, ordinal, complete, problem_id, problem_text, thesis_id, thesis_text): legal problems and theses by the number on their labels.

    A label is a table row, and its content the row of the page right after
    it.  Of labels with one number and role the last with content counts; a
    number is incomplete if a role is missing, or any of its labels has no
    table row after it.
    """
    by = Window.partitionBy("extraction_id").orderBy("sequence_no", "segment_id")
    follow = lambda c: F.lead(c).over(by)
    rows = segments.select("extraction_id", *SEGMENT, follow("segment_type").alias("next_type"), follow("segment_id").alias("next_id"), follow("text").alias("next_text"))
    text = F.trim("text")
    labels = rows.where((F.col("segment_type") == "table_row") & text.rlike(LABEL)).withColumn("ordinal", F.regexp_extract(text, LABEL, 2).try_cast("long")).withColumn("problem", F.upper(F.regexp_extract(text, LABEL, 1)).startswith("PROBLEMA"))
    fed = F.coalesce(F.col("next_type") == "table_row", F.lit(False))
    last = lambda role: F.max(F.when(fed & (F.col("problem") == role), F.struct("sequence_no", "segment_id", "next_id", "next_text")))
    both = labels.groupBy("extraction_id", "ordinal").agg(last(True).alias("p"), last(False).alias("t"), F.min(fed).alias("fed"))
    whole = F.col("p").isNotNull() & F.col("t").isNotNull()
    return both.select("extraction_id", "ordinal", (whole & F.col("fed")).alias("complete"), F.col("p.next_id").alias("problem_id"), F.col("p.next_text").alias("problem_text"), F.col("t.next_id").alias("thesis_id"), F.col("t.next_text").alias("thesis_text"))


def doctrine(segments: DataFrame, identities: DataFrame) -> dict[str, DataFrame]:
    """``metadata``, ``positions``, ``events`` and ``evidence`` of doctrine pages.

    ``segments`` (extraction_id, segment_id, sequence_no, segment_type, text);
    ``identities`` (extraction_id, document_id, document_type, number, year) of
    registered documents.  Status: not_applicable (not a concept with one
    modern title; the identity stands), unresolved (the title contradicts the
    identity, or dates are missing, several or impossible), partial (some
    position is incomplete), registered.  Only the last two give rows besides
    metadata.  Of extractions of one document all are read; a position is
    that of the extraction with the largest id, as the last to be registered.
    """
    text = F.trim("text")
    title, dated, web = text.rlike(TITLE), text.rlike(MONTH_DAY), F.col("text").rlike(WEB_DATE)
    number = lambda c: F.count(F.when(c, 1))
    one = lambda c: F.max(F.when(c, F.struct("sequence_no", "segment_id", "text")))
    heads = segments.where(title | dated | web).groupBy("extraction_id").agg(number(title).alias("titles"), number(dated).alias("dates"), number(web).alias("webs"), one(title).alias("t"), one(dated).alias("d"), one(web).alias("w"))
    met = identities.join(heads, "extraction_id", "left")
    of = lambda c, pattern, i: _group(F.trim(F.col(f"{c}.text")) if c != "w" else F.col("w.text"), pattern, i)
    year = of("t", TITLE, 3)
    met = met.select(
        "extraction_id", "document_id", "document_type", F.col("number").cast("string").alias("number"), "year", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("titles", "dates", "webs")],
        F.trim("t.text").alias("title"), of("t", TITLE, 1).alias("external_number"), document_number(of("t", TITLE, 1)).alias("normalized_number"), of("t", TITLE, 2).alias("internal_number"), year.cast("int").alias("title_year"),
        _written(of("d", MONTH_DAY, 2), of("d", MONTH_DAY, 1), year).alias("doctrine_date"), _written(of("w", WEB_DATE, 1), of("w", WEB_DATE, 2), of("w", WEB_DATE, 3)).alias("web_date"), F.col("t.segment_id").alias("title_id"), F.col("d.segment_id").alias("date_id"), F.col("w.segment_id").alias("web_id"),
    )
    pairs = positions(segments)
    lacking = pairs.groupBy("extraction_id").agg(number(~F.col("complete")).alias("incomplete"), F.count(F.lit(1)).alias("found"))
    met = met.join(lacking, "extraction_id", "left")
    same = F.coalesce((F.col("normalized_number") == F.col("number")) & (F.col("title_year") == F.col("year")), F.lit(False))
    reason = (
        F.when(~same, "DOCTRINE_TITLE_IDENTITY_CONFLICT")
        .when((F.col("dates") != 1) | (F.col("webs") != 1), "DOCTRINE_DATE_EVIDENCE_AMBIGUOUS")
        .when(F.col("doctrine_date").isNull() | F.col("web_date").isNull(), "DOCTRINE_DATE_INVALID")
    )
    modern = F.coalesce(F.col("document_type") == "CONCEPTO", F.lit(False)) & (F.col("titles") == 1)
    met = met.withColumn("refused", F.when(modern, reason)).withColumn("status", F.when(~modern, "not_applicable").when(F.col("refused").isNotNull(), "unresolved").when(F.coalesce("incomplete", F.lit(0)) > 0, "partial").otherwise("registered"))
    good = F.col("status").isin("partial", "registered")
    kept = lambda c: F.when(good, F.col(c)).alias(c)
    metadata = met.select("extraction_id", "document_id", "status", F.coalesce("refused", F.when(F.col("status") == "partial", "INCOMPLETE_DOCTRINE_POSITIONS")).alias("reason"), *map(kept, ("title", "external_number", "normalized_number", "internal_number", "doctrine_date", "web_date")), F.when(good, F.coalesce("found", F.lit(0))).alias("positions"))
    read = met.where(good)
    stated = pairs.where("problem_id IS NOT NULL AND thesis_id IS NOT NULL").join(read.select("extraction_id", "document_id"), "extraction_id")
    latest = stated.groupBy("document_id", "ordinal").agg(F.max(F.struct("extraction_id", "problem_id", "problem_text", "thesis_id", "thesis_text")).alias("r")).select(prefixed_id("DPOS", F.col("document_id"), F.col("ordinal").cast("string")).alias("position_id"), "document_id", "ordinal", "r.*")
    events = read.select("document_id", F.inline(F.array(*[F.struct(F.lit(kind).alias("event_type"), F.col(at).alias("event_date"), F.lit(scope).alias("scope"), evidence_id(F.col(seg), DOCTRINE_PARSER, DOCTRINE_VERSION, F.lit(role)).alias("evidence_id")) for kind, at, scope, seg, role in (("issued", "doctrine_date", "doctrine_document", "date_id", "doctrine_date"), ("published", "web_date", "dian_web", "web_id", "web_publication_date"))])))
    roles = lambda *named: F.inline(F.array(*[F.struct(F.col(seg).alias("segment_id"), role.alias("role")) for seg, role in named]))
    said = read.select("extraction_id", "document_id", roles(("title_id", F.lit("document_identity")), ("date_id", F.lit("doctrine_date")), ("web_id", F.lit("web_publication_date"))))
    shown = stated.select("extraction_id", "document_id", roles(*[(f"{r}_id", F.concat_ws("_", F.lit(r), F.col("ordinal").cast("string"))) for r in ("problem", "thesis")]))
    evidence = said.unionByName(shown).withColumn("evidence_id", evidence_id(F.col("segment_id"), DOCTRINE_PARSER, DOCTRINE_VERSION, F.col("role")))
    return {"metadata": metadata, "positions": latest, "events": events, "evidence": evidence}


def sessions(segments: DataFrame) -> DataFrame:
    """Question and answer rows with the question's place on the page (``ordinal``, from 1) and, for answers, theirs under it (``answer_order``, from 1; 0 for the question).

    A section heading ends a question; answers after one, or before the first
    question, belong to none and are not returned.
    """
    by = Window.partitionBy("extraction_id").orderBy("sequence_no", "segment_id")
    asks, answers = F.col("segment_type") == "question", F.col("segment_type") == "answer"
    opened = F.last(F.when(asks, True).when(F.col("segment_type") == "section_heading", False), ignorenulls=True)
    rows = segments.where(F.col("segment_type").isin("question", "answer", "section_heading")).select("extraction_id", *SEGMENT, F.count(F.when(asks, 1)).over(by).alias("ordinal"), opened.over(by).alias("open"))
    under = Window.partitionBy("extraction_id", "ordinal").orderBy("sequence_no", "segment_id")
    held = rows.where(asks | (answers & F.coalesce("open", F.lit(False))))
    return held.withColumn("answer_order", F.row_number().over(under) - 1).drop("open")


def guidance(segments: DataFrame, extractions: DataFrame, form: dict = RUT_CANCELLATION) -> dict[str, DataFrame]:
    """``pages`` (extraction_id, state, questions, document_id), ``rows`` of the registered ones, and their ``evidence``.

    ``extractions``: (extraction_id, manifestation_id, extractor, version,
    document_id).  A page is refused by the first of: another extractor, a
    version that is no number or too old, no segments, another heading,
    another number of questions than the form has, a question without an
    answer, a manifestation that another document holds.
    """
    first = segments.groupBy("extraction_id").agg(F.min(F.struct("sequence_no", "segment_id", "segment_type", "text")).alias("first"))
    asked = sessions(segments)
    counts = asked.groupBy("extraction_id", "ordinal").agg(F.count(F.lit(1)).alias("n")).groupBy("extraction_id").agg(F.count(F.lit(1)).alias("questions"), F.count(F.when(F.col("n") < 2, 1)).alias("bare"))
    document = prefixed_id("DOC", F.lit(form["key"]))
    number = F.trim("version").try_cast("int")
    met = extractions.join(first, "extraction_id", "left").join(counts, "extraction_id", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))
    headed = F.coalesce((F.col("first.segment_type") == "section_heading") & (F.trim("first.text") == form["title"]), F.lit(False))
    state = (
        F.when(~F.col("extractor").eqNullSafe(form["extractor"]), "unsupported_extractor")
        .when(number.isNull(), "non_numeric_version")
        .when(number < form["least_version"], "version_too_old")
        .when(F.col("first").isNull(), "no_segments")
        .when(~headed, "unexpected_heading")
        .when(F.col("questions") != form["questions"], "question_count")
        .when(F.col("bare") > 0, "question_without_answer")
        .when(F.col("document_id") != document, "linked_elsewhere")
        .otherwise("registered")
    )
    met = met.withColumn("state", state)
    pages = met.select("extraction_id", "manifestation_id", "state", "questions", F.when(F.col("state") == "registered", document).otherwise(F.col("document_id")).alias("document_id"))
    good = met.where("state = 'registered'")
    rows = asked.join(good.select("extraction_id"), "extraction_id").withColumn("document_id", document)
    asks = F.col("answer_order") == 0
    # The id of a question is that of its segment, carried to its answers.
    own = rows.where(asks).select("extraction_id", "ordinal", prefixed_id("GQ", F.col("document_id"), F.col("ordinal").cast("string"), F.col("segment_id").cast("string")).alias("question_id"))
    rows = rows.join(own, ["extraction_id", "ordinal"]).select("question_id", "document_id", "extraction_id", "ordinal", "answer_order", "segment_id", "text")
    role = F.concat(F.lit("question_"), F.col("ordinal").cast("string"), F.when(asks, "").otherwise(F.concat(F.lit("_answer_"), F.col("answer_order").cast("string"))))
    heads = good.select("extraction_id", F.col("first.segment_id").alias("segment_id"), F.lit("document_identity").alias("role"))
    evidence = heads.unionByName(rows.select("extraction_id", "segment_id", role.alias("role"))).withColumn("evidence_id", evidence_id(F.col("segment_id"), GUIDANCE_PARSER, GUIDANCE_VERSION, F.col("role")))
    return {"pages": pages, "rows": rows, "evidence": evidence}
