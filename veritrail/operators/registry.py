"""Documents, provisions and sources of a registry: identity, look-ups, dates and their promotion, structure of segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.forms import key_form
from veritrail.functions.text import document_number, spanish_date
from veritrail.operators.citations import folded, spans

#: How texts give their dates and their beginning, and how they cite acts, in lower case without marks.
DATE = r"[0-9]{1,2}\s+de\s+[a-z]+\s+de\s+[0-9]{4}"
#: Each with words that all its matches have: other texts need no look at its pattern.
ROLES = (
    ("publication", rf"diario\s+oficial\s+no\.?\s*[0-9.]+\s+de\s+{DATE}", ("diario", "oficial")),
    ("issued", rf"dad[oa]\s+en\s+.+?,\s*(?:a\s+)?{DATE}", ("dad", "en")),
    ("commencement", r"rige\s+a\s+partir\s+de\s+la\s+fecha\s+de\s+su\s+publicacion(?:\s+en\s+el\s+diario\s+oficial)?", ("rige", "partir", "publicacion")),
)
CITATION = r"\b(?:ley|decreto|resolucion|circular|sentencia|concepto|oficio)\s+(?:numero\s+)?[a-z0-9._/-]+(?:\s+de\s+[0-9]{4})?\b"
#: What marks editorial matter, in key form, and how far from the start and from a closing dates are trusted.
EDITORIAL = ("NOTA DE VIGENCIA", "NOTAS DE VIGENCIA", "NOTA: VIGENCIA", "MODIFICADO POR", "MODIFICADA POR", "DEROGADO POR", "DEROGADA POR", "ADICIONADO POR", "ADICIONADA POR", "JURISPRUDENCIA", "CONCORDANCIA")
FRONT_MATTER, NEAR_CLOSING = 30, 2
ARTICLES = ("article", "regulatory_article")


def first_identifier(identifiers: DataFrame) -> DataFrame:
    """(document_id, identifier_value): each document's first primary identifier."""
    primary = identifiers.where("identifier_type = 'primary'")
    return primary.groupBy("document_id").agg(F.min(F.struct("identifier_id", "identifier_value"))["identifier_value"].alias("identifier_value"))


def provenance(segments: DataFrame, extractions: DataFrame, manifestations: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments with their extraction, manifestation, source and, where bound, document; only successful extractions count."""
    chain = segments.join(extractions.where("status = 'success'").select("extraction_id", "manifestation_id"), "extraction_id").join(manifestations.select("manifestation_id", "document_id", "source_id"), "manifestation_id").join(sources, "source_id")
    return chain.join(documents.select("document_id", "title"), "document_id", "left")


def sources_of(manifestations: DataFrame, sources: DataFrame) -> DataFrame:
    """(document_id, manifestations, sources): a document's manifestations counted and its source addresses in order."""
    bound = manifestations.where("document_id IS NOT NULL").join(sources, "source_id")
    return bound.groupBy("document_id").agg(F.count(F.lit(1)).alias("manifestations"), F.sort_array(F.collect_set("source_url")).alias("sources"))


def identity(url_type: Column, url_number: Column, url_year: Column, head_type: Column, head_number: Column, head_year: Column, issuer: Column, scoped: Column) -> Column:
    """State of a document's identity by its address and its heading, first rule that applies."""
    differs = (url_type != head_type) | F.coalesce(url_number != head_number, F.lit(False)) | F.coalesce(url_year != head_year, F.lit(False))
    return (
        F.when(url_type.isNull(), F.when(head_type.isNotNull(), "IDENTITY_CONFLICT").otherwise("IDENTITY_UNRESOLVED"))
        .when(head_type.isNull(), "IDENTITY_UNRESOLVED")
        .when(differs, "IDENTITY_CONFLICT")
        .when(scoped & issuer.isNull(), "ISSUER_IDENTITY_UNRESOLVED")
        .otherwise("accepted")
    )


def family_identity(candidates: DataFrame, most: int = 12) -> DataFrame:
    """(document, state) from headings (document, sequence_no, compatible; null for a row without one): only the first ``most`` segments count."""
    early = candidates.withColumn("fits", F.when(F.col("sequence_no") <= most, F.col("compatible")))
    good, bad = F.countDistinct(F.when(F.col("fits"), F.col("heading"))), F.count(F.when(~F.col("fits"), F.lit(1)))
    state = F.when(good > 1, "FAMILY_IDENTITY_AMBIGUOUS").when(good == 1, "accepted").when(bad > 0, "IDENTITY_CONFLICT").otherwise("IDENTITY_UNRESOLVED")
    return early.groupBy("document").agg(state.alias("state"))


def equivalent_keys(documents: DataFrame) -> DataFrame:
    """(document_id, representative, copies, compatible): which documents' keys mean the same act, by classes and not by pairs.

    A class has equal type, number (leading zeros aside), year and issuer, the
    unknown issuer being one of them; its representative is its smallest id.
    ``compatible`` lists the other classes of the act that may be the same: all
    of them for an unknown issuer, the unknown one for a known issuer.
    """
    act = ["document_type", "number", "year"]
    rows = documents.withColumn("number", document_number(F.col("number").cast("string")))
    classes = rows.groupBy(*act, "issuer").agg(F.min("document_id").alias("representative"), F.count(F.lit(1)).alias("copies"))
    acts = classes.groupBy(*act).agg(F.sort_array(F.collect_list(F.when(F.col("issuer").isNotNull(), F.col("representative")))).alias("known"), F.max(F.when(F.col("issuer").isNull(), F.col("representative"))).alias("unknown"))
    met = classes.join(acts, act).withColumn("compatible", F.when(F.col("issuer").isNull(), F.col("known")).otherwise(F.array_compact(F.array("unknown"))))
    named = met.select(*act, F.coalesce("issuer", F.lit("")).alias("__i"), "representative", "copies", "compatible")
    return rows.withColumn("__i", F.coalesce("issuer", F.lit(""))).join(named, [*act, "__i"]).select("document_id", "representative", "copies", "compatible")


def issuer_split(claims: DataFrame) -> DataFrame:
    """(document_id, plan, issuers) from claims (document_id, issuer): several issuers split a document, one that it lacks fills it, one that differs conflicts."""
    sets = claims.groupBy("document_id", "own_issuer").agg(F.countDistinct("issuer").alias("issuers"), F.min("issuer").alias("one"))
    plan = F.when(F.col("issuers") > 1, "split").when(F.col("issuers") == 0, "keep").when(F.col("own_issuer").isNull(), "backfill").when(F.col("own_issuer") != F.col("one"), "conflict").otherwise("keep")
    return sets.select("document_id", plan.alias("plan"), "issuers")


def provision_index(provisions: DataFrame, observations: DataFrame) -> DataFrame:
    """(provision_id, observations, texts, extractions): what was seen of each provision; several texts mean a conflict."""
    seen = observations.groupBy("provision_id").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("text_hash").alias("texts"), F.countDistinct("extraction_id").alias("extractions"))
    return provisions.join(seen, "provision_id", "left").fillna(0, ["observations", "texts", "extractions"])


def exact_lookup(asked: DataFrame, documents: DataFrame, provisions: DataFrame) -> DataFrame:
    """(ref, state, document_id, provision_id) of asked (ref, kind, id): an exact target or the reason why not; nothing is searched instead."""
    d = asked.join(documents.select(F.col("document_id").alias("found_doc")), (F.col("kind") == "document") & (F.col("id") == F.col("found_doc")), "left")
    both = d.join(provisions.select(F.col("provision_id").alias("found_prov"), F.col("document_id").alias("own_doc")), (F.col("kind") == "provision") & (F.col("id") == F.col("found_prov")), "left")
    both = both.join(documents.select(F.col("document_id").alias("held")), F.col("own_doc") == F.col("held"), "left")
    state = F.when(~F.col("kind").isin("document", "provision"), "unsupported_kind").when(F.coalesce("found_doc", "found_prov").isNull(), "not_found").when((F.col("kind") == "provision") & F.col("held").isNull(), "inconsistent_target").otherwise("found")
    return both.select("ref", state.alias("state"), F.coalesce("found_doc", "held").alias("document_id"), F.col("found_prov").alias("provision_id"))


def provision_for_segment(observations: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, state, provision_id): the one provision whose observation of the segment has the segment's extraction; none or several say so."""
    met = segments.select("segment_id", "extraction_id").join(observations.select("segment_id", "provision_id", F.col("extraction_id").alias("seen_in")), "segment_id", "left")
    good = F.when(F.col("seen_in") == F.col("extraction_id"), F.col("provision_id"))
    # The least and the most tell none, one and several apart; a distinct count would hold each segment twice more.
    one, most = F.min(good), F.max(good)
    return met.groupBy("segment_id").agg(F.when(one == most, "citable").when(one < most, "ambiguous").when(F.count("provision_id") > 0, "unverified").otherwise("missing").alias("state"), F.when(one == most, one).alias("provision_id"))


def boundaries(segments: DataFrame) -> DataFrame:
    """(extraction_id, first_article, segments): where articles begin, one past the end if there are none."""
    first = F.min(F.when(F.col("segment_type").isin(*ARTICLES), F.col("sequence_no")))
    return segments.groupBy("extraction_id").agg(F.coalesce(first, F.count(F.lit(1)) + 1).alias("first_article"), F.count(F.lit(1)).alias("segments"))


def main_heading(segments: DataFrame, ratio: Column, matches: Column, least: float = 0.8) -> DataFrame:
    """(extraction_id, segment_id): the first matching heading in capitals, else the first matching one."""
    best = F.min(F.struct((ratio < least).alias("low"), "sequence_no", "segment_id"))
    return segments.where(matches).groupBy("extraction_id").agg(best.alias("b")).select("extraction_id", F.col("b.segment_id").alias("segment_id"))


def paired_rows(segments: DataFrame, is_label: Column) -> DataFrame:
    """(segment_id, next_id): each label row with the row after it, if that is no label."""
    by = Window.partitionBy("extraction_id").orderBy("sequence_no")
    both = segments.withColumn("__l", is_label).withColumn("next_id", F.lead("segment_id").over(by)).withColumn("__n", F.lead("__l").over(by))
    return both.where(F.col("__l") & ~F.coalesce("__n", F.lit(True))).select("segment_id", "next_id")


def date_candidates(segments: DataFrame) -> DataFrame:
    """(segment_id, extraction_id, role, at, quote, value, is_trusted, context) of every date, or rule of commencement, that segments state.

    ``segments`` may have ``section_path``, the heading that a segment stands
    under.  First rule that holds: editorial matter, in the text or its
    heading, is never trusted; publication is, in the front matter before the
    first article and without a citation; issue is, in a closing, or near one
    without a citation; commencement is, in an article or under an article's
    heading that speaks of it.  A date that is none has no value.
    """
    path = F.coalesce("section_path", F.lit("")) if "section_path" in segments.columns else F.lit("")
    whole = Window.partitionBy("extraction_id")
    near = whole.orderBy("sequence_no").rangeBetween(-NEAR_CLOSING, NEAR_CLOSING)

    def stated(role: str, pattern: str, words: tuple[str, ...]) -> Column:
        found = F.transform(spans(F.col("low"), pattern), lambda m: F.struct(F.lit(role).alias("role"), m["start"].alias("at"), m["raw"].alias("quote")))
        none = F.expr("CAST(array() AS array<struct<role: string, at: int, quote: string>>)")
        return F.when(reduce(Column.__and__, (F.contains(F.col("low"), F.lit(w)) for w in words)), found).otherwise(none)

    # Where articles begin and closings stand is seen beside the texts, and only what states something is read further.
    first = F.min(F.when(F.col("segment_type").isin(*ARTICLES), F.col("sequence_no"))).over(whole)
    placed = segments.where("extraction_id IS NOT NULL").select("segment_id", "extraction_id", "sequence_no", "segment_type", "text", path.alias("path"))
    placed = placed.withColumn("closing", F.max((F.col("segment_type") == "closing").cast("int")).over(near) == 1).withColumn("first_article", F.coalesce(first, F.count(F.lit(1)).over(whole) + 1))
    placed = placed.withColumn("low", folded(F.col("text"))).withColumn("c", F.explode(F.flatten(F.array(*[stated(*role) for role in ROLES]))))
    found = placed.withColumn("path", key_form(F.col("path"))).withColumn("key", key_form(F.col("text"))).withColumn("cites", F.col("low").rlike(CITATION)).withColumn("both", F.concat_ws(" ", "path", "key")).select("*", "c.*")
    cites, role = F.col("cites"), F.col("role")
    editorial = F.lit(False)
    for mark in EDITORIAL:
        editorial = editorial | F.col("both").contains(mark)
    front = (F.col("sequence_no") < F.col("first_article")) & (F.col("sequence_no") <= FRONT_MATTER) & F.col("segment_type").isin("document_heading", "section_heading", "text", "table_row")
    context = (
        F.when(editorial, "editorial_history")
        .when((role == "publication") & front & ~cites, "publication_metadata")
        .when((role == "issued") & ((F.col("segment_type") == "closing") | (F.col("closing") & ~cites)), "primary_document_date")
        .when((role == "commencement") & (F.col("segment_type").isin(*ARTICLES) | (F.col("path").startswith("ARTICULO") & (F.col("path").contains("VIGENCIA") | F.col("key").contains("RIGE")))), "commencement_clause")
        .when(cites, "quoted_cited_norm")
        .otherwise("unknown")
    )
    out = found.withColumn("context", context).withColumn("value", F.when(role != "commencement", spanish_date(F.regexp_extract("quote", f"{DATE}$", 0))))
    return out.select("segment_id", "extraction_id", "role", "at", "quote", "value", F.col("context").isin("publication_metadata", "primary_document_date", "commencement_clause").alias("is_trusted"), "context")


def promoted_events(roles: DataFrame) -> DataFrame:
    """(document, event_type, event_date) from resolved roles (document, role, status, value): issued and published as they are; in force on the publication's day, only if commencement is resolved too."""
    value = lambda r: F.max(F.when((F.col("role") == r) & (F.col("status") == "resolved"), F.col("value")))
    known = F.bool_or((F.col("role") == "commencement") & (F.col("status") == "resolved"))
    wide = roles.groupBy("document").agg(value("issued").alias("issued"), value("publication").alias("published"), known.alias("commences"))
    events = F.array(F.struct(F.lit("issued").alias("event_type"), F.col("issued").alias("event_date")), F.struct(F.lit("published").alias("event_type"), F.col("published").alias("event_date")), F.struct(F.lit("enters_into_force").alias("event_type"), F.when(F.col("commences"), F.col("published")).alias("event_date")))
    return wide.select("document", F.inline(F.filter(events, lambda e: e["event_date"].isNotNull())))


def superseded(old: DataFrame, new: DataFrame) -> DataFrame:
    """(event_id, status): older events of documents that have new ones of their type with another day."""
    fresh = new.groupBy(F.col("document").alias("document_id"), "event_type").agg(F.collect_set("event_date").alias("days"))
    met = old.join(fresh, ["document_id", "event_type"], "left")
    return met.select("event_id", F.when(F.col("days").isNull() | F.array_contains("days", F.col("event_date")), "active").otherwise("superseded").alias("status"))


def relation_dates(relations: DataFrame, effective: DataFrame) -> DataFrame:
    """(relation_id, asserted, effective): outgoing relations take both dates of their source, inverse ones (``…_by``) the effective one only."""
    met = relations.join(effective, F.col("source_document") == F.col("document"), "left")
    inverse = F.col("relation_type").endswith("_by")
    return met.select("relation_id", F.when(~inverse, F.col("issued")).alias("asserted"), F.col("in_force").alias("effective"))
