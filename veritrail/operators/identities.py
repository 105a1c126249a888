"""Registration of document identities: bind, alias or unbind manifestations by what was assessed, as one rewrite of the tables concerned.

Ids follow from canonical keys, so all rows are decided at once by joins on
keys, and running again on the result changes nothing (a manifestation that a
conflict unbound is free in the next run, and settles then).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.ids import prefixed_id
from veritrail.functions.text import document_number
from veritrail.operators.doctor import ISSUER_SCOPED

#: Why an identity stays open; registration closes reviews of these.
REASONS = ("IDENTITY_UNRESOLVED", "IDENTITY_CONFLICT", "ISSUER_IDENTITY_UNRESOLVED", "FAMILY_IDENTITY_AMBIGUOUS", "SOURCE_IDENTITY_CONFLICT")


def canonical_key(issuer: Column, document_type: Column, number: Column, year: Column) -> Column:
    """The key of an act; types that several issuers have name theirs.  Null if a part is missing."""
    scoped = document_type.isin(*ISSUER_SCOPED)
    whole = document_type.isNotNull() & number.isNotNull() & year.isNotNull() & (~scoped | issuer.isNotNull())
    return F.when(whole, F.concat_ws(":", F.lit("CO"), F.when(scoped, issuer), document_type, number, year.cast("string")))


def equivalent(asked: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(manifestation_id, equivalent_key): the key by which a manifestation's present document is already the assessed act.

    Numbers compare without leading zeros.  A key with an issuer needs the same
    one; a key without is for types that need none, or for trusted families,
    and must not contradict a known issuer.
    """
    parts = F.split("identifier_value", ":")
    n = F.size(parts)
    part = lambda i: F.get(parts, n - i)
    keys = identifiers.where((F.col("identifier_type") == "canonical_key") & n.isin(4, 5) & (F.get(parts, F.lit(0)) == "CO"))
    keys = keys.select(F.col("document_id").alias("present"), part(3).alias("document_type"), document_number(part(2)).alias("number"), part(1).try_cast("int").alias("year"), F.when(n == 5, F.get(parts, F.lit(1))).alias("key_issuer"), F.col("issuer").alias("row_issuer"), F.struct((~F.col("is_primary")).alias("later"), "identifier_id", "identifier_value").alias("found_key"))
    scoped = F.col("document_type").isin(*ISSUER_SCOPED)
    same = F.when(F.col("key_issuer").isNotNull(), scoped & (F.col("key_issuer") == F.col("issuer"))).otherwise((~scoped | F.col("trusted_family")) & (F.col("row_issuer").isNull() | F.col("issuer").isNull() | (F.col("row_issuer") == F.col("issuer"))))
    met = asked.join(keys, ["present", "document_type", "number", "year"]).where(F.coalesce(same, F.lit(False)))
    return met.groupBy("manifestation_id").agg(F.min("found_key")["identifier_value"].alias("equivalent_key"))


def register(assessed: DataFrame, manifestations: DataFrame, documents: DataFrame, identifiers: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """The tables after registration, and ``decisions``, one row for each assessed manifestation.

    ``assessed``: (manifestation_id, state, document_type, number, year,
    issuer, title, trusted_family); manifestations (manifestation_id,
    document_id), documents (document_id, entity, document_type, title),
    identifiers (identifier_id, document_id, identifier_type, identifier_value,
    issuer, is_primary), reviews (review_id, entity_type, entity_id, reason,
    resolution).  Outcomes: registered, aliased (the present document is that
    act under another key), unresolved, conflict; the last two unbind.
    """
    number = document_number(F.col("number"))
    asked = assessed.withColumn("number", number).withColumn("key", canonical_key(F.col("issuer"), F.col("document_type"), F.col("number"), F.col("year")))
    asked = asked.join(manifestations.select("manifestation_id", F.col("document_id").alias("present")), "manifestation_id")
    accepted = (F.col("state") == "accepted") & F.col("key").isNotNull()
    asked = asked.withColumn("accepted", accepted).withColumn("new_id", F.when(accepted, prefixed_id("DOC", F.col("key"))))
    other = F.col("accepted") & F.col("present").isNotNull() & (F.col("present") != F.col("new_id"))
    met = asked.join(equivalent(asked.where(other), identifiers), "manifestation_id", "left")
    outcome = F.when(~F.col("accepted"), "unresolved").when(other & F.col("equivalent_key").isNull(), "conflict").when(other, "aliased").otherwise("registered")
    met = met.withColumn("outcome", outcome).withColumn("bound", F.when(F.col("outcome") == "registered", F.col("new_id")).when(F.col("outcome") == "aliased", F.col("present")))
    reason = F.when(F.col("outcome") == "conflict", "SOURCE_IDENTITY_CONFLICT").when(F.col("outcome") == "unresolved", F.when(F.col("state") == "accepted", "IDENTITY_UNRESOLVED").otherwise(F.col("state")))
    primary = F.when((F.col("outcome") == "aliased") & ~F.col("trusted_family"), F.col("equivalent_key")).otherwise(F.col("key"))
    decided = met.withColumn("reason", reason).withColumn("primary_key", F.when(F.col("bound").isNotNull(), primary))
    decisions = decided.select("manifestation_id", "outcome", F.col("present").alias("present_id"), F.col("bound").alias("document_id"), "primary_key", "reason")

    bound = decided.where("bound IS NOT NULL")
    after_manifestations = manifestations.join(decided.select("manifestation_id", "bound", F.lit(True).alias("__d")), "manifestation_id", "left").select("manifestation_id", F.when(F.col("__d"), F.col("bound")).otherwise(F.col("document_id")).alias("document_id"))
    # Of several manifestations of an act the one with the largest id names the document, as the last to be registered.
    named = bound.groupBy(F.col("bound").alias("document_id")).agg(F.max(F.struct("manifestation_id", F.col("issuer").alias("entity"), "document_type", "title")).alias("n"))
    both = documents.select("document_id", "entity", "document_type", "title").join(named, "document_id", "full_outer")
    after_documents = both.select("document_id", *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("entity", "document_type", "title")])
    legacy = F.concat_ws(":", F.lit("CO"), "document_type", "number", F.col("year").cast("string"))
    values = F.array(F.struct(F.col("primary_key").alias("identifier_value"), F.lit(True).alias("is_primary")), F.struct(legacy.alias("identifier_value"), F.lit(False).alias("is_primary")))
    given = bound.select(F.col("bound").alias("document_id"), "issuer", F.inline(F.filter(values, lambda v: v["is_primary"] | (v["identifier_value"] != F.col("primary_key")))))
    given = given.groupBy("document_id", "identifier_value").agg(F.max("issuer").alias("new_issuer"), F.max("is_primary").alias("new_primary"))
    old = identifiers.where("identifier_type = 'canonical_key'").join(given, ["document_id", "identifier_value"], "full_outer")
    new_id = prefixed_id("ID", F.col("document_id"), F.lit("canonical"), F.col("identifier_value"))
    fresh = F.col("new_primary").isNotNull()
    after_identifiers = old.select(F.coalesce("identifier_id", new_id).alias("identifier_id"), "document_id", F.lit("canonical_key").alias("identifier_type"), "identifier_value", F.when(fresh, F.col("new_issuer")).otherwise(F.col("issuer")).alias("issuer"), F.when(fresh, F.col("new_primary")).otherwise(F.col("is_primary")).alias("is_primary"))
    after_identifiers = after_identifiers.unionByName(identifiers.where("identifier_type <> 'canonical_key'").select(after_identifiers.columns))
    opened = decided.where("reason IS NOT NULL").select(prefixed_id("REV", F.col("manifestation_id").cast("string"), F.col("reason")).alias("review_id"), F.col("manifestation_id").alias("entity_id"), "reason")
    closed = bound.select(F.col("manifestation_id").alias("entity_id"), F.lit(True).alias("closes"))
    kept = reviews.join(opened.select("review_id", F.lit(True).alias("opens")), "review_id", "left").join(closed, "entity_id", "left")
    closing = (F.col("entity_type") == "manifestation") & F.col("closes") & F.col("resolution").isNull() & F.col("reason").isin(*REASONS)
    kept = kept.select("review_id", "entity_type", "entity_id", "reason", F.when(F.col("opens"), None).when(F.coalesce(closing, F.lit(False)), "registered").otherwise(F.col("resolution")).alias("resolution"))
    added = opened.join(reviews.select("review_id"), "review_id", "left_anti").select("review_id", F.lit("manifestation").alias("entity_type"), "entity_id", "reason", F.lit(None).cast("string").alias("resolution"))
    return {"decisions": decisions, "manifestations": after_manifestations, "documents": after_documents, "identifiers": after_identifiers, "reviews": kept.unionByName(added)}


def rebind(moves: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` with every ``document_id`` replaced as moves (document_id, new_id) say: provisions, events and provenance follow an identity that was split or joined."""
    to = moves.select(F.col("document_id").alias("__old"), "new_id")
    return {name: t.join(to, F.col("document_id") == F.col("__old"), "left").withColumn("document_id", F.coalesce("new_id", "document_id")).drop("__old", "new_id") for name, t in tables.items()}
