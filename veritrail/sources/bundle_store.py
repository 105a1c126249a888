"""Bundles kept as content-addressed artifacts: cut into payloads, stored once each, put together again and verified.

A bundle is its metadata and parts (kind, ordinal, canonical JSON payload).
Payloads are objects named by their SHA-256; a recipe lists a bundle's parts
with the owner and the trust role that their kind must have; the bundle's
digest covers the whole recipe.  What is stored is never changed: a bundle
that comes back is reused if it is the same, and refused if it is not.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.sources.shared import bucketed, written

#: Kinds of parts, each with the field that names it, its owner, its trust role, and whether a bundle may have several.
KINDS = (
    ("case_input", None, "caller", "caller_input", False),
    ("intake_draft", "intake_ref", "internal_intake_model", "intake_only", False),
    ("research_plan", "plan_ref", "platform", "platform_research", False),
    ("research_result", "result_ref", "platform", "platform_research", False),
    ("official_source", "source_ref", "platform", "source_metadata", True),
    ("canonical_authority", "authority_ref", "platform", "canonical_legal_support", True),
    ("evidence_span", "evidence_ref", "platform", "canonical_legal_support", True),
    ("normative_relationship", "relationship_ref", "platform", "canonical_legal_support", True),
    ("rule_fragment", "rule_ref", "platform", "canonical_legal_support", True),
    ("deterministic_evaluation", "evaluation_ref", "platform", "deterministic_platform", True),
    ("calculation_trace", "calculation_ref", "platform", "deterministic_platform", True),
    ("unresolved_item", "unresolved_ref", "platform", "unresolved_platform", True),
)
SINGLES = [k for k, *_, many in KINDS if not many]
_LINE = "kind: string, ordinal: int, artifact_ref: string, owner: string, role: string, payload_sha256: string"


def _of_kind(place: int, kind: Column | None = None) -> Column:
    kind = F.col("kind") if kind is None else kind
    out = F.lit(None).cast("string")
    for row in KINDS:
        out = F.when(kind == row[0], F.lit(row[place]).cast("string")).otherwise(out)
    return out


def _named(payload: Column) -> Column:
    """The reference that a payload gives itself; the kind stands in where it has none."""
    out = F.col("kind")
    for kind, field, *_ in KINDS:
        if field:
            out = F.when(F.col("kind") == kind, F.get_json_object(payload, f"$.{field}")).otherwise(out)
    return out


def _line() -> Column:
    """What a recipe line says, hashes as bytes (half as long when lines are gathered); one that is no hash stays as it is."""
    sha = F.col("payload_sha256")
    is_hash = F.coalesce(sha.rlike("^([0-9a-f]{2})+$"), F.lit(False))
    return F.struct("kind", "ordinal", F.when(is_hash, F.unhex(sha)).alias("bytes"), F.when(~is_hash, sha).alias("other"))


def _digest(lines: Column) -> Column:
    """SHA-256 of a bundle's recipe lines in order; a bundle is read as a whole, so its lines are gathered."""
    text = F.transform(lines, lambda x: F.concat_ws(":", x["kind"], F.lpad(x["ordinal"].cast("string"), 9, "0"), F.coalesce(F.lower(F.hex(x["bytes"])), x["other"])))
    return F.sha2(F.array_join(F.sort_array(text), "\n"), 256)


def _references(payload: Column) -> Column:
    """The fields of a payload that may name it, by field; one is looked for only where it may stand, escaped letters included."""
    may = lambda f: F.contains(payload, F.lit(f)) | F.contains(payload, F.lit("\\"))
    fields = [F.struct(F.lit(f).alias("field"), F.when(may(f), F.get_json_object(payload, f"$.{f}")).alias("value")) for _, f, *_ in KINDS if f]
    return F.map_from_entries(F.filter(F.array(*fields), lambda x: x["value"].isNotNull()))


def _claim(*named: Column) -> Column:
    """128 bits of a payload's hash with the field that names it and its name, or of the hash alone; null if one is null."""
    return F.unhex(F.md5(F.concat(F.col("payload_sha256"), *[x for n in named for x in (F.lit("\n"), n)])))


def shred(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recipes, objects) of parts (bundle_ref, kind, ordinal, payload)."""
    rows = parts.withColumn("payload_sha256", F.sha2("payload", 256))
    recipes = rows.select("bundle_ref", "kind", "ordinal", _named(F.col("payload")).alias("artifact_ref"), _of_kind(2).alias("owner"), _of_kind(3).alias("role"), "payload_sha256")
    return recipes, rows.dropDuplicates(["payload_sha256"]).select("payload_sha256", "payload")


def digests(recipes: DataFrame) -> DataFrame:
    """(bundle_ref, bundle_sha256, artifacts)."""
    return recipes.groupBy("bundle_ref").agg(_digest(F.collect_list(_line())).alias("bundle_sha256"), F.count(F.lit(1)).alias("artifacts"))


def plan(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(bundle_ref, action) of digests that come in against stored ones: insert, reuse, refuse; what a dry run shows and a write obeys."""
    met = incoming.select("bundle_ref", "bundle_sha256").join(stored.select("bundle_ref", F.col("bundle_sha256").alias("held")), "bundle_ref", "left")
    return met.select("bundle_ref", F.when(F.col("held").isNull(), "insert").when(F.col("held") == F.col("bundle_sha256"), "reuse").otherwise("refuse").alias("action"))


def verify(stored: DataFrame, recipes: DataFrame, objects: DataFrame) -> DataFrame:
    """(bundle_ref, state, artifacts) of stored digests: ``verified``, or the first fault by a fixed order.

    Faults: an unknown kind, another owner or role than the kind's, a payload
    that is gone or has another hash, a payload that names itself otherwise,
    ordinals with gaps, a single part that is missing or doubled, and a recipe
    that doesn't give the stored digest.
    """
    stated = F.when(~F.col("kind").isin(*[k for k, *_ in KINDS]), "1_unknown_kind").when((F.col("owner") != _of_kind(2)) | (F.col("role") != _of_kind(3)), "2_ownership_mismatch")
    lines = recipes.select("bundle_ref", "kind", "ordinal", "artifact_ref", "payload_sha256", stated.alias("stated"))
    # Payloads stay where they are: what travels are 128 bits of what lines claim of them and of what whole payloads bear out.
    field = _of_kind(1)
    asked = F.when(field.isNotNull(), _claim(field, F.col("artifact_ref"))).when(F.col("kind").eqNullSafe(F.col("artifact_ref")), _claim())
    asking = lines.where("stated IS NULL").withColumn("claim", asked)
    whole = objects.where(F.sha2("payload", 256) == F.col("payload_sha256")).select("payload_sha256", _references(F.col("payload")).alias("names"))
    borne = whole.select("payload_sha256", F.explode_outer("names").alias("field", "value")).select(F.when(F.col("field").isNull(), _claim()).otherwise(_claim(F.col("field"), F.col("value"))).alias("claim"))
    lost = written(asking.select("claim").dropna().join(borne, "claim", "left_anti").distinct(), "lost-claims")
    # Only lines whose claim was not found meet objects, to be told why.
    odd = written(asking.join(lost.withColumn("lost", F.lit(True)), "claim", "left").where("claim IS NULL OR lost").select("bundle_ref", "kind", "artifact_ref", "payload_sha256"), "odd-lines")
    named_there = objects.where("payload IS NOT NULL").join(odd.select("payload_sha256"), "payload_sha256", "left_semi")
    seen = named_there.select("payload_sha256", (F.sha2("payload", 256) == F.col("payload_sha256")).alias("whole"), _references(F.col("payload")).alias("names"))
    named = F.when(field.isNull(), F.col("kind")).otherwise(F.try_element_at("names", field))
    why = F.when(F.col("whole").isNull(), "3_payload_missing").when(~F.col("whole"), "4_payload_hash_mismatch").when(~named.eqNullSafe(F.col("artifact_ref")), "5_artifact_ref_mismatch")
    faults = odd.join(seen, "payload_sha256", "left").groupBy("bundle_ref").agg(F.min(why).alias("why"))
    # Lines meet by bundle once; a store's own lines lie by bundle already.
    singles = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in SINGLES]
    sums = lines.groupBy("bundle_ref").agg(F.min("stated").alias("stated"), F.sort_array(F.collect_list(_line())).alias("lines"), *singles)
    before = lambda i: F.get("lines", i - 1)
    due = lambda x, i: F.when((i > 0) & before(i)["kind"].eqNullSafe(x["kind"]), before(i)["ordinal"] + 1).otherwise(0)
    gap = F.exists(F.transform("lines", lambda x, i: ~due(x, i).eqNullSafe(x["ordinal"])), lambda x: x)
    unsingle = ~functools.reduce(Column.__and__, [F.col(k) == 1 for k in SINGLES])
    judged = sums.select("bundle_ref", "stated", F.when(gap, "6_ordinals_not_contiguous").when(unsingle, "7_single_part_count").alias("shape"), _digest(F.col("lines")).alias("now"), F.size("lines").cast("long").alias("found"))
    out = stored.join(judged, "bundle_ref", "left").join(faults, "bundle_ref", "left")
    fault = F.coalesce(F.least("stated", "why"), "shape", F.when(F.col("found").isNull(), "7_single_part_count"), F.when(~F.col("bundle_sha256").eqNullSafe(F.col("now")), "8_bundle_hash_mismatch"))
    return out.select("bundle_ref", F.coalesce(F.substring(fault, F.lit(3), F.length(fault)), F.lit("verified")).alias("state"), F.coalesce("found", F.lit(0)).alias("artifacts"))


def load(recipes: DataFrame, objects: DataFrame, verified: DataFrame) -> DataFrame:
    """(bundle_ref, parts) of verified bundles: each kind's payloads in order."""
    good = verified.where("state = 'verified'").select("bundle_ref")
    rows = recipes.join(good, "bundle_ref", "left_semi").join(objects, "payload_sha256")
    kinds = rows.groupBy("bundle_ref", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "payload"))), lambda p: p["payload"]).alias("payloads"))
    return kinds.groupBy("bundle_ref").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "payloads")))).alias("parts"))


class BundleStore:
    """A store of this session: objects at ``path`` by write, bundles with their recipes as tables bucketed by bundle."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path, self.writes, self.held = spark, path, 0, []

    def objects(self) -> DataFrame:
        schema = "payload_sha256 string, payload string"
        if not self.writes:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/objects/write={w}" for w in range(self.writes)])

    def _bundles(self) -> DataFrame:
        """One row a bundle with its recipe; of one write, rows lie by bundle, which Spark knows."""
        if not self.writes:
            return self.spark.createDataFrame([], f"bundle_ref string, bundle_sha256 string, artifacts long, lines array<struct<{_LINE}>>")
        return functools.reduce(DataFrame.unionAll, [self.spark.table(t) for t in self.held])

    def recipes(self) -> DataFrame:
        return self._bundles().select("bundle_ref", F.inline("lines"))

    def bundles(self) -> DataFrame:
        return self._bundles().select("bundle_ref", "bundle_sha256", "artifacts")

    def persist(self, parts: DataFrame, dry_run: bool = False) -> DataFrame:
        """The plan for bundles of ``parts``; unless ``dry_run``, new ones are written and verified.  Raises if a bundle comes back changed."""
        if dry_run:
            return plan(digests(shred(parts)[0]), self.bundles())
        # Lines are gathered once, without owners and roles, which follow from kinds; the digest and the stored recipe come of that.
        line = F.struct("kind", F.col("ordinal").cast("int").alias("ordinal"), "artifact_ref", F.unhex("payload_sha256").alias("bytes"))
        gathered = shred(parts)[0].groupBy("bundle_ref").agg(F.collect_list(line).alias("gathered"))
        told = lambda x: F.struct(x["kind"].alias("kind"), x["ordinal"].alias("ordinal"), x["artifact_ref"].alias("artifact_ref"), _of_kind(2, x["kind"]).alias("owner"), _of_kind(3, x["kind"]).alias("role"), F.lower(F.hex(x["bytes"])).alias("payload_sha256"))
        digest = _digest(F.transform("gathered", lambda x: F.struct(x["kind"].alias("kind"), x["ordinal"].alias("ordinal"), x["bytes"].alias("bytes"), F.lit(None).cast("string").alias("other"))))
        incoming, name = bucketed(gathered.select("bundle_ref", digest.alias("bundle_sha256"), F.size("gathered").cast("long").alias("artifacts"), F.transform("gathered", told).alias("lines")), "bundles", "bundle_ref")
        actions = plan(incoming, self.bundles())
        if changed := actions.where("action = 'refuse'").limit(1).count():
            raise ValueError(f"{changed} bundle or more comes back with another content")
        # Where no bundle comes back all are new, and parts need not meet the list of new ones.
        if actions.where("action = 'reuse'").limit(1).count():
            new = actions.where("action = 'insert'").select("bundle_ref")
            incoming, name = bucketed(incoming.join(new, "bundle_ref", "left_semi"), "bundles", "bundle_ref")
            parts = parts.join(new, "bundle_ref", "left_semi")
        self._fresh(parts, incoming).write.option("compression", "zstd").parquet(f"{self.path}/objects/write={self.writes}")
        self.held.append(name)
        self.writes += 1
        if self.verified().where("state <> 'verified'").limit(1).count():
            raise ValueError("a stored bundle does not verify")
        return actions

    def _fresh(self, parts: DataFrame, incoming: DataFrame) -> DataFrame:
        """The objects of ``parts`` that are not stored, once each.  Payloads move only if recipes name their hash more than once or objects are held already."""
        rows = parts.select(F.sha2("payload", 256).alias("payload_sha256"), "payload")
        key = F.xxhash64("payload_sha256").alias("key")
        # 64 bits find all that may be shared; what is shared is told by whole hashes.
        named = incoming.select(F.explode("lines.payload_sha256").alias("payload_sha256")).select(key)
        shared = written(named.groupBy("key").count().where("count > 1").select("key"), "shared-payloads")
        if shared.limit(1).count():
            keyed = rows.withColumn("key", key)
            once = keyed.join(shared, "key", "left_semi").dropDuplicates(["payload_sha256"])
            rows = keyed.join(shared, "key", "left_anti").unionByName(once).drop("key")
        return rows.join(self.objects().select("payload_sha256"), "payload_sha256", "left_anti") if self.writes else rows

    def verified(self) -> DataFrame:
        return verify(self.bundles(), self.recipes(), self.objects())

    def load(self) -> DataFrame:
        return load(self.recipes(), self.objects(), self.verified())
