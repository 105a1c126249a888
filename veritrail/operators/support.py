"""Support of chosen relationships: their ends, their evidence and its owners, closed over once for all cases together.

Nothing is walked.  What is required is fixed before owners of evidence are
added, so that what an owner would require itself stays out.  All tables are
rows by case; no list of a document or case is gathered.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.operators.spans import reference
from veritrail.sources.shared import written

#: Fixed value: the one kind of open item that leaves a bundle complete.
SYNTHESIS = "requires_interpretive_synthesis"


def close(starting: DataFrame, relationships: DataFrame, relation_evidence: DataFrame, intrinsic: DataFrame, owners: DataFrame, items: DataFrame) -> Graph:
    """The closed graph of each case, as tables by name.

    Reads ``starting`` (case_id, document_id), ``relationships`` (case_id,
    relationship_id, source_document, target_document), ``relation_evidence``
    (relationship_id, evidence_id), ``intrinsic`` (document_id, basis,
    evidence_id): what a document rests on apart from relationships, ``owners``
    (evidence_id, document_id; null if unresolved, known: whether there is such
    a document), ``items`` (item_id, document_id, category, evidence_id or
    null): what is open about a document.

    Gives
    ``authorities`` (case_id, document_id, role: selected, endpoint or
    evidence_owner),
    ``authority_evidence`` (case_id, document_id, basis, evidence_id),
    ``relationships`` (case_id, relationship_id, state: whole, reduced or lost)
    and ``relationship_evidence`` (case_id, relationship_id, evidence_id) of
    those that are not lost,
    ``evidence`` (case_id, evidence_id, state: required, unowned,
    evidence_missing or owner_missing, owner),
    ``unresolved`` (case_id, item_ref, category, document_id, evidence_id, new).

    Evidence without a resolved owner is taken away from all that rests on it
    and becomes an open item; a relationship that rests on nothing else is lost,
    one that never had evidence is whole.  A document rests on the chosen
    relationships that touch it.  Repeated rows count once; rows with a null
    case, document, relationship or evidence are left out.
    """
    start = starting.select("case_id", "document_id").dropna().distinct()
    chosen = written(relationships.select("case_id", "relationship_id", "source_document", "target_document").dropna().repartition("relationship_id").dropDuplicates(["case_id", "relationship_id"]), "chosen-relationships")
    ends = chosen.select("case_id", F.explode(F.array("source_document", "target_document")).alias("document_id"))
    inside = start.withColumn("start", F.lit(1)).unionByName(ends.withColumn("start", F.lit(0))).groupBy("case_id", "document_id").agg(F.max("start").alias("start"))
    inside = written(inside.select("case_id", "document_id", F.when(F.col("start") == 1, "selected").otherwise("endpoint").alias("role")), "authorities")

    # What becomes of evidence is the same in all cases, so it is told before evidence is spread over cases.
    rel_ev, rests, opened = _told(chosen, relation_evidence, intrinsic, owners, items)
    pair = ["case_id", "evidence_id"]
    spread = lambda held: inside.drop("role").join(held, "document_id")
    open_here = inside.join(opened, "document_id")
    required = lambda rests, rel_ev, here: _pairs(spread(rests.where("state = 'required'")), rel_ev.where("state = 'required'"), here.where("state = 'required'"))
    pairs = _pairs(spread(rests), rel_ev, open_here.where("evidence_id IS NOT NULL"))
    authorities = _with_owners(inside, required(rests, rel_ev, open_here))

    states = rel_ev.groupBy("case_id", "relationship_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("state") == "unowned", 1)).alias("gone"))
    state = F.when(F.coalesce("gone", F.lit(0)) == 0, "whole").when(F.col("gone") < F.col("n"), "reduced").otherwise("lost")
    kept = chosen.join(states, ["case_id", "relationship_id"], "left").select("case_id", "relationship_id", state.alias("state"))

    row = ["case_id", "document_id", "basis", "evidence_id", "state"]
    touching = rel_ev.select("case_id", F.explode(F.array_distinct(F.array("source_document", "target_document"))).alias("document_id"), F.lit("relationship").alias("basis"), "evidence_id", "state")
    doc_ev = lambda where: spread(rests.where(where)).select(*row).unionByName(touching.where(where).distinct())
    # An owner may bring what its case requires anyway: evidence that another document, a relationship or an item rests on.
    several = rests.groupBy("evidence_id").agg(F.min("document_id").alias("least"), F.max("document_id").alias("most")).where("least < most").select("evidence_id")
    brought = required(rests.join(several, "evidence_id", "left_semi"), rel_ev, open_here).select(*pair).distinct().join(rests.select("document_id", "basis", "evidence_id"), "evidence_id")
    owner_ev = brought.join(authorities.where("role = 'evidence_owner'"), ["case_id", "document_id"], "left_semi").select(*row[:-1])

    # Only owners of whom something is open, and only evidence that something open names, are asked for.
    heirs, named = opened.select(F.col("document_id").alias("owner")).distinct(), opened.where("state <> 'unowned'").select("evidence_id").distinct()
    of_heirs = lambda held: held.join(heirs, "owner", "left_semi")
    open_there = _with_owners(inside, required(of_heirs(rests), of_heirs(rel_ev), of_heirs(open_here))).where("role = 'evidence_owner'").join(opened.drop("owner"), "document_id")
    is_named = lambda held: held.join(named, "evidence_id", "left_semi")
    needed = _pairs(spread(is_named(rests)), is_named(rel_ev), open_here.where("state <> 'unowned'")).select(*pair).distinct().withColumn("kept", F.lit(1))
    may_keep = F.coalesce(F.col("state") != "unowned", F.lit(False))
    open_rows = open_here.drop("owner").withColumn("kept", F.when(may_keep, 1)).unionByName(open_there.where(may_keep).join(needed, pair, "left")).unionByName(open_there.where(~may_keep), allowMissingColumns=True)
    open_all = open_rows.select("case_id", F.concat(F.lit("unresolved:"), F.col("item_id").cast("string")).alias("item_ref"), "category", "document_id", F.when(F.col("kept") == 1, F.col("evidence_id")).alias("evidence_id"), (F.col("role") != "selected").alias("new"))
    ownerless = doc_ev("state = 'unowned'").select(*pair, "document_id").distinct()
    ownerless = ownerless.unionByName(open_here.where("state = 'unowned'").select(*pair).distinct().join(ownerless, pair, "left_anti"), allowMissingColumns=True)
    no_owner = ownerless.select("case_id", reference("unresolved", F.lit("canonical_evidence_owner"), F.concat(F.lit("evidence:"), F.col("evidence_id").cast("string"))).alias("item_ref"), F.lit("unresolved_identity").alias("category"), "document_id", F.lit(None).cast(opened.schema["evidence_id"].dataType).alias("evidence_id"), F.lit(True).alias("new"))
    graph = Graph({
        "authorities": authorities, "authority_evidence": doc_ev("state <> 'unowned'").select(*row[:-1]).unionByName(owner_ev),
        "relationships": kept, "relationship_evidence": rel_ev.where("state <> 'unowned'").select("case_id", "relationship_id", "evidence_id"), "evidence": pairs.distinct(), "unresolved": open_all.unionByName(no_owner),
    })
    graph.inside, graph.pairs = inside, pairs
    graph.opened = functools.reduce(DataFrame.unionByName, [x.select("case_id", "category", (F.col("role") != "selected").alias("new")) for x in (open_here, open_there)] + [no_owner.select("case_id", "category", "new")])
    return graph


class Graph(dict):
    """The closed graph's tables by name; beside them what a summary counts, before it is dealt out: documents inside, pairs of case and evidence, open items."""

    inside: DataFrame
    pairs: DataFrame
    opened: DataFrame


def _told(chosen: DataFrame, relation_evidence: DataFrame, intrinsic: DataFrame, owners: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence of chosen relationships, of documents and of items, each with the state and the owner of its evidence; null where an item has none."""
    rel_ev = chosen.join(relation_evidence.select("relationship_id", "evidence_id").dropna().repartition("relationship_id").distinct(), "relationship_id")
    rests = intrinsic.select("document_id", "basis", "evidence_id").dropna(subset=["document_id", "evidence_id"]).distinct()
    opened = items.select("item_id", "document_id", "category", "evidence_id").dropna(subset=["item_id", "document_id"]).distinct()
    owner = owners.groupBy("evidence_id").agg(F.max(F.struct(F.col("document_id").alias("owner"), "known")).alias("o"))
    parts = {"relationship": rel_ev, "document": rests, "item": opened}
    tagged = lambda name, where="evidence_id IS NOT NULL": parts[name].where(where).withColumn("part", F.lit(name))
    both = lambda x, y: x.unionByName(y, allowMissingColumns=True)
    state = F.when(F.col("o").isNull(), "evidence_missing").when(F.col("o.owner").isNull(), "unowned").when(~F.coalesce("o.known", F.lit(False)), "owner_missing").otherwise("required")
    met = functools.reduce(both, map(tagged, parts)).join(owner, "evidence_id", "left").withColumn("state", state).withColumn("owner", F.col("o.owner")).drop("o")
    told = written(both(met, tagged("item", "evidence_id IS NULL")), "told-evidence")
    return tuple(told.where(F.col("part") == name).select(*rows.columns, "state", "owner") for name, rows in parts.items())


def _pairs(*held: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [x.select("case_id", "evidence_id", "state", "owner") for x in held])


def _with_owners(inside: DataFrame, required: DataFrame) -> DataFrame:
    """(case_id, document_id, role): documents inside and owners of required evidence, which have a role only if they are inside already."""
    owners = required.select("case_id", F.col("owner").alias("document_id"), F.lit(None).cast("string").alias("role"))
    return inside.unionByName(owners).groupBy("case_id", "document_id").agg(F.coalesce(F.max("role"), F.lit("evidence_owner")).alias("role"))


def summary(graph: Graph, cases: DataFrame) -> DataFrame:
    """One row a case of ``cases`` (case_id, research_status): counts of the closed graph, ``sound`` and the bundle's ``status``.

    A graph is sound if no chosen relationship was lost and all evidence and
    owners are there.  A blocked or partial research stays so; a complete one
    is partial if closing brought an open item other than a synthesis.
    """
    # Documents and evidence of a case meet once, and are told apart and counted there.
    none = lambda kind: F.lit(None).cast(kind)
    types = {c: graph.pairs.schema["evidence_id" if c == "evidence_id" else "owner"].dataType for c in ("evidence_id", "document_id")}
    required = F.when(F.col("state") == "required", F.col("owner"))
    met = graph.pairs.select("case_id", "evidence_id", "state", required.alias("document_id"), none("string").alias("role")).unionByName(graph.inside.select("case_id", none(types["evidence_id"]).alias("evidence_id"), none("string").alias("state"), "document_id", "role")).repartition("case_id")
    each = F.array(F.struct("evidence_id", none(types["document_id"]).alias("document_id"), F.col("state").alias("what")), F.struct(none(types["evidence_id"]).alias("evidence_id"), "document_id", F.col("role").alias("what")))
    each = met.select("case_id", F.inline(each)).where("evidence_id IS NOT NULL OR document_id IS NOT NULL").groupBy("case_id", "evidence_id", "document_id").agg(F.coalesce(F.max("what"), F.lit("evidence_owner")).alias("what"))
    counted = lambda rows, names: rows.groupBy("case_id").agg(*[F.count(F.when(F.col("what") == n, 1)).alias(n) for n in names])
    others = graph["relationships"].select("case_id", F.col("state").alias("what")).unionByName(graph.opened.select("case_id", F.when(F.col("new") & (F.col("category") != SYNTHESIS), "opened").alias("what")))
    names = ["selected", "endpoint", "evidence_owner", "whole", "reduced", "lost", "required", "unowned", "evidence_missing", "owner_missing", "opened"]
    sums = [counted(each, [*names[:3], *names[6:10]]), counted(others, [*names[3:6], "opened"])]
    out = functools.reduce(lambda x, y: x.join(y, "case_id", "left"), sums, cases.select("case_id", "research_status")).fillna(0, names)
    status = F.when(F.col("research_status").isin("blocked", "partial"), F.col("research_status")).when(F.col("opened") > 0, "partial").otherwise("complete")
    return out.select("case_id", *names[:-1], (F.col("endpoint") + F.col("evidence_owner")).alias("support_only"), ((F.col("lost") + F.col("evidence_missing") + F.col("owner_missing")) == 0).alias("sound"), status.alias("status"))
