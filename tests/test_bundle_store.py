"""Bundles in, bundles out: round trips, reuse, refusal, and every fault found by its name."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veritrail.sources import bundle_store
from veritrail.sources.bundle_store import BundleStore

PARTS = "bundle_ref string, kind string, ordinal int, payload string"


def canonical(x):
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def bundle(ref, spans=3):
    one = [("case_input", {"question": f"¿{ref}?"}), ("intake_draft", {"intake_ref": f"intake:{ref}"}), ("research_plan", {"plan_ref": f"plan:{ref}"}), ("research_result", {"result_ref": f"result:{ref}"})]
    many = [("evidence_span", {"evidence_ref": f"evidence:{k}", "quote": "tal cual"}) for k in range(spans)]
    return [(ref, kind, 0, canonical(p)) for kind, p in one] + [(ref, kind, k, canonical(p)) for k, (kind, p) in enumerate(many)]


def test_round_trip_reuse_and_refusal(spark, tmp_path):
    store = BundleStore(spark, f"{tmp_path}/store")
    first = spark.createDataFrame(bundle("a") + bundle("b", 2), PARTS)
    assert {r.action for r in store.persist(first, dry_run=True).collect()} == {"insert"} and store.writes == 0
    store.persist(first)
    assert store.objects().count() == 8 + 3  # shared spans are stored once
    out = {r.bundle_ref: r.parts for r in store.load().collect()}
    assert {k: len(v) for k, v in out["a"].items()} == {"case_input": 1, "intake_draft": 1, "research_plan": 1, "research_result": 1, "evidence_span": 3}
    assert out["b"] == {kind: [x[3] for x in bundle("b", 2) if x[1] == kind] for kind in {x[1] for x in bundle("b", 2)}}
    assert {r.bundle_ref: r.action for r in store.persist(spark.createDataFrame(bundle("a") + bundle("c"), PARTS)).collect()} == {"a": "reuse", "c": "insert"}
    with pytest.raises(ValueError, match="another content"):
        store.persist(spark.createDataFrame(bundle("a", 2), PARTS))
    assert {r.bundle_ref: r.state for r in store.verified().collect()} == dict.fromkeys("abc", "verified")


@pytest.mark.parametrize(
    ("table", "change", "state"),
    [
        ("recipes", {"kind": "if(kind = 'evidence_span', 'rumour', kind)"}, "unknown_kind"),
        ("recipes", {"role": "if(kind = 'intake_draft', 'canonical_legal_support', role)"}, "ownership_mismatch"),
        ("objects", None, "payload_missing"),
        ("objects", {"payload": "replace(payload, 'tal cual', 'otro')"}, "payload_hash_mismatch"),
        ("recipes", {"artifact_ref": "replace(artifact_ref, 'evidence:1', 'evidence:9')"}, "artifact_ref_mismatch"),
        ("recipes", {"ordinal": "if(ordinal = 2, 5, ordinal)"}, "ordinals_not_contiguous"),
        ("bundles", {"bundle_sha256": "'x'"}, "bundle_hash_mismatch"),
    ],
)
def test_faults(spark, table, change, state):
    recipes, objects = bundle_store.shred(spark.createDataFrame(bundle("a"), PARTS))
    tables = {"bundles": bundle_store.digests(recipes), "recipes": recipes, "objects": objects}
    tables[table] = tables[table].withColumns({k: F.expr(v) for k, v in change.items()}) if change else tables[table].where("payload NOT LIKE '%plan%'")
    assert [r.state for r in bundle_store.verify(tables["bundles"], tables["recipes"], tables["objects"]).collect()] == [state]


def test_missing_and_double_singles(spark):
    for rows in (bundle("a")[1:], bundle("a") + [("a", "case_input", 1, "{}")]):
        recipes, objects = bundle_store.shred(spark.createDataFrame(rows, PARTS))
        assert [r.state for r in bundle_store.verify(bundle_store.digests(recipes), recipes, objects).collect()] == ["single_part_count"]


def test_digest_by_hand(spark):
    recipes, _ = bundle_store.shred(spark.createDataFrame(bundle("a"), PARTS))
    lines = sorted(f"{k}:{o:09d}:{hashlib.sha256(p.encode()).hexdigest()}" for _, k, o, p in bundle("a"))
    assert bundle_store.digests(recipes).first().bundle_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_texts_stay_behind_when_bundles_are_verified(spark):
    recipes, objects = bundle_store.shred(spark.createDataFrame(bundle("a"), PARTS))
    lines = bundle_store.verify(bundle_store.digests(recipes), recipes, objects)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    met = next(i for i, x in enumerate(lines) if "Join LeftOuter, (payload_sha256" in x)
    assert all(i > met for i, x in enumerate(lines) if "get_json_object" in x) and any("get_json_object" in x for x in lines[met:])


def test_escaped_field_names_are_read(spark):
    rows = bundle("a", 1)[:-1] + [("a", "evidence_span", 0, '{"evidence\\u005fref":"evidence:0"}')]
    recipes, objects = bundle_store.shred(spark.createDataFrame(rows, PARTS))
    assert [r.state for r in bundle_store.verify(bundle_store.digests(recipes), recipes, objects).collect()] == ["verified"]


def test_lines_of_a_store_are_not_dealt_again_by_bundle(spark, tmp_path):
    store = BundleStore(spark, f"{tmp_path}/store")
    store.persist(spark.createDataFrame(bundle("a") + bundle("b", 2), PARTS))
    plan = store.verified()._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [plan[i + 1] for i, x in enumerate(plan) if "Exchange hashpartitioning(bundle_ref" in x]
    assert [("partial_min" in x, "collect_list" in x) for x in dealt] == [(True, False)]  # only faults travel by bundle


def test_odd_names_meet_their_objects(spark):
    """A payload may name itself by another kind's field, or not at all; that is no fault where its line says the same."""
    rows = [("a", "case_input", 0, '{"plan_ref":"p"}'), *bundle("a", 0)[1:], ("a", "evidence_span", 0, '{"quote":"tal cual"}')]
    recipes, objects = bundle_store.shred(spark.createDataFrame(rows, PARTS))
    state = lambda r: [x.state for x in bundle_store.verify(bundle_store.digests(recipes), r, objects).collect()]
    assert state(recipes) == ["verified"]
    assert state(recipes.withColumn("artifact_ref", F.coalesce("artifact_ref", F.lit("evidence:0")))) == ["artifact_ref_mismatch"]
