"""Provisions in three dialects, and citable context against a walk that goes step by step."""

import hashlib
import random
import uuid

import pytest

from veritrail.operators import context, provisions


@pytest.mark.parametrize(
    ("dialect", "text", "want"),
    [
        ("compiled", "ARTÍCULO 1.2.3. OBJETO. Esta parte rige.", ("1.2.3", "OBJETO", "Esta parte rige.", None)),
        ("compiled", "Artículo 1.2.3.10 Sin título aquí", ("1.2.3.10", None, "Sin título aquí", None)),
        ("compiled", "ARTÍCULO 5. OBJETO. No.", None),
        ("compiled", "ARTÍCULO 1.2.3. <Artículo modificado por el Decreto 5 de 1990>  TÍTULO (A/B). Nuevo  texto <Inciso x>.", ("1.2.3", "TÍTULO (A/B)", "Nuevo texto <Inciso x>.", "Artículo modificado por el Decreto 5 de 1990")),
        ("simple", "ARTÍCULO 05o. VIGENCIA. Rige desde hoy.", ("5", "VIGENCIA", "Rige desde hoy.", None)),
        ("simple", "ARTÍCULO 7º . El texto <Numeral 3 derogado> sigue.", ("7", None, "El texto sigue.", "Numeral 3 derogado")),
        ("simple", "ARTÍCULO 7 sin punto", None),
        ("simple", "ARTÍCULO 12-1. OTRO. x", None),
        ("statute", "ARTÍCULO 12-1. SUJETOS PASIVOS.", ("12-1", "SUJETOS PASIVOS", "", None)),
        ("statute", "ARTÍCULO 254a. TARIFA. Del diez.", ("254A", "TARIFA", "Del diez.", None)),
        ("statute", f"ARTÍCULO 1. {'A' * 221}. Cuerpo.", ("1", None, f"{'A' * 221}. Cuerpo.", None)),
        ("statute", None, None),
    ],
)
def test_articles(spark, dialect, text, want):
    got = provisions.parsed(spark.createDataFrame([(text, dialect)], "text string, dialect string")).collect()
    assert [(r.designation, r.title, r.body, r.note) for r in got] == ([want] if want else [])


SEGMENTS = "segment_id long, extraction_id long, document_id long, sequence_no int, segment_type string, text string, dialect string"


def test_registration_is_idempotent(spark):
    rows = [(1, 1, 9, 1, "article", "ARTÍCULO 1. UNO. a", "simple"), (2, 2, 9, 1, "article", "ARTÍCULO 01. DOS. b", "simple"), (3, 1, 9, 2, "regulatory_article", "ARTÍCULO 1.1.1. A. a", "compiled"), (4, 2, 9, 2, "regulatory_article", "ARTÍCULO 1.1.1. B. b", "compiled"), (5, 1, None, 3, "article", "ARTÍCULO 2. X. y", "simple"), (6, 1, 9, 4, "text", "ARTÍCULO 3. X. y", "simple"), (7, 1, 9, 5, "article", None, "simple")]
    segs = spark.createDataFrame(rows, SEGMENTS)
    seen = provisions.observe(segs)
    assert {r.segment_id for r in seen.collect()} == {1, 2, 3, 4}
    found = {r.designation: (r.title, r.observations) for r in provisions.provisions_of(seen).collect()}
    assert found == {"1": ("UNO", 2), "1.1.1": ("B", 2)}  # simple acts keep the first title, compiled decrees the last
    want = "PROV-" + uuid.uuid5(uuid.NAMESPACE_URL, "9:ARTICLE:1").hex
    assert want in {r.provision_id for r in seen.collect()}
    none = provisions.provisions_of(seen).drop("observations").where("false"), seen.where("false")
    once = provisions.register(*none, segs)
    twice = provisions.register(*once, segs)
    for a, b in zip(once, twice):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert once[0].count() == 2 and once[1].count() == 4


def step_by_step(anchor, asked, segs, refs, most):
    """The walk as a person would do it, on dictionaries."""
    by_id = {s["segment_id"]: s for s in segs}
    me = by_id.get(anchor)
    fail = "anchor_missing" if me is None else "anchor_document_unresolved" if me["document_id"] is None else "anchor_provision_not_citable" if me["provision_id"] is None else "anchor_provision_mismatch" if asked is not None and asked != me["provision_id"] else None
    if fail:
        return "incomplete", [], {(fail, anchor, None)}
    keys, gaps, out = [], set(), False
    sources = [anchor]

    def add(key):
        nonlocal out
        if key[0] != anchor and key not in keys:
            keys.append(key)
            out = len(keys) > most
        return not out

    for direction in (1, -1):
        at = me["sequence_no"] + direction
        while not out:
            there = [s for s in segs if s["extraction_id"] == me["extraction_id"] and s["sequence_no"] == at]
            if not there:
                break
            if len(there) > 1:
                gaps.add(("ambiguous_contiguous_sequence", anchor, None))
                break
            s = there[0]
            if s["document_id"] != me["document_id"]:
                gaps.add(("document_boundary_mismatch", s["segment_id"], None))
                break
            if s["provision_id"] is None:
                gaps.add(("unverified_contiguous_boundary", s["segment_id"], None))
                break
            if s["provision_id"] != me["provision_id"]:
                break
            sources.append(s["segment_id"])
            if not add((s["segment_id"], s["provision_id"])):
                break
            at += direction
    for source in sources:
        for r in sorted((r for r in refs if r["segment_id"] == source), key=lambda r: r["mention_id"]):
            if out:
                break
            if r["state"] != "resolved":
                gaps.add(("reference_resolution_incomplete", source, r["mention_id"]))
                continue
            if r["target_document_id"] is None or r["target_provision_id"] is None:
                gaps.add(("reference_without_provision_target", source, r["mention_id"]))
                continue
            hits, texts = [], set()
            for s in sorted(segs, key=lambda s: (s["extraction_id"], s["sequence_no"], s["segment_id"])):
                if (s["document_id"], s["provision_id"]) == (r["target_document_id"], r["target_provision_id"]) and (s["extraction_id"], s["text_sha256"]) not in texts:
                    texts.add((s["extraction_id"], s["text_sha256"]))
                    hits.append((s["segment_id"], s["provision_id"]))
            if not hits:
                gaps.add(("reference_target_context_unavailable", source, r["mention_id"]))
            for h in hits[: most + 1]:
                if not add(h):
                    break
    if out:
        gaps.add(("budget_exhausted", anchor, None))
    if not keys and not gaps:
        gaps.add(("no_verified_context", anchor, None))
    return "incomplete" if gaps else "expanded_verified", keys[:most], gaps


@pytest.mark.parametrize("most", [0, 2, 4])
def test_context_against_a_walk(spark, most):
    rng = random.Random(most)
    segs = []
    for extraction in range(40):
        at = 0
        for _ in range(rng.randrange(1, 12)):
            at += rng.choice([1, 1, 1, 1, 1, 2])
            for _ in range(1 if rng.random() < 0.95 else 2):
                segs.append({"segment_id": len(segs) + 1, "extraction_id": extraction, "sequence_no": at, "document_id": rng.choice([1, 1, 1, 1, 1, 1, None]) and extraction % 5 + (rng.random() < 0.04), "provision_id": rng.choice(["a", "a", "a", "a", "b", None]), "text_sha256": f"t{rng.randrange(40)}"})
    refs = [{"segment_id": s["segment_id"], "mention_id": 10 * s["segment_id"] + k, "state": rng.choice(["resolved", "resolved", "ambiguous"]), "target_document_id": rng.choice([0, 1, 2, 9, None]), "target_provision_id": rng.choice(["a", "b", None])} for s in segs for k in range(rng.choice([0, 0, 1, 2]))]
    lone = {(s["extraction_id"], s["sequence_no"]) for s in segs if sum(t["extraction_id"] == s["extraction_id"] and t["sequence_no"] == s["sequence_no"] for t in segs) > 1}
    anchors = [(s["segment_id"], rng.choice([None, None, "a", "b"])) for s in segs if (s["extraction_id"], s["sequence_no"]) not in lone] + [(-1, None)]
    frame = spark.createDataFrame([tuple(s[k] for k in ("segment_id", "extraction_id", "sequence_no", "document_id", "provision_id", "text_sha256")) for s in segs], "segment_id long, extraction_id long, sequence_no int, document_id long, provision_id string, text_sha256 string")
    references = spark.createDataFrame([tuple(r.values()) for r in refs], "segment_id long, mention_id long, state string, target_document_id long, target_provision_id string")
    got = {r.anchor_id: (r.status, [(h.segment_id, h.provision_id) for h in r.hits], {tuple(g) for g in r.gaps}) for r in context.context(spark.createDataFrame(anchors, "anchor_id long, asked_provision string"), frame, references, most).collect()}
    want = {a: step_by_step(a, p, segs, refs, most) for a, p in anchors}
    assert {k: v for k, v in got.items() if v != want[k]} == {} and got.keys() == want.keys()
    assert len({g[0] for v in want.values() for g in v[2]}) >= (9 if most else 6)


def test_citable_states(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    segs = spark.createDataFrame([(1, "uno dos", sha("uno dos")), (2, "dos dos", sha("dos dos")), (3, "tres", "x"), (4, "cuatro", sha("cuatro")), (5, "cinco", sha("cinco"))], "segment_id long, text string, text_sha256 string")
    seen = spark.createDataFrame([(1, "p", "dos", sha("dos")), (2, "p", "dos", sha("dos")), (3, "p", "tres", sha("tres")), (4, "p", "cuatro", sha("cuatro")), (4, "q", "cuatro", sha("cuatro"))], "segment_id long, provision_id string, normative_text string, normative_sha256 string")
    got = {r.segment_id: (r.citable_state, r.provision_id) for r in context.citable(segs, seen).collect()}
    assert got == {1: ("citable", "p"), 2: ("no_single_anchor", None), 3: ("fingerprint_mismatch", None), 4: ("several_observations", None), 5: ("no_observation", None)}


def test_context_numbers_events_once(spark):
    """Hits and gaps read one written stream: no window is left in the result's plan."""
    segs = spark.createDataFrame([(1, 1, 1, 1, "a", "x"), (2, 1, 2, 1, "a", "y"), (3, 1, 3, 1, "b", "z")], "segment_id long, extraction_id long, sequence_no int, document_id long, provision_id string, text_sha256 string")
    none = spark.createDataFrame([], "segment_id long, mention_id long, state string, target_document_id long, target_provision_id string")
    out = context.context(spark.createDataFrame([(1, None), (3, None)], "anchor_id long, asked_provision string"), segs, none, 2)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.anchor_id: [h.segment_id for h in r.hits] for r in out.collect()} == {1: [2], 3: []}
