"""Spans and support on small rows, the closure against one written out case by case."""

import hashlib
import random

import pytest

from veritrail.operators import spans, support


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


SEG = "segment_id long, extraction_id long, sequence_no int, text string, text_sha256 string, manifestation_id long, manifestation_sha256 string, source_id long, source_url string, document_id long, char_start long, char_end long, retrieved_at string, extra string"
CAND = "candidate_id long, segment_id long, extraction_id long, sequence_no int, text_sha256 string, manifestation_id long, manifestation_sha256 string, source_id long, source_url string, document_id long, provision_id long"
OBS = "observation_id long, provision_id long, segment_id long, extraction_id long, document_id long, observed_text string, observed_sha256 string, normative_text string, normative_sha256 string, parser_name string, parser_version string"


def segment(i, text, document=9, start=0, **other):
    return {"segment_id": i, "extraction_id": 1, "sequence_no": i, "text": text, "text_sha256": sha(text), "manifestation_id": 5, "manifestation_sha256": "m", "source_id": 7, "source_url": "u", "document_id": document, "char_start": start, "char_end": start + len(text), "retrieved_at": "t", "extra": None} | other


def candidate(i, s, provision=None, **other):
    return {"candidate_id": i, "provision_id": provision} | {k: s[k] for k in ("segment_id", *spans.CLAIMS, "document_id")} | other


def observation(i, provision, s, text, **other):
    return {"observation_id": i, "provision_id": provision, "segment_id": s["segment_id"], "extraction_id": 1, "document_id": 9, "observed_text": s["text"], "observed_sha256": sha(s["text"]), "normative_text": text, "normative_sha256": sha(text), "parser_name": "p", "parser_version": "1"} | other


def frame(spark, rows, schema):
    names = [c.strip().split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_candidate_spans(spark):
    one, twice = segment(1, "𝒳 ñandú: el texto rige. Fin."), segment(2, "rige y rige", start=30)
    unknown, altered, long = segment(3, "sin dueño", None), segment(4, "texto", text_sha256=sha("otro")), segment(5, "a" * 300_000 + "b" + "a" * 300_000)
    rows = [
        (candidate(1, one, 11), "provision_span", None), (candidate(2, one), "segment_span", None), (candidate(3, twice, 12), "segment_span", None), (candidate(4, unknown), "identity_unresolved", None), (candidate(5, unknown, document_id=9), "identity_invented", None),
        (candidate(6, altered), "segment_fingerprint_mismatch", None), (candidate(7, long, 13), "provision_span", None), (candidate(8, one, segment_id=None), "segment_missing", None), (candidate(9, one, segment_id=77), "segment_missing", None), (candidate(10, one, source_url=None), "claim_mismatch", "source_url"),
        (candidate(11, one, sequence_no=4, source_id=1), "claim_mismatch", "sequence_no"), (candidate(12, one, document_id=None), "identity_mismatch", None), (candidate(13, one, 99), "not_one_observation", None), (candidate(14, one, 14), "not_one_observation", None), (candidate(15, one, 15), "observation_of_other_document", None),
        (candidate(16, one, 16), "observation_of_other_extraction", None), (candidate(17, one, 17), "observed_fingerprint_mismatch", None), (candidate(18, one, 18), "normative_fingerprint_mismatch", None), (candidate(19, one, 19), "segment_span", None), (candidate(1, one, 11), "provision_span", None),
    ]
    seen = [observation(1, 11, one, "el texto rige"), observation(2, 12, twice, "rige"), observation(3, 13, long, "b"), observation(4, 14, one, "rige"), observation(5, 14, one, "rige"), observation(6, 15, one, "rige", document_id=None), observation(7, 16, one, "rige", extraction_id=2)]
    seen += [observation(8, 17, one, "rige", observed_sha256="x"), observation(9, 18, one, "rige", normative_sha256=None), observation(10, 19, one, "")]
    segs = frame(spark, [one, twice, unknown, altered, long], SEG)
    out = spans.candidate_spans(frame(spark, [r for r, _, _ in rows], CAND), segs, frame(spark, seen, OBS)).collect()
    got = sorted((r.candidate_id, r.state, r.field) for r in out)
    assert got == sorted((r["candidate_id"], s, f) for r, s, f in rows)
    by = {r.candidate_id: r for r in out}
    assert (by[1].char_start, by[1].char_end, by[1].exact_text, by[1].provision_id) == (9, 22, "el texto rige", 11)
    assert (by[3].char_start, by[3].char_end, by[3].exact_text, by[3].provision_id) == (30, 41, "rige y rige", None)
    assert (by[7].char_start, by[7].char_end) == (300_000, 300_001)
    assert by[1].evidence_ref == "evidence:" + sha('["research",5,1,"provision:11","%s","canonical-legal-span-v1"]' % sha("el texto rige"))[:32]
    assert by[2].evidence_ref == "evidence:" + sha('["research",5,1,null,"%s","canonical-legal-span-v1"]' % one["text_sha256"])[:32]
    assert all((r.exact_text is None) == (not r.state.endswith("_span")) == (r.span_ref is None) for r in out)
    whole = spark.createDataFrame([(1, "𝒳 ñandú: el texto rige. Fin." + "\n\nrige y rige")], "extraction_id long, text string")
    assert {r.candidate_id: r.proof for r in spans.proofs(spans.candidate_spans(frame(spark, [rows[0][0], rows[2][0], rows[6][0]], CAND), segs, frame(spark, seen, OBS)), whole).collect()} == {1: "proved", 3: "proved", 7: "other_text"}
    assert spans.candidate_spans(frame(spark, [], CAND), segs, frame(spark, [], OBS)).count() == 0


def test_canonical_spans(spark):
    row = lambda i, segment=1, quote="el texto", manifestation=5, url="u", source="m": (1, i, manifestation, None, segment, None, 0, 8, quote, url, source, "t")
    evidence = spark.createDataFrame([row(1), row(2, None), row(3, quote=""), row(4, quote=None), row(5, quote="no"), row(6, 2), row(7, 99), row(8, manifestation=6), row(9, manifestation=8), row(10, manifestation=404), row(11, url=None), row(12, source="x"), row(13, 3), row(14, None, manifestation=None)], "case_id long, evidence_id long, manifestation_id long, page_segment_id long, segment_id long, page_number int, char_start long, char_end long, exact_quote string, source_url string, source_sha256 string, retrieved_at string")
    places = spark.createDataFrame([(5, 9, 7, "m", "u"), (6, None, 7, "m", "u"), (8, 10, 7, "m", "u")], "manifestation_id long, document_id long, source_id long, sha256 string, source_url string")
    segments = spark.createDataFrame([(1, 5, "el texto", sha("el texto")), (2, 8, "el texto", sha("el texto")), (3, 5, "el texto rige", sha("el texto rige"))], "segment_id long, manifestation_id long, text string, text_sha256 string")
    observed = spark.createDataFrame([(1, 20, 9), (1, 20, 9), (1, 21, 10), (3, 20, 9), (3, 22, 9)], "segment_id long, provision_id long, document_id long")
    authorities = spark.createDataFrame([(1, 9), (1, 9), (2, 10)], "case_id long, document_id long")
    out = {r.evidence_id: r for r in spans.canonical_spans(evidence, places, segments, observed, authorities, ("case_id",)).collect()}
    want = ["evidence_span", "evidence_span", "quote_empty", "quote_empty", "quote_absent", "segment_invalid", "segment_invalid", "owner_unresolved", "owner_not_in_graph", "evidence_missing", "source_url_mismatch", "source_fingerprint_mismatch", "evidence_span", "evidence_missing"]
    assert [out[i].state for i in sorted(out)] == want
    assert (out[1].provision_id, out[2].provision_id, out[13].provision_id) == (20, None, None)
    assert out[1].span_ref == "span:" + sha('["canonical_evidence","1",1,"canonical-legal-span-v1",5,1,null,null,0,8,"%s"]' % sha("el texto"))[:32]


def closed(start, rels, backed, basis, owners, items):
    """The closure of one case, step by step."""
    ends = {d for _, a, b in rels for d in (a, b)}
    role = {d: "selected" if d in start else "endpoint" for d in start | ends}
    of_rel = {r: {e for x, e in backed if x == r} for r, _, _ in rels}
    doc_ev = {(d, k, e) for d, k, e in basis if d in role} | {(d, "relationship", e) for r, a, b in rels for d in (a, b) for e in of_rel[r]}
    opened = {(i, d, c, e) for i, d, c, e in items if d in role}
    need = {e for _, _, e in doc_ev} | {e for *_, e in opened if e is not None}
    state = {e: "evidence_missing" if e not in owners else "unowned" if owners[e][0] is None else "required" if owners[e][1] else "owner_missing" for e in need}
    gone = {e for e in need if state[e] == "unowned"}
    rel_state = {r: "whole" if not of_rel[r] & gone else "lost" if of_rel[r] <= gone else "reduced" for r, _, _ in rels}
    added = {owners[e][0] for e in need if state[e] == "required"} - set(role)
    ok = {e for e in need if state[e] == "required"}
    unresolved = {(f"unresolved:{i}", c, d, None if e in gone else e, role[d] != "selected") for i, d, c, e in opened} | {(f"unresolved:{i}", c, d, e if e in need - gone else None, True) for i, d, c, e in items if d in added}
    for e in gone:
        ref = "unresolved:" + sha(f'["canonical_evidence_owner","evidence:{e}"]')[:32]
        unresolved |= {(ref, "unresolved_identity", d, None, True) for d in {d for d, _, x in doc_ev if x == e} or {None}}
    return {
        "authorities": set(role.items()) | {(d, "evidence_owner") for d in added}, "authority_evidence": {x for x in doc_ev if x[2] not in gone} | {(d, k, e) for d, k, e in basis if d in added and e in ok},
        "relationships": set(rel_state.items()), "relationship_evidence": {(r, e) for r in of_rel for e in of_rel[r] - gone}, "evidence": {(e, state[e], owners.get(e, (None,))[0]) for e in need}, "unresolved": unresolved,
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_support_is_closed_once(spark, seed):
    rng = random.Random(seed)
    any_of = lambda n: rng.randrange(n)
    start = {(c, any_of(9)) for c in range(4) for _ in range(any_of(3))}
    rels = {(c, c * 10 + r): (any_of(9), any_of(9)) for c in range(4) for r in range(any_of(4))}
    backed = {(r, any_of(30)) for _, r in rels for _ in range(any_of(3))}
    basis = {(any_of(14), rng.choice(["identity", "temporal"]), any_of(30)) for _ in range(12)}
    owners = {e: (rng.choice([None, *range(14)]), rng.random() < 0.9) for e in range(28)}
    items = {(i, any_of(14), rng.choice(["a", support.SYNTHESIS]), rng.choice([None, *range(30)])) for i in range(8)}
    rows = lambda xs: sorted(xs, key=str) * 2
    make = lambda xs, schema: spark.createDataFrame(xs, schema)
    graph = support.close(
        make([*rows(start), (None, 1), (1, None)], "case_id long, document_id long"), make([*rows((c, r, a, b) for (c, r), (a, b) in rels.items()), (1, 99, None, 2)], "case_id long, relationship_id long, source_document long, target_document long"),
        make([*rows(backed), (None, 1)], "relationship_id long, evidence_id long"), make([*rows(basis), (3, "identity", None)], "document_id long, basis string, evidence_id long"), make([(e, d, k) for e, (d, k) in owners.items()], "evidence_id long, document_id long, known boolean"), make(rows(items), "item_id long, document_id long, category string, evidence_id long"),
    )
    got = {name: [tuple(r) for r in df.collect()] for name, df in graph.items()}
    want = {c: closed({d for x, d in start if x == c}, [(r, a, b) for (x, r), (a, b) in rels.items() if x == c], backed, basis, owners, items) for c in range(4)}
    for name, found in got.items():
        assert sorted(found, key=str) == sorted(((c, *x) for c in range(4) for x in want[c][name]), key=str), name
    cases = make([(c, "complete") for c in range(4)] + [(9, "complete"), (8, "blocked")], "case_id long, research_status string")
    for r in support.summary(graph, cases).collect():
        mine = want.get(r.case_id)
        if mine is None:
            assert (r.selected, r.required, r.sound, r.status) == (0, 0, True, "blocked" if r.case_id == 8 else "complete")
            continue
        count = lambda name, at, value: sum(x[at] == value for x in mine[name])
        assert (r.selected, r.endpoint, r.evidence_owner, r.lost, r.required, r.unowned) == (*(count("authorities", 1, x) for x in ("selected", "endpoint", "evidence_owner")), count("relationships", 1, "lost"), count("evidence", 1, "required"), count("evidence", 1, "unowned"))
        assert r.status == ("partial" if any(x[4] and x[1] != support.SYNTHESIS for x in mine["unresolved"]) else "complete")


def test_support_reads_lines_once(spark):
    """Lines are written for the graph: the tables that read relations and evidence do not group them again."""
    from veritrail.plans import catalog

    plan = catalog.QUERIES["support_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan


def test_what_becomes_of_evidence_is_told_before_it_is_spread(spark):
    """No pair of case and evidence is dealt out to learn its state, and none for relationships and their evidence."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    # Item 1 names evidence that owner 7 brings and relationship 5 requires; document 7 rests on it too.
    graph = support.close(
        make([(1, 2)], "case_id long, document_id long"), make([(1, 5, 2, 3)], "case_id long, relationship_id long, source_document long, target_document long"), make([(5, 50), (5, 51)], "relationship_id long, evidence_id long"), make([(7, "identity", 50), (3, "identity", 52), (7, "identity", 53)], "document_id long, basis string, evidence_id long"),
        make([(50, 7, True), (51, None, True), (53, 8, True)], "evidence_id long, document_id long, known boolean"), make([(1, 7, "a", 50), (2, 7, "a", 53), (3, 2, "a", 51)], "item_id long, document_id long, category string, evidence_id long"),
    )
    got = {name: sorted((tuple(r) for r in df.collect()), key=str) for name, df in graph.items()}
    assert got["authority_evidence"] == [(1, 2, "relationship", 50), (1, 3, "identity", 52), (1, 3, "relationship", 50), (1, 7, "identity", 50)]
    assert got["evidence"] == [(1, 50, "required", 7), (1, 51, "unowned", None), (1, 52, "evidence_missing", None)] and got["relationships"] == [(1, 5, "reduced")]
    assert {r[1:5] for r in got["unresolved"] if r[2] == "a"} == {("unresolved:1", "a", 7, 50), ("unresolved:2", "a", 7, None), ("unresolved:3", "a", 2, None)}
    plan = lambda name: graph[name]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("relationship_evidence") and not any("evidence_id" in x for x in plan("authorities").splitlines() if "Join" in x)


def test_candidates_meet_segments_and_observations_once(spark):
    """All rows meet by segment in one exchange; hashes that are none, or written in capitals, are compared and given back as they are."""
    one, odd = segment(1, "el texto rige", manifestation_sha256="AB"), segment(2, "otro", manifestation_sha256="x")
    rows = [candidate(1, one, 11), candidate(2, one, manifestation_sha256="ab"), candidate(3, odd), candidate(4, odd, text_sha256=sha("otro").upper()), candidate(5, one, text_sha256=None)]
    out = spans.candidate_spans(frame(spark, rows, CAND), frame(spark, [one, odd], SEG), frame(spark, [observation(1, 11, one, "texto"), observation(2, None, one, "rige"), observation(3, 11, odd, "otro")], OBS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {r.candidate_id: (r.state, r.field, r.source_sha256, r.exact_sha256) for r in out.collect()}
    assert got == {1: ("provision_span", None, "AB", sha("texto")), 2: ("claim_mismatch", "manifestation_sha256", None, None), 3: ("segment_span", None, "x", sha("otro")), 4: ("claim_mismatch", "text_sha256", None, None), 5: ("claim_mismatch", "text_sha256", None, None)}
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
