"""Registry, coverage, retrieval and bundle rules on small scenario rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from veritrail.functions import forms
from veritrail.operators import blocks, bundle, coverage, doctor, merge, registry, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_forms(spark):
    assert one(spark, forms.fold(F.lit("Straße ÁÉÍ ñandú ﬁn 1º é"))) == "strasse aei nandu fin 1o e"
    assert one(spark, forms.key_form(F.lit(" Artículo  1 "))) == "ARTICULO 1"
    assert [float(x) for x in one(spark, forms.amounts(F.lit("1.400 UVT, 1.400,5 UVT; 3,5 UVT y 12 UVT")))] == [1400.0, 1400.5, 3.5, 12.0]
    assert one(spark, forms.heading(F.lit("Decreto Número 0624 de 1989"))).number == 624 and one(spark, forms.heading(F.lit("Texto"))) is None
    assert tuple(one(spark, forms.primary_key(F.lit("CO:DIAN:RESOLUCION:42:2020")))) == ("DIAN", "RESOLUCION", "42", 2020) and one(spark, forms.primary_key(F.lit("CO:X"))) is None
    got = one(spark, forms.article(F.lit("ARTÍCULO 5-1. OBJETO. Esta ley rige.")))
    assert (got.designation, got.title, got.body) == ("5-1", "OBJETO", "Esta ley rige.")
    assert one(spark, forms.iso_date(F.lit("2024-02-30"))).error and one(spark, forms.iso_date(F.lit("2024-02-29"))).day == date(2024, 2, 29)
    assert one(spark, forms.term_variants(F.lit("tardia")))[0] == "tardia" and "extemporaneidad" in one(spark, forms.term_variants(F.lit("tardia")))
    assert one(spark, forms.term_variants(F.lit("70"))) == ["70"]


def test_nulls_pass_through_forms(spark):
    null = F.lit(None).cast("string")
    for f in (forms.strip_accents, forms.fold, forms.collapse, forms.key_form, forms.document_type, forms.heading, forms.primary_key, forms.article, forms.grouped_integer, forms.operator_code, forms.source_kind, forms.token_estimate):
        assert one(spark, f(null)) in (None, "web_page"), f.__name__


SEGMENTS = "segment_id int, extraction_id int, sequence_no int, segment_type string, text string, section_path string"


def test_date_trust(spark):
    rows = [
        (1, 1, 1, "document_heading", "Diario Oficial No. 50.928 de 22 de abril de 2019", None), (2, 1, 2, "article", "ARTÍCULO 1. La presente disposición rige a partir de la fecha de su publicación en el Diario Oficial.", "ARTÍCULO 1"),
        (3, 1, 3, "closing", "PUBLÍQUESE Y CÚMPLASE. Dado en Bogotá, 2 de mayo de 2001", None), (4, 1, 9, "text", "Dado en Cali, a 5 de mayo de 1990", "NOTAS DE VIGENCIA"), (5, 2, 1, "text", "Diario Oficial No. 47.000 de 30 de febrero de 2010. Ley 5 de 1990", None),
        (6, 3, 1, "article", "Rige a partir del 1 de enero de 2030", None), (7, 3, 2, "paragraph", "rige a partir de la fecha de su publicación", "ARTÍCULO 9. VIGENCIA"), (8, 3, 3, "text", "DECRETO 99 DE 2010. Dada en Cali, 3 de marzo de 2011", None), (9, 3, 40, "text", "Diario Oficial No 1 de 3 de setiembre de 1999", None),
        (10, 4, 1, "closing", "Dada en Tunja, 1 de enero de 2001. Dado en Cali, 2 de enero de 2002", None), (11, 4, 2, "text", None, None),
    ]
    got = sorted((r.segment_id, r.role, r.value, r.is_trusted, r.context) for r in registry.date_candidates(spark.createDataFrame(rows, SEGMENTS)).collect())
    assert got == [
        (1, "publication", date(2019, 4, 22), True, "publication_metadata"), (2, "commencement", None, True, "commencement_clause"), (3, "issued", date(2001, 5, 2), True, "primary_document_date"), (4, "issued", date(1990, 5, 5), False, "editorial_history"),
        (5, "publication", None, False, "quoted_cited_norm"), (7, "commencement", None, True, "commencement_clause"), (8, "issued", date(2011, 3, 3), False, "quoted_cited_norm"), (9, "publication", date(1999, 9, 3), False, "unknown"),
        (10, "issued", date(2001, 1, 1), True, "primary_document_date"), (10, "issued", date(2002, 1, 2), True, "primary_document_date"),
    ]


def test_relation_families(spark):
    known = {"modified_by": "amendment", "Repealed By": "repeal", "supersedes": "supersession", "replaces": "amendment", "amends": "amendment", "contradicts": "conflict", "excepted-by": "exception", "definition for": "definition", "expires": "temporal"}
    for name, family in known.items():
        assert one(spark, forms.relation_family(F.lit(name))) == family
    assert all(one(spark, forms.relation_family(F.lit(x).cast("string"))) is None for x in ("adds", "substitutes", "annuls", "cites", "", None))
    assert sum(len(v) for v in forms.FAMILY_TYPES.values()) == 39


def test_bodies_keep_what_is_no_portal_note(spark):
    act = [(1, 0, "DECRETO 3 DE 2001"), (1, 1, "uno"), (1, 2, "<Consultar la vigencia de esta norma directamente en los artículos que modifica y/o adiciona>"), (1, 3, "Consultar la vigencia de esta norma en la página")]
    court = [(2, 0, "DECRETO 3 DE 2001"), (2, 1, "SENTENCIA C-123/05"), (2, 2, "I. ANTECEDENTES " + "x" * 500), (2, 3, "R E S U E L V E"), (3, 0, "SENTENCIA C-9/05"), (3, 1, "I. ANTECEDENTES " + "x" * 500)]
    frame = spark.createDataFrame([(*r, None if r[0] == 1 else blocks.COURT_FAMILY) for r in act + court], "doc int, seq int, text string, family string")
    got = {r.doc: (r.state, r.first, r.blocks) for r in blocks.legal_body(frame, 3, "family").collect()}
    assert got == {1: ("body", 0, 3), 2: ("body", 1, 3), 3: ("too_short", 0, 2)}


def test_promotion_needs_publication_and_commencement(spark):
    rows = [(1, "publication", "resolved", date(2001, 1, 1)), (1, "commencement", "resolved", None), (2, "publication", "resolved", date(2002, 1, 1)), (2, "commencement", "ambiguous", None), (3, "issued", "unresolved", date(2003, 1, 1))]
    got = {(r.document, r.event_type) for r in registry.promoted_events(spark.createDataFrame(rows, "document int, role string, status string, value date")).collect()}
    assert got == {(1, "published"), (1, "enters_into_force"), (2, "published")}


def test_equivalent_keys_are_classes(spark):
    rows = [(5, "LEY", "07", 1990, None), (3, "LEY", "7", 1990, None), (8, "LEY", "7", 1990, "DIAN"), (9, "LEY", "7", 1990, "MINTIC"), (4, "LEY", "7", 1991, "DIAN"), (2, "LEY", None, 1990, None)]
    got = {r.document_id: (r.representative, r.copies, list(r.compatible)) for r in registry.equivalent_keys(spark.createDataFrame(rows, "document_id int, document_type string, number string, year int, issuer string")).collect()}
    assert got == {5: (3, 2, [8, 9]), 3: (3, 2, [8, 9]), 8: (8, 1, [3]), 9: (9, 1, [3]), 4: (4, 1, [])}  # a key without a number equals none


def test_family_identity_counts_early_headings_only(spark):
    rows = [(1, 1, "A", True), (1, 13, "B", True), (2, 1, "A", True), (2, 2, "B", True), (3, 2, "A", False), (4, 1, None, None)]
    got = {r.document: r.state for r in registry.family_identity(spark.createDataFrame(rows, "document int, sequence_no int, heading string, compatible boolean")).collect()}
    assert got == {1: "accepted", 2: "FAMILY_IDENTITY_AMBIGUOUS", 3: "IDENTITY_CONFLICT", 4: "IDENTITY_UNRESOLVED"}


def test_doctor_report_lists_clean_checks_and_bounds_examples(spark):
    bad = spark.range(25).select(F.format_string("e%02d", "id").alias("example"))
    out = {r.check_id: r for r in doctor.report({("A", "x"): bad, ("B", "y"): bad.where("false"), ("C", "y"): bad.limit(1).withColumn("severity", F.lit("WARN"))}).collect()}
    assert (out["A"].status, out["A"].n, out["A"].examples.count(";")) == ("ERROR", 25, 9)
    assert (out["B"].status, out["B"].n, out["B"].examples) == ("PASS", 0, "") and out["C"].status == "WARN"
    assert {r.check_id for r in doctor.report({("A", "x"): bad, ("B", "y"): bad}, ["y"]).collect()} == {"B"}


def test_coverage_precedence(spark):
    rows = [("a", "hits", "ready", "resolved", "effective", "sufficient"), ("b", "hits", "incomplete", "conflicting", "ambiguous", "missing"), ("b", "hits", "ready", "resolved", None, None), ("c", "no_hits", None, None, None, None)]
    frame = spark.createDataFrame(rows, "aspect string, outcome string, context_status string, authority_status string, temporal_status string, fact_state string")
    execution = spark.createDataFrame([("a", "complete"), ("b", "complete")], "aspect string, execution string")
    got = {r.aspect: (r.execution, r.evidence, r.authority, r.temporal, r.facts, r.synthesis, r.closure) for r in coverage.ledger(frame, execution).collect()}
    assert got == {"a": ("complete", "context_ready", "resolved", "assessed", "sufficient", "requires_interpretive_synthesis", "complete"), "b": ("complete", "context_incomplete", "conflicting", "ambiguous", "missing", "requires_facts", "incomplete"), "c": ("not_started", "none_found", "unassessed", "unassessed", "not_required", "unsupported", "incomplete")}


def test_thematic_search_prefers_the_phrase_and_tells_numbers_apart(spark):
    rows = [(1, 0, "ARTÍCULO 70. Cancelación del registro"), (2, 0, "ARTÍCULO 7. Cancelación del registro único tributario"), (3, 0, "El registro y la cancelación de contratos"), (4, 0, "nada que ver"), (2, 1, "ARTÍCULO 7. Cancelación del registro único tributario")]
    segs = spark.createDataFrame(rows, "doc_id int, seq int, text string").withColumn("text_sha256", F.sha2("text", 256))
    asked = spark.createDataFrame([(1, 'artículo 7 cancelación del registro" OR *'), (2, None), (3, "")], "query_id int, text string")
    got = [(r.query_id, r.doc_id, r.seq, r.stage) for r in search.thematic(segs, asked, 5).orderBy("query_id", "place").collect()]
    assert got == [(1, 2, 0, 0), (1, 1, 0, 0), (1, 3, 0, 1)]


def test_blocks(spark):
    page = "<title>T &amp; U</title><script>x()</script><p>A</p><p>A</p><table><tr><td>1</td><td>2</td></tr></table>a<br>b<!-- c -->"
    got = blocks.visible(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")).orderBy("page_id", "seq").collect()
    assert [(r.page_id, r.text) for r in got] == [(1, "T & U"), (1, "A"), (1, "1 | 2"), (1, "a"), (1, "b")]
    rows = [(1, 0, "menu"), (1, 1, "Ley 5 de 1990"), (1, 2, "DECRETO 3 DE 2001"), (1, 3, "uno"), (1, 4, "dos"), (1, 5, "Compilación Jurídica DIAN"), (1, 6, "pie"), (2, 0, "sin encabezado")]
    body = {r.doc: (r.state, r.first, r.last, r.blocks) for r in blocks.legal_body(spark.createDataFrame(rows, "doc int, seq int, text string"), 3).collect()}
    assert body == {1: ("body", 2, 4, 3), 2: ("no_heading", None, None, 0)}


def test_guards_raise(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="comes back"):
        merge.refuse_differing(old, new, "k", "v")
    assert [r.k for r in merge.refuse_differing(old, new.where("k = 2"), "k", "v").collect()] == [2]
    with pytest.raises(ValueError, match="not unique"):
        bundle.unique_registry(old.union(old), "k")
    assert {(r.k, r.action) for r in merge.drift(old, new, "k", "v").collect()} == {(1, "rewrite"), (2, "add")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "segment_id int, extraction_id int, sequence_no int, segment_type string, text string")
    assert registry.date_candidates(none).count() == registry.boundaries(none).count() == 0
    assert search.thematic(spark.createDataFrame([], "doc_id int, seq int, text string, text_sha256 string"), spark.createDataFrame([(1, "uno dos")], "query_id int, text string"), 3).count() == 0


def test_dates_read_segments_once(spark):
    """Bounds of articles and closings are seen beside the texts: one pass over the segments, one shuffle by extraction."""
    segs = spark.createDataFrame([(1, 1, 1, "closing", "Dada en Cali, 3 de mayo de 1999", None), (2, 1, 2, "article", "x", None), (3, 2, 1, "text", "y", None)], SEGMENTS)
    out = registry.date_candidates(segs)
    assert [(r.segment_id, str(r.value), r.context) for r in out.collect()] == [(1, "1999-05-03", "primary_document_date")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1


def test_provision_for_segment_counts_without_a_distinct_aggregate(spark):
    seen = spark.createDataFrame([(1, 7, 1), (1, 7, 1), (2, 7, 1), (2, 8, 1), (3, 7, 9), (5, 7, 1), (5, 8, 9)], "segment_id long, provision_id long, extraction_id long")
    segments = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4, 5)], "segment_id long, extraction_id long")
    out = registry.provision_for_segment(seen, segments)
    assert {r.segment_id: (r.state, r.provision_id) for r in out.collect()} == {1: ("citable", 7), 2: ("ambiguous", None), 3: ("unverified", None), 4: ("missing", None), 5: ("citable", 7)}
    assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_checks_read_lines_that_are_written_once(spark):
    """No check of the doctor groups lines again, and a type without a registry is a warning however it is written."""
    from veritrail.operators import doctor
    from veritrail.plans import registry_queries

    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in registry_queries.checks(registry_queries._tables(spark, "/root/testdata/sf0.001")).values()]
    assert not any("RepartitionByExpression" in p for p in plans)
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 5), (4, "c", 5), (5, None, 5), (6, "b", None)], "id int, kind string, ref int")
    held = lambda *ids: (spark.createDataFrame([(i,) for i in ids], "key long"), "key")
    out = doctor.registered(rows, "kind", "ref", {"a": held(5, 5), "b": held(6)}, "id", "kind")
    assert sorted(tuple(r) for r in out.collect()) == [("2:a", "ERROR"), ("3:b", "ERROR"), ("4:c", "WARN"), ("5:-", "WARN"), ("6:b", "ERROR")]
