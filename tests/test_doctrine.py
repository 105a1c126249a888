"""Doctrine and guidance pages on small rows: cardinalities, pairs of labels and contents, sessions of questions, refusals."""

import datetime

import pytest
from pyspark.sql import functions as F

from veritrail.operators import doctrine

SEGMENTS = "extraction_id long, segment_id long, sequence_no int, segment_type string, text string"
TITLE, DATE, WEB = ("paragraph", " CONCEPTO 001169 int 25 DE 2024 "), ("paragraph", "(Febrero 29)"), ("paragraph", "x Publicado en la página  web de la DIAN: 3 de mayo de 2024. y")
ONE = [("table_row", "PROBLEMA JURÍDICO | PROBLEMA JURÍDICO No. 1"), ("table_row", "¿Debe?"), ("table_row", "Tesis juridica No.1"), ("table_row", "Sí.")]


def page(spark, rows, extraction=1):
    return spark.createDataFrame([(extraction, extraction * 100 + i, i, k, t) for i, (k, t) in enumerate(rows, 1)], SEGMENTS)


def read(spark, rows, number="1169", year=2024, kind="CONCEPTO"):
    identity = spark.createDataFrame([(1, "A", kind, number, year)], "extraction_id long, document_id string, document_type string, number string, year int")
    return doctrine.doctrine(page(spark, rows), identity)


@pytest.mark.parametrize(
    ("rows", "status", "reason"),
    [
        ([TITLE, DATE, WEB, *ONE], "registered", None), ([TITLE, DATE, WEB], "registered", None), ([DATE, WEB, *ONE], "not_applicable", None), ([TITLE, TITLE, DATE, WEB], "not_applicable", None), ([TITLE, WEB, *ONE], "unresolved", "DOCTRINE_DATE_EVIDENCE_AMBIGUOUS"), ([TITLE, DATE, WEB, WEB], "unresolved", "DOCTRINE_DATE_EVIDENCE_AMBIGUOUS"),
        ([TITLE, ("paragraph", "Febrero 30"), WEB], "unresolved", "DOCTRINE_DATE_INVALID"), ([TITLE, ("paragraph", "Brumario 3"), WEB], "unresolved", "DOCTRINE_DATE_INVALID"), ([TITLE, DATE, WEB, *ONE[:3]], "partial", "INCOMPLETE_DOCTRINE_POSITIONS"), ([TITLE, DATE, WEB, *ONE, ONE[0], ("paragraph", "y")], "partial", "INCOMPLETE_DOCTRINE_POSITIONS"),
        ([TITLE, DATE, WEB, ("paragraph", "Problema jurídico No. 1")], "registered", None), ([], "not_applicable", None), ([TITLE, DATE, WEB, ("paragraph", None), (None, "x" * 1_000_000)], "registered", None),
    ],
)
def test_status(spark, rows, status, reason):
    got = read(spark, rows)["metadata"].first()
    assert (got.status, got.reason) == (status, reason)


def test_identity_decides_first(spark):
    for number, year, kind, status in (("1170", 2024, "CONCEPTO", "unresolved"), ("1169", 2023, "CONCEPTO", "unresolved"), (None, 2024, "CONCEPTO", "unresolved"), ("1169", 2024, "OFICIO", "not_applicable"), ("1169", 2024, None, "not_applicable")):
        got = read(spark, [TITLE, DATE, WEB, *ONE], number, year, kind)
        assert got["metadata"].first().status == status
        assert got["positions"].count() == got["events"].count() == got["evidence"].count() == 0


def test_rows_of_a_registered_page(spark):
    again = [("table_row", "PROBLEMA JURÍDICO No. 1"), ("table_row", "¿Puede?")]
    out = read(spark, [TITLE, DATE, WEB, *ONE, *again])
    meta = out["metadata"].first()
    assert (meta.title, meta.external_number, meta.normalized_number, meta.internal_number, meta.positions) == ("CONCEPTO 001169 int 25 DE 2024", "001169", "1169", "25", 1)
    assert (meta.doctrine_date, meta.web_date) == (datetime.date(2024, 2, 29), datetime.date(2024, 5, 3))
    (row,) = out["positions"].collect()
    assert (row.ordinal, row.problem_text, row.thesis_text, row.thesis_id) == (1, "¿Puede?", "Sí.", 107)  # of two labels the later one counts
    assert {(r.event_type, str(r.event_date), r.scope) for r in out["events"].collect()} == {("issued", "2024-02-29", "doctrine_document"), ("published", "2024-05-03", "dian_web")}
    shown = {r.role: (r.segment_id, r.evidence_id) for r in out["evidence"].collect()}
    assert {k: v[0] for k, v in shown.items()} == {"document_identity": 101, "doctrine_date": 102, "web_publication_date": 103, "problem_1": 109, "thesis_1": 107}
    assert {r.evidence_id for r in out["events"].collect()} <= {v[1] for v in shown.values()}


def test_positions_of_two_extractions_are_those_of_the_last(spark):
    both = page(spark, [TITLE, DATE, WEB, *ONE]).unionByName(page(spark, [TITLE, DATE, WEB, *ONE[:3], ("table_row", "No.")], 2))
    ids = spark.createDataFrame([(1, "A", "CONCEPTO", "1169", 2024), (2, "A", "CONCEPTO", "1169", 2024)], "extraction_id long, document_id string, document_type string, number string, year int")
    (row,) = doctrine.doctrine(both, ids)["positions"].collect()
    assert (row.extraction_id, row.thesis_text) == (2, "No.")


FORM = doctrine.RUT_CANCELLATION | {"questions": 2}
HEAD, Q, A = ("section_heading", f" {FORM['title']} "), ("question", "¿Sí?"), ("answer", "Sí.")


@pytest.mark.parametrize(
    ("rows", "extraction", "state"),
    [
        ([HEAD, Q, A, Q, A, A], {}, "registered"), ([HEAD, Q, A, Q, A], {"extractor": "other", "version": "x"}, "unsupported_extractor"), ([HEAD, Q, A, Q, A], {"extractor": None}, "unsupported_extractor"), ([HEAD, Q, A, Q, A], {"version": "1.5"}, "non_numeric_version"), ([HEAD, Q, A, Q, A], {"version": "1"}, "version_too_old"), ([], {}, "no_segments"),
        ([Q, HEAD, A, Q, A], {}, "unexpected_heading"), ([("paragraph", FORM["title"]), Q, A, Q, A], {}, "unexpected_heading"), ([HEAD, Q, A], {}, "question_count"), ([HEAD, Q, A, Q, A, Q, A], {}, "question_count"), ([HEAD, A, A], {}, "question_count"), ([HEAD, Q, A, Q], {}, "question_without_answer"),
        ([HEAD, Q, A, Q, ("section_heading", "Otra"), A], {}, "question_without_answer"), ([HEAD, Q, A, Q, A], {"document_id": "DOC-x"}, "linked_elsewhere"), ([HEAD, Q, ("paragraph", None), A, Q, A], {}, "registered"),
    ],
)
def test_guidance_states(spark, rows, extraction, state):
    row = {"extractor": FORM["extractor"], "version": "2", "document_id": None} | extraction
    asked = spark.createDataFrame([(1, 9, row["extractor"], row["version"], row["document_id"])], "extraction_id long, manifestation_id long, extractor string, version string, document_id string")
    out = doctrine.guidance(page(spark, rows), asked, FORM)
    assert out["pages"].first().state == state
    assert (out["rows"].count() > 0) == (state == "registered")


def test_guidance_rows_and_a_second_run(spark):
    rows = [HEAD, A, Q, A, ("section_heading", "Otra"), A, ("question", "¿Y?"), ("answer", "1"), ("paragraph", "p"), ("answer", "2")]
    asked = spark.createDataFrame([(1, 9, FORM["extractor"], "10", None)], "extraction_id long, manifestation_id long, extractor string, version string, document_id string")
    out = doctrine.guidance(page(spark, rows), asked, FORM)
    got = out["rows"].orderBy("ordinal", "answer_order").collect()
    assert [(r.ordinal, r.answer_order, r.text) for r in got] == [(1, 0, "¿Sí?"), (1, 1, "Sí."), (2, 0, "¿Y?"), (2, 1, "1"), (2, 2, "2")]
    assert len({r.question_id for r in got}) == 2
    assert {r.role for r in out["evidence"].collect()} == {"document_identity", "question_1", "question_1_answer_1", "question_2", "question_2_answer_1", "question_2_answer_2"}
    held = asked.withColumn("document_id", F.lit(out["pages"].first().document_id))
    assert sorted(doctrine.guidance(page(spark, rows), held, FORM)["rows"].collect()) == sorted(out["rows"].collect())
