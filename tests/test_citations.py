"""Citation spans against Python's own regular expressions, and the rules of resolution and promotion on small rows."""

import re

import pytest

from veritrail.operators import citations

TEXTS = [
    "Según los artículos 3º, 4.1 y 5-1 de la Ley 0100 de 1993 y el Decreto Único Reglamentario 1625 de 2016, rige.",
    "El Concepto 012 345 de 2005 y el Oficio 123 del 4 de mayo de 2010 citan el Estatuto Tributario.",
    "Concepto 100 - int 45 de 2019; Oficio 7 8 int. 9 del 3 de junio de 2020.",
    "Artículo 12 del Estatuto Tributario; la Resolución DIAN No. 42 de 2020 en su artículo 3.2",
    "artículos 1 y 2 del Capítulo III del Título II del Decreto 390 de 2016. Ley 5 de 1990 Ley 5 de 1990",
    "xLey 5 de 1990, Ley 5 de 19901 y nada más",
    "",
]


@pytest.mark.parametrize("pattern", [citations.ACT, citations.STATUTE, citations.ARTICLE_OF, citations.ARTICLE_IN, citations.ACT_THEN_ARTICLE, citations.NOTE, *citations.LETTERS])
def test_spans_are_those_of_the_pattern(spark, pattern):
    low = [t.lower().translate(str.maketrans(citations.MARKED, citations.PLAIN)) for t in TEXTS]
    got = spark.createDataFrame([(t,) for t in TEXTS], "text string").select(citations.spans(citations.folded(citations.F.col("text")), pattern).alias("s")).collect()
    assert [[(m.start, m.raw) for m in r.s] for r in got] == [[(m.start(), m.group(0)) for m in re.finditer(pattern, t)] for t in low]


def test_mentions(spark):
    got = citations.mentions(spark.createDataFrame(list(enumerate(TEXTS)), "text_id int, text string")).collect()
    found = {(r.text_id, r.normalized) for r in got}
    assert {(0, "CO:LEY:100:1993:ART:3"), (0, "CO:LEY:100:1993:ART:4.1"), (0, "CO:LEY:100:1993:ART:5-1"), (0, "CO:LEY:100:1993"), (0, "CO:DECRETO:1625:2016")} <= found
    assert {(1, "CO:DIAN:CONCEPTO:12345:2005"), (1, "CO:DIAN:OFICIO:123:2010"), (1, "CO:ESTATUTO_TRIBUTARIO")} <= found
    assert {(2, "CO:DIAN:CONCEPTO:100:2019"), (2, "CO:DIAN:OFICIO:78:2020"), (3, "CO:ESTATUTO_TRIBUTARIO:ART:12"), (3, "CO:DIAN:RESOLUCION:42:2020:ART:3.2")} <= found
    assert {(4, "CO:DECRETO:390:2016:ART:1"), (4, "CO:DECRETO:390:2016:ART:2")} <= found
    assert all(TEXTS[r.text_id][r.char_start : r.char_end] for r in got) and not any(i >= 5 for i, _ in found)
    assert sum(r.normalized == "CO:LEY:5:1990" for r in got) == 2


@pytest.mark.parametrize(("label", "key"), [("DIAN", "DIAN"), ("Banco de la República", "BANREP"), ("Banco de la República Junta Directiva", "BANREP_JD"), ("Presidencia", "PRESIDENCIA"), ("Presidencia de la República", "PRESIDENCIA"), ("MinCIT", "MINCIT"), ("MinComercio", "MINCIT"), ("MinTIC", "MINTIC"), ("SGCAN", "SGCAN"), ("DAPR", "DAPR")])
def test_issuers_of_citations(spark, label, key):
    texts = spark.createDataFrame([(1, f"La Resolución {label} No. 042 de 2020 rige.")], "text_id int, text string")
    assert [(r.target_key, r.target_issuer, r.normalized) for r in citations.mentions(texts).collect()] == [("CO:RESOLUCION:42:2020", key, f"CO:{key}:RESOLUCION:42:2020")]


def test_announced_and_noted(spark):
    texts = spark.createDataFrame([(1, "Modifíquese el artículo 2 de la Ley 1 de 1990. Deróguese y modifíquese la Ley 3 de 1991. Deroga la Ley 4 de 1992."), (2, "<Artículo derogado por la Ley 9 de 2000> La Ley 8 de 2001.")], "text_id int, text string")
    found = citations.mentions(texts)
    verbs = {(r.text_id, r.normalized, r.relation_type) for r in citations.announced(found, citations.triggers(texts)).collect()}
    assert (1, "CO:LEY:1:1990:ART:2", "modifies") in verbs and (1, "CO:LEY:3:1991", "repeals") in verbs and (1, "CO:LEY:4:1992", "repeals") in verbs
    assert {(r.text_id, r.normalized, r.relation_type) for r in citations.noted(texts, found).collect()} == {(2, "CO:LEY:9:2000", "repealed_by")}


def test_resolution_rules(spark):
    docs = spark.createDataFrame([(1, "K1", None), (2, "K2", "DIAN"), (3, "K2", "MINHACIENDA"), (4, "K4", None)], "document_id int, key string, issuer string")
    prov = spark.createDataFrame([(10, 1, "1"), (11, 1, "2"), (12, 1, "2"), (13, 4, "1")], "provision_id int, document_id int, designation string")
    conflicts = spark.createDataFrame([(4, "1")], "document_id int, designation string")
    asked = spark.createDataFrame([(1, "document", "K1", None, None), (2, "article", "K1", None, "1"), (3, "article", "K1", None, "2"), (4, "article", "K1", None, "9"), (5, "document", "K2", None, None), (6, "document", "K2", "DIAN", None), (7, "document", "K9", None, None), (8, "article", "K1", None, ""), (9, "article", "K4", None, "1"), (10, "document", None, None, None)], "mention_id int, mention_type string, target_key string, target_issuer string, article string")
    got = {r.mention_id: (r.status, r.document_id, r.provision_id, r.reason) for r in citations.resolve(asked, docs, prov, conflicts).collect()}
    assert got == {
        1: ("resolved", 1, None, None), 2: ("resolved", 1, 10, None), 3: ("ambiguous", 1, None, "AMBIGUOUS_PROVISION_DESIGNATION"), 4: ("unresolved", 1, None, "TARGET_PROVISION_NOT_FOUND"), 5: ("ambiguous", None, None, "AMBIGUOUS_DOCUMENT_ID"),
        6: ("resolved", 2, None, None), 7: ("unresolved", None, None, "TARGET_DOCUMENT_NOT_FOUND"), 8: ("unresolved", 1, None, "TARGET_PROVISION_NOT_FOUND"), 9: ("ambiguous", 4, None, "AMBIGUOUS_PROVISION_DESIGNATION"), 10: ("unresolved", None, None, "TARGET_DOCUMENT_NOT_FOUND"),
    }


def test_strict_promotion_refuses_a_part(spark):
    relations = spark.createDataFrame([(1, 5, "modifies", 0.8), (2, 6, "repeals", 0.9)], "mention_id int, source_document int, relation_type string, confidence double")
    one = spark.createDataFrame([(1, "resolved", 7, 70, False, 0.9)], "mention_id int, status string, document_id int, provision_id int, review boolean, resolution_confidence double")
    with pytest.raises(ValueError, match="refused"):
        citations.promote_strict(relations, one)
    assert [r.confidence for r in citations.promote_strict(relations.where("mention_id = 1"), one).collect()] == [0.8]


def test_spans_of_texts_with_the_marking_character(spark):
    """Matches at both ends, side by side, and beside the character that marks them otherwise."""
    texts = ["12ab3", "\x0112\x013\x01", "", "ab", "1", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.m and [(m.raw, m.start) for m in r.m] for r in frame.select("i", citations.spans(citations.F.col("text"), "[0-9]").alias("m")).collect()}
    assert {i: m or [] for i, m in got.items()} == {i: [(c, at) for at, c in enumerate(t or "") if c.isdigit()] for i, t in enumerate(texts)}


def test_patterns_are_read_only_where_their_words_stand(spark):
    """A text without any word of a form leaves its pattern unread, whatever the form; the plan names the words."""
    frame = spark.createDataFrame([(1, "nada de eso")], "text_id int, text string")
    plan = citations.mentions(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains") + plan.count("contains(") >= len(citations.FORMS) and citations.mentions(frame).count() == 0
