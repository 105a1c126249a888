"""Registration of identities on small rows: bind, alias, unbind, and runs that settle."""

from veritrail.functions.ids import prefixed_id
from veritrail.operators import identities
from pyspark.sql import functions as F

ASSESSED = "manifestation_id long, state string, document_type string, number string, year int, issuer string, title string, trusted_family boolean"


def doc_id(spark, key):
    return spark.range(1).select(prefixed_id("DOC", F.lit(key)).alias("x")).first().x


def tables(spark):
    rows = [
        (1, "accepted", "LEY", "5", 1990, "CONGRESO", "Ley 5", False), (2, "accepted", "RESOLUCION", "042", 2020, "DIAN", "Res 42", False), (3, "accepted", "RESOLUCION", "42", 2020, None, "Res 42", False), (4, "IDENTITY_CONFLICT", "LEY", "6", 1991, "CONGRESO", "x", False),
        (5, "accepted", "LEY", "0007", 1992, None, "Ley 7", False), (6, "accepted", "LEY", "8", 1993, "CONGRESO", "Ley 8", False), (7, "accepted", "CONCEPTO", "9", 2001, "DIAN", "Con 9", True), (8, "accepted", "CONCEPTO", "9", 2001, "DIAN", "Con 9", False),
    ]
    assessed = spark.createDataFrame(rows, ASSESSED)
    man = spark.createDataFrame([(1, None), (2, "D2"), (3, None), (4, "D4"), (5, "D5"), (6, "D6"), (7, "D7"), (8, "D7"), (99, "D9")], "manifestation_id long, document_id string")
    docs = spark.createDataFrame([(f"D{i}", "UNKNOWN", "X", "old") for i in (2, 4, 5, 6, 7, 9)], "document_id string, entity string, document_type string, title string")
    keys = [("i2", "D2", "CO:DIAN:RESOLUCION:0042:2020", "DIAN"), ("i5", "D5", "CO:LEY:07:1992", None), ("i6", "D6", "CO:LEY:8:1994", None), ("i7", "D7", "CO:CONCEPTO:9:2001", None)]
    ids = spark.createDataFrame([(i, d, "canonical_key", v, s, True) for i, d, v, s in keys] + [("t", "D9", "title", "CO:LEY:1:1", None, False)], "identifier_id string, document_id string, identifier_type string, identifier_value string, issuer string, is_primary boolean")
    reviews = spark.createDataFrame([("r1", "manifestation", 1, "IDENTITY_CONFLICT", None), ("r2", "manifestation", 1, "OTHER", None), ("r3", "document", 1, "IDENTITY_CONFLICT", None)], "review_id string, entity_type string, entity_id long, reason string, resolution string")
    return assessed, man, docs, ids, reviews


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_registration(spark):
    assessed, man, docs, ids, reviews = tables(spark)
    out = identities.register(assessed, man, docs, ids, reviews)
    got = {r.manifestation_id: (r.outcome, r.document_id, r.primary_key, r.reason) for r in out["decisions"].collect()}
    assert got == {
        1: ("registered", doc_id(spark, "CO:LEY:5:1990"), "CO:LEY:5:1990", None), 2: ("aliased", "D2", "CO:DIAN:RESOLUCION:0042:2020", None), 3: ("unresolved", None, None, "IDENTITY_UNRESOLVED"), 4: ("unresolved", None, None, "IDENTITY_CONFLICT"),
        5: ("aliased", "D5", "CO:LEY:07:1992", None), 6: ("conflict", None, None, "SOURCE_IDENTITY_CONFLICT"), 7: ("aliased", "D7", "CO:DIAN:CONCEPTO:9:2001", None), 8: ("conflict", None, None, "SOURCE_IDENTITY_CONFLICT"),
    }
    assert {r.manifestation_id: r.document_id for r in out["manifestations"].collect()}[99] == "D9"
    keys = {(r.document_id, r.identifier_value): r.is_primary for r in out["identifiers"].collect()}
    assert keys["D7", "CO:DIAN:CONCEPTO:9:2001"] and not keys["D7", "CO:CONCEPTO:9:2001"] and keys["D2", "CO:DIAN:RESOLUCION:0042:2020"] and ("D9", "CO:LEY:1:1") in keys
    assert {r.document_id: r.title for r in out["documents"].collect()}["D5"] == "Ley 7"
    state = {(r.entity_id, r.entity_type, r.reason): r.resolution for r in out["reviews"].collect()}
    assert state[1, "manifestation", "IDENTITY_CONFLICT"] == "registered" and state[1, "manifestation", "OTHER"] is None and state[1, "document", "IDENTITY_CONFLICT"] is None and state[6, "manifestation", "SOURCE_IDENTITY_CONFLICT"] is None


def test_runs_settle(spark):
    assessed, *state = tables(spark)
    names = ("manifestations", "documents", "identifiers", "reviews")
    seen = []
    for _ in range(3):
        out = identities.register(assessed, *state)
        state = [spark.createDataFrame(out[n].collect(), out[n].schema) for n in names]
        seen.append([rows(t) for t in state])
    assert seen[0] != seen[1]  # what a conflict unbound is registered anew
    assert seen[1] == seen[2]


def test_rebind(spark):
    moves = spark.createDataFrame([("a", "b")], "document_id string, new_id string")
    out = identities.rebind(moves, {"events": spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "event_id int, document_id string")})
    assert {r.event_id: r.document_id for r in out["events"].collect()} == {1: "b", 2: "c", 3: None}
