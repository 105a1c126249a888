"""Functions and operators on small rows, with nulls, ties and empty input."""

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from veritrail.functions import forms, ids, text
from veritrail.operators import identity, merge, queue, relational, resolution, segments
from veritrail.sources import raw_store
from veritrail.streaming import frames


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_uuid5_equals_standard_library(spark):
    for name in ("a", "col:ñ", ""):
        assert one(spark, ids.uuid5_hex(F.lit(name))) == uuid.uuid5(uuid.NAMESPACE_URL, name).hex


def test_text_functions(spark):
    assert one(spark, text.fold(F.lit("ARTÍCULO Ñandú"))) == "articulo nandu"
    assert one(spark, text.collapse(F.lit(" a \n b "))) == "a b"
    assert one(spark, text.only_offset(F.lit("abcab"), F.lit("c"))) == 2
    assert one(spark, text.only_offset(F.lit("abcab"), F.lit("ab"))) is None
    assert one(spark, text.document_number(F.lit(" 000 12 a"))) == "12A"
    assert one(spark, text.spanish_date(F.lit("3 de Mayo del 1999"))) == date(1999, 5, 3)
    assert one(spark, text.spanish_date(F.lit("31 de febrero de 1999"))) is None
    assert one(spark, text.decimal_text(F.lit("-0.00").cast("decimal(10,2)"))) == "0"
    assert one(spark, text.decimal_text(F.lit("1400.50").cast("decimal(10,2)"))) == "1400.5"
    assert one(spark, text.backoff_seconds(F.lit(3), 60, 21_600)) == 480
    assert one(spark, text.backoff_seconds(F.lit(30), 60, 10_000)) == 10_000


def test_segments_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\na\nb")], "doc_id long, text string")
    assert [(r.doc_id, r.seq, r.text) for r in segments.segments(docs).orderBy("doc_id", "seq").collect()] == [(2, 0, ""), (3, 0, "a"), (3, 1, "a"), (3, 2, "b")]
    assert segments.drop_consecutive(segments.segments(docs)).count() == 3


def test_resolution_never_guesses(spark):
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "ref long, key string")
    targets = spark.createDataFrame([("x", 10), ("y", 20), ("y", 21), ("x", 10)], "key string, target long")
    got = {r.ref: (r.status, r.resolved_target) for r in resolution.resolve(asked, targets, "ref", "key", "target").collect()}
    assert got == {1: ("resolved", 10), 2: ("ambiguous", None), 3: ("unresolved", None), 4: ("unresolved", None)}


def test_resolution_counts_targets_before_it_meets_them(spark):
    """A key that many ask for and many have gives no pairs: the join yields a row for each question."""
    asked = spark.range(300).selectExpr("id AS ref", "'x' AS key").union(spark.createDataFrame([(300, "y"), (300, "z")], "ref long, key string"))
    targets = spark.range(400).selectExpr("'x' AS key", "id AS target").union(spark.createDataFrame([("y", 7), ("z", 7), ("z", None)], "key string, target long"))
    out = resolution.resolve(asked, targets, "ref", "key", "target")
    got = {r.ref: (r.matches, r.status, r.resolved_target) for r in out.collect()}
    assert got == {i: (400, "ambiguous", None) for i in range(300)} | {300: (2, "ambiguous", None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("count(distinct target")


def test_source_family(spark):
    names = ["Ley_0100_1993.htm", "oficio_dian_x.htm", "c-096_2001.htm", "weird.htm", None]
    got = spark.createDataFrame([(n,) for n in names], "name string").select(F.inline(F.array(identity.source_family(F.col("name"))))).collect()
    assert [(r.family, r.number, r.year) for r in got] == [("NORMATIVE_ACT", "100", 1993), ("DIAN_OFICIO", None, None), ("CORTE_CONSTITUCIONAL_SENTENCIA_C", "096", 2001), ("UNKNOWN", None, None), ("UNKNOWN", None, None)]


def test_merge_keeps_and_updates(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, name string, v long")
    new = spark.createDataFrame([(2, "z", 7), (3, "c", None)], "k long, name string, v long")
    assert sorted(map(tuple, merge.upsert(old, new, "k", ["v"]).collect())) == [(1, "a", 5), (2, "b", 7), (3, "c", None)]
    assert [tuple(r) for r in merge.insert_new(old, new, "k").collect()] == [(3, "c", None)]
    assert [r.k for r in merge.differing(old, new, "k", "v").collect()] == [2]


def test_as_of_takes_the_last_value_at_or_before(spark):
    left = spark.createDataFrame([(1, 10), (1, 3), (2, 5)], "u long, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 10, "b")], "u long, s long, v string")
    got = {(r.u, r.t): r.as_of_value for r in relational.as_of(left, right, "u", "t", "s", "v").collect()}
    assert got == {(1, 10): "b", (1, 3): None, (2, 5): None}


def test_queue_stale_items_fail(spark):
    q = spark.createDataFrame([("u", "running", datetime(2024, 1, 1), None, 0)], "url string, status string, started timestamp, due timestamp, attempts int")
    got = queue.fail_stale(q, F.lit("2024-01-03").cast("timestamp"), 3_600).first()
    assert (got.status, got.due) == ("error", datetime(2024, 1, 3))


def test_raw_store_is_append_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes("café".encode("latin-1"))
    (tmp_path / "in/b").write_bytes("café".encode())
    raw = raw_store.read_raw(spark, str(tmp_path / "in"))
    assert {r.t for r in raw.select(raw_store.decode_html(F.col("content")).alias("t")).collect()} == {"café"}
    store = str(tmp_path / "store")
    raw_store.append_new(raw, store)
    raw_store.append_new(raw, store)
    kept = spark.read.parquet(store)
    assert kept.count() == 2 and raw_store.verify(kept).count() == 0


def test_frames(spark):
    rows = [("x", datetime(2024, 1, 1, 0), 0.9), ("x", datetime(2024, 1, 1, 1), 0.9), ("y", datetime(2024, 1, 1, 8), 0.9), ("z", None, 0.9), ("w", datetime(2024, 1, 1, 8), 0.1)]
    f = spark.createDataFrame(rows, "frame_sha string, frame_ts timestamp, confidence double")
    good, bad = frames.split_untrusted(f, 0.5)
    assert sorted(r.reason for r in bad.collect()) == ["low_confidence", "unreadable_time"]
    first = frames.first_sight(good)
    assert {(r.frame_sha, r.frame_ts.hour) for r in first.collect()} == {("x", 0), ("y", 8)}
    assert [r.frame_sha for r in frames.retained(first).collect()] == ["y"]


def test_frames_on_a_stream(spark, tmp_path):
    rows = [("x", datetime(2024, 1, 1, 0), 0.9), ("x", datetime(2024, 1, 1, 1), 0.9), ("y", datetime(2024, 1, 1, 2), 0.9)]
    spark.createDataFrame(rows, "frame_sha string, frame_ts timestamp, confidence double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("frame_sha string, frame_ts timestamp, confidence double").parquet(str(tmp_path / "in"))
    query = frames.first_sight(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    assert sorted(r.frame_sha for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_key_form_of_ragged_texts(spark):
    texts = ["  Artículo  5\t", "a ́ b", "ARTÍCULO 5", "é x", " ", "", None, " Ñ　ñ"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(forms.key_form(F.col("t"))).collect()]
    assert got == ["ARTICULO 5", "A B", "ARTICULO 5", "E X", "", "", None, "N N"]
