"""Detection runs: only what is new is read, and reading again adds nothing."""

from veritrail.operators import ledger

SEGMENTS = "segment_id long, extraction_id long, segment_type string, text string"
RUNS = "run_id string, extraction_id long, version string, mention_count long, relation_count long"


def test_ledger(spark):
    rows = [(1, 1, "article", "Deróguese el artículo 3 de la Ley 5 de 1990."), (2, 1, "text", "<Artículo modificado por el artículo 4 de la Ley 9 de 2000> Ley 8 de 2001."), (3, 2, "text", "nada"), (4, 3, "text", None)]
    segs, none = spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame([], RUNS)
    first = ledger.detect(segs, none)
    got = {r.extraction_id: (r.mention_count, r.relation_count) for r in first["runs"].collect()}
    # Ley 5 and its article, Ley 9 and its article, Ley 8.  The verb stands before article 3 and so not between it and Ley 5; the note is about article 4.
    assert got == {1: (5, 2), 2: (0, 0), 3: (0, 0)}
    assert {(r.normalized, r.relation_type) for r in first["relations"].collect()} == {("CO:LEY:5:1990:ART:3", "repeals"), ("CO:LEY:9:2000:ART:4", "modified_by")}
    assert first["mentions"].select("mention_id").distinct().count() == 5 and first["relations"].select("relation_id").distinct().count() == 2
    held = spark.createDataFrame(first["runs"].collect(), RUNS)
    again = ledger.detect(segs, held)
    assert all(t.count() == 0 for t in again.values())
    more = ledger.detect(segs.union(spark.createDataFrame([(9, 9, "text", "Ley 1 de 1991")], SEGMENTS)), held)
    assert [(r.extraction_id, r.mention_count) for r in more["runs"].collect()] == [(9, 1)]
    newer = ledger.detect(segs, held, version="4")
    assert {r.extraction_id for r in newer["runs"].collect()} == {1, 2, 3} and newer["runs"].join(held, "run_id").count() == 0
    same = ledger.detect(segs, none)
    assert sorted(r.mention_id for r in same["mentions"].collect()) == sorted(r.mention_id for r in first["mentions"].collect())


def test_mentions_are_found_once_for_all_that_reads_them(spark):
    segs = spark.createDataFrame([(1, 10, "article", "Modifíquese el artículo 5 de la Ley 100 de 1993.")], SEGMENTS)
    out = ledger.detect(segs, spark.createDataFrame([], RUNS))["runs"]
    assert [r.mention_count for r in out.collect()] == [2]
    assert "unico" not in out._jdf.queryExecution().optimizedPlan().toString()
