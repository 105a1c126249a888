"""The pipeline on the smallest corpus, stage by stage, and each op query's columns."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from veritrail.llm import catalog

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        path = corpus_pipeline.materialize(out, "t")
        if name in ("language", "near_dup"):
            assert path.join(docs, ["doc_id", "text"], "left_anti").count() == 0
        if name == "near_dup":
            assert path.count() == path.select("doc_id").distinct().count()
        if name == "repeats":
            assert path.where(F.length("text") != F.col("n_chars")).count() == 0
        docs = path
    assert 0 < docs.select("doc_id").distinct().count() <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_quality_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.sql(catalog.ORACLES["op1_line_quality"]).df().sort_values("doc_id").reset_index(drop=True)
    ours = catalog.QUERIES["op1_line_quality"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)[list(theirs.columns)]
    assert (ours == theirs).all().all()


def test_near_dup_stage_takes_pairs_from_080(spark):
    docs, likeness = [], []
    for i in range(12):
        words = [f"w{i}x{k}" for k in range(304)]
        changed = [f"c{i}" if k % 40 == 20 and k < 40 * (6 + i % 2) else w for k, w in enumerate(words)]
        a, b = ({tuple(x[k : k + 5]) for k in range(300)} for x in (words, changed))
        likeness.append(len(a & b) / len(a | b))
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    assert all(0.79 < x < 0.85 for x in likeness) and min(likeness) < 0.8 < max(likeness)
    out = corpus_pipeline.near_dup(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF)
    assert {r.doc_id for r in out.collect()} == {2 * i for i in range(12)} | {2 * i + 1 for i, x in enumerate(likeness) if x < 0.8}


def test_signature_distance_follows_the_similarity():
    from math import comb

    from veritrail.llm import near_dup

    for percent in (80, 85, 90):
        d = near_dup.distance_for(percent)
        missed = sum(comb(near_dup.SYMBOLS, k) * (1 - percent / 100) ** k * (percent / 100) ** (near_dup.SYMBOLS - k) for k in range(d + 1, near_dup.SYMBOLS + 1))
        assert missed <= 1e-4 and 2 * (len(near_dup.cuts_for(d)) - 1) > d


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))


def test_repeats_stage_removes_passages_of_51_words_and_more(spark):
    rng = random.Random(21)
    passages = [prose(rng, n) for n in range(51, 81)]
    texts = [[prose(rng, 40)] for _ in range(60)]
    for k, passage in enumerate(passages):
        for i in rng.sample(range(60), 2 + k % 3):
            texts[i] += [passage, prose(rng, 30)]
    clean = [prose(rng, 200) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate([" ".join(t) for t in texts] + clean)), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    left = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, SF).collect()}
    words = lambda t: {" ".join(t.split()[k : k + 51]) for k in range(len(t.split()) - 50)}
    gone = [p for p in passages if not any(words(p) & words(t) for t in left.values())]
    assert len(gone) >= 0.9 * len(passages)
    assert [left[60 + k] for k in range(20)] == clean


def test_language_stage_rejects_unknown_languages_only(spark):
    rng = random.Random(5)
    known = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "un", "ber", "ge"]}
    rows = [(i, " ".join("".join(rng.choices(known[x], k=3)) for _ in range(40)), x) for i, x in enumerate(rng.choices(sorted(known), k=200))]
    foreign = [(1_000 + i, " ".join("".join(rng.choices(["zyx", "qw", "vjk", "пр", "ств"], k=3)) for _ in range(40)), None) for i in range(10)]
    short = [(2_000, "kalomi taka", None), (2_001, "qwzyx", None), (2_002, None, "aa"), (2_003, "12 %", "aa")]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows + foreign + short, "doc_id long, text string, lang string"), SF)
    # A single foreign word proves nothing; no letters do.
    assert {r.doc_id for r in out.collect()} == set(range(200)) | {2_000, 2_001}


def test_stages_take_hard_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns named like the stages' own."""
    rng = random.Random(13)
    base = prose(rng, 120)
    rows = [(i, prose(rng, 60), "en" if i % 2 else "de", f"s{i % 3}", 5, 1.0, 7) for i in range(12)]
    rows += [(20, base, "en", "s1", 1, None, None), (20, base, "en", "s1", 1, None, None), (20, prose(rng, 50), "en", "s1", 1, None, None), (21, base + " end", None, None, None, None, None)]
    rows += [(None, prose(rng, 70), "en", "s0", 1, 2.0, 3), (None, None, None, None, None, None, None), (22, "", "en", "s1", 0, 0.0, 0), (23, prose(rng, 9_000), "en", "s1", 1, 0.0, 0), (24, " \n\t", "de", None, 0, 0.0, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_position double, q_text long"
    docs = corpus_pipeline.materialize(spark.createDataFrame(rows, schema), "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), "t")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name == "near_dup":
            kept = [(r.doc_id, r.text) for r in out.collect()]
            assert kept.count((20, base)) == 1 and sum(i == 20 for i, _ in kept) == 2 and not any(i == 21 for i, _ in kept)
            assert sum(i is None for i, _ in kept) == 1
        docs = out
    packing = corpus_pipeline.STAGES[-1][1]
    assert packing(spark, docs.limit(0), SF).count() == 0
    packed = packing(spark, docs, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
