"""Queries against their SQL on small tables made so that the two could differ."""

import hashlib

import duckdb

from veritrail.plans import catalog
from veritrail.plans.corpus import derived


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL on tables (SQL that both engines read)."""
    con = duckdb.connect()
    for table, text in tables.items():
        spark.sql(text).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, catalog.QUERIES[name](spark, str(folder)).collect())), sorted(con.execute(catalog.ORACLES[name]).fetchall())


def test_parts_beyond_a_million_are_no_suppliers(spark, tmp_path):
    line = "SELECT CAST(p AS BIGINT) AS l_partkey, CAST(s AS BIGINT) AS l_suppkey FROM VALUES (1, 5), (2, 6), (1000005, 7) AS t(p, s)"
    part = "SELECT CAST(p AS BIGINT) AS p_partkey, CAST(z AS INT) AS p_size FROM VALUES (1, 7), (2, 3), (1000005, 7), (1000006, 7) AS t(p, z)"
    ours, theirs = both(spark, tmp_path, "one_hop", lineitem=line, part=part)
    assert ours == theirs == [(-8,), (-6,)]


def test_relevance_of_parts_beyond_a_million(spark, tmp_path):
    line = "SELECT CAST(p AS BIGINT) AS l_partkey, CAST(s AS BIGINT) AS l_suppkey FROM VALUES (1000005, 9) AS t(p, s)"
    part = "SELECT CAST(p AS BIGINT) AS p_partkey, CAST(z AS INT) AS p_size FROM VALUES (1000005, 40) AS t(p, z)"
    supplier = "SELECT CAST(5 AS BIGINT) AS s_suppkey, CAST(1 AS INT) AS s_nationkey"
    ours, theirs = both(spark, tmp_path, "edge_relevance", lineitem=line, part=part, supplier=supplier)
    assert ours == theirs == [("irrelevant", 1)]


def test_references_without_semicolon_and_escaped_twice(spark, tmp_path):
    pages = "SELECT CAST(1 AS BIGINT) AS page_id, '<title>a&amp;&amp</title><p>b&amp;amp;lt;c &copy&ltd&quot&#39; &AMP;gt e</p>' AS html"
    ours, theirs = both(spark, tmp_path, "parsed_blocks", pages=pages)
    want = [hashlib.md5(text.encode()).hexdigest() for text in ("a&&", "b<c ©<d\"' > e")]
    assert ours == theirs == [(1, i, digest) for i, digest in enumerate(want)]


def test_texts_stay_with_their_extraction(spark):
    """Segments are numbered by windows over their extraction, whose rows lie together before they have a text."""
    (seg,) = derived(spark, "/root/testdata/sf0.001", "seg")
    assert seg._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_families_are_found_once_a_type(spark):
    """Relations are counted by type before their types are read."""
    plan = catalog.QUERIES["relation_families"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9]+" in plan[: plan.index("Aggregate")] and "[^a-z0-9]+" not in plan[plan.index("Aggregate") :]


def test_blocks_are_keyed_once(spark):
    """The rules of a block's type read its key form as a column, not as an expression that each of them would find again."""
    plan = catalog.QUERIES["eleven_types"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2


def test_only_texts_that_may_have_notes_are_searched(spark):
    plan = catalog.QUERIES["editorial_relations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") > 0 and plan.count(", <)") == plan.count("RepartitionByExpression") > 0
