"""Blocks of pages with hidden, nested and unclosed elements."""

import pytest
from pyspark.sql import functions as F

from veritrail.operators import blocks, markup


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a <b>b</b>c</p><div>d<br>e</div>f", ["a b c", "d", "e", "f"]),
        ("<p>a<script>if (x < 1) { '<p>' }</script>b<style>p{}</style></p>", ["a b"]),
        ("a<svg><svg>x</svg>y</svg>b<noscript>c<template>d</template>e</noscript>", ["a b"]),
        ("a<template>never closed <p>b</p>", ["a"]),
        ("a</svg></template>b", ["a b"]),
        ("<!-- <p>x</p> --><p>1 &lt; 2 &amp;amp; 3&nbsp;&eacute;&#233;</p>", ["1 < 2 & 3 éé"]),
        ("<table><tr><td>a<p>b</p></td><th> </th><td>c</td></tr><tr><td>d</td></tr></table>e", ["|a b | c", "|d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table><p>after</p>", ["|a | b", "|c", "after"]),
        ("<table><tr><td>a<td>b", ["|a | b"]),
        ("<table><tr><td>a<table><tr><td>in</td></tr></table>z</td><td>b</td></tr></table>c", ["|a", "|in", "|z | b", "c"]),
        ("<table><tr>stray<td>a</td></tr></table>", ["|a", "stray"]),
        ("<td>no table</td><tr>no row", ["no table", "no row"]),
        ("<p>x</p><p>x</p><table><tr><td>x</td></tr></table><p>x", ["x", "|x", "x"]),
        ("<p>a<p/>b</div></table></tr>c", ["a", "b", "c"]),
        ("", []), (None, []), ("<p> \n\t&nbsp;</p>", []), ("a < b", ["a < b"]),
    ],
)
def test_blocks(spark, page, want):
    frame = spark.createDataFrame([(1, page, "clash")], "page_id long, html string, seq string")
    assert [("|" if r.kind == "table_row" else "") + r.text for r in markup.blocks(frame).orderBy("seq").collect()] == want


def test_long_pages_are_read_whole(spark):
    frame = spark.range(1).select(F.lit("p").alias("page_id"), F.expr("concat('<table>', repeat('<tr><td>a<td>b', 20000), repeat('<div>', 20000), 'end')").alias("html"))
    rows = markup.blocks(frame).orderBy("seq").collect()
    assert [r.text for r in rows] == ["a | b", "a | b end"] and markup.blocks(frame.limit(0)).count() == 0


def test_given_pages_agree_with_the_passes_over_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    lines = lambda df: {r.page_id: r.t for r in df.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text")))["text"].alias("t")).collect()}
    parsed, passed = lines(markup.blocks(pages)), lines(blocks.visible(pages))
    assert parsed.keys() == passed.keys()
    different = [(p, parsed[p], passed[p]) for p in parsed if parsed[p] != passed[p]]
    assert not different, (len(different), len(parsed), different[0])
