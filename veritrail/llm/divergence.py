"""Source divergence audit over K²-quadtrees of the group-term count matrix (operator 13).

The matrix of a language has its sources as rows and its kept terms (those in
at least ``MIN_DOCS`` of its documents) as columns; a cell holds the smoothed
share of the term in the source, and every cell without occurrences of a row
holds the same share.  Spark deals the matrix out as tiles: a column tile (by
hash of the term) times a pair of row tiles (by hash of the source).  In a
tile the common terms come first, so that what is empty lies together.  Each
tile is stored as a quadtree: a bitmap a level, of which one bit covers 2 x 2
bits of the next, and dense leaves only where something occurs.  Pairs of rows
are compared by descending two trees at once: where both quadrants are empty,
all their pairs and columns are priced at once, as width times the price of two
empty cells; where a leaf is met, its cells are priced one by one.

Counting is by batches in the workers (a batch's occurrences are summed before
they are dealt), so a hot source or language is a few rows for each batch.

Defined results: null text, lang and source are ''.  Groups without terms, and
languages without kept terms, keep their pairs, of value 0 in the latter case.
Repeated rows and repeated doc_ids are documents of their own.  Texts of any
length are cut into terms whole.  Equal values are ranked by the item's UTF-8
bytes.  An empty table gives no rows.  Other columns are ignored.  Integers are
exact: shares are made from 38-digit decimals.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import Scratch, materialize

#: Fixed values of the contract: what parts terms, documents a kept term needs, the scale of shares, ranks given of terms.
TERM, MIN_DOCS, SCALE, TERM_RANKS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", 3, 1_000_000_000, 200
#: Rows and columns of a tile, on average; and of a leaf.
TILE_ROWS, TILE_COLUMNS, LEAF_ROWS, LEAF_COLUMNS = 64, 4_096, 8, 32

#: Bytes of UTF-8 as terms see them: A-Z in lower case, other ASCII that parts terms as a space; a term's other characters are bytes from 0x80.
_AS_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x80 and not re.fullmatch(TERM, chr(c)) else c for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, source, text) to (lang, source, term, n, docs), summed for each batch; a group's row without term tells that it occurs."""
    for batch in batches:
        n: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            terms = text.translate(_AS_TERMS).split()
            n.setdefault((lang, source), Counter()).update(terms)
            docs.setdefault((lang, source), Counter()).update(set(terms))
        for (lang, source), counts in n.items():
            terms = list(counts)
            seen = docs[lang, source]
            own = [pa.repeat(pa.scalar(x, pa.string()), len(terms) + 1) for x in (lang, source)]
            numbers = [pa.array([*(of[t] for t in terms), 0], pa.int64()) for of in (counts, seen)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([*terms, None], pa.binary()).cast(pa.string()), *numbers], names=["lang", "source", "term", "n", "docs"])


class QuadTree:
    """A tile's rows by 2 x 2 bitmaps and dense leaves; cells without occurrences hold their row's share ``empty``."""

    def __init__(self, empty: np.ndarray, width: int, rows: np.ndarray, columns: np.ndarray, shares: np.ndarray) -> None:
        """Row shares of empty cells, number of columns, and the cells that occur as (row, column, share)."""
        self.empty, self.width = empty, width
        blocks = max(1, -(-len(empty) // LEAF_ROWS)), max(1, -(-width // LEAF_COLUMNS))
        leaf = np.zeros(blocks, bool)
        leaf[rows // LEAF_ROWS, columns // LEAF_COLUMNS] = True
        self.levels = [leaf]
        while max(leaf.shape) > 1:
            padded = np.zeros((leaf.shape[0] + leaf.shape[0] % 2, leaf.shape[1] + leaf.shape[1] % 2), bool)
            padded[: leaf.shape[0], : leaf.shape[1]] = leaf
            leaf = padded.reshape(padded.shape[0] // 2, 2, padded.shape[1] // 2, 2).any(axis=(1, 3))
            self.levels.append(leaf)
        bits = self.levels[0]
        self.number = np.cumsum(bits).reshape(bits.shape) - 1
        filled = np.ones(blocks[0] * LEAF_ROWS, np.int64)
        filled[: len(empty)] = empty
        self.leaves = np.repeat(filled.reshape(-1, LEAF_ROWS)[np.nonzero(bits)[0]][:, :, None], LEAF_COLUMNS, axis=2)
        self.leaves[self.number[rows // LEAF_ROWS, columns // LEAF_COLUMNS], rows % LEAF_ROWS, columns % LEAF_COLUMNS] = shares

    def occupied(self, level: int, row: int, column: int) -> bool:
        """Whether the quadrant lies in the tile and holds a cell that occurs."""
        bits = self.levels[min(level, len(self.levels) - 1)]
        return row < bits.shape[0] and column < bits.shape[1] and bool(bits[row, column])

    def rows_under(self, level: int, row: int) -> slice:
        return slice((row << level) * LEAF_ROWS, min(((row + 1) << level) * LEAF_ROWS, len(self.empty)))

    def columns_under(self, level: int, column: int) -> int:
        return max(0, min(((column + 1) << level) * LEAF_COLUMNS, self.width) - (column << level) * LEAF_COLUMNS)

    def cells(self, row: int, column: int) -> np.ndarray:
        """Shares of a leaf's rows and of those columns that lie in the tile."""
        under, width = self.rows_under(0, row), self.columns_under(0, column)
        if self.levels[0][row, column]:
            return self.leaves[self.number[row, column], : under.stop - under.start, :width]
        return np.broadcast_to(self.empty[under, None], (under.stop - under.start, width))


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def divergence(a: QuadTree, b: QuadTree) -> np.ndarray:
    """Sum over all columns of price(a's row, b's row), for each pair of rows, by one joint descent."""
    out = np.zeros((len(a.empty), len(b.empty)), np.int64)
    both_empty = price(a.empty[:, None], b.empty[None, :])
    open_quadrants = [(max(len(a.levels), len(b.levels)) - 1, 0, 0, 0)]
    while open_quadrants:
        level, i, j, c = open_quadrants.pop()
        mine, theirs, width = a.rows_under(level, i), b.rows_under(level, j), a.columns_under(level, c)
        if mine.start >= mine.stop or theirs.start >= theirs.stop or not width:
            continue
        if not a.occupied(level, i, c) and not b.occupied(level, j, c):
            out[mine, theirs] += width * both_empty[mine, theirs]
        elif level:
            open_quadrants += [(level - 1, 2 * i + x, 2 * j + y, 2 * c + z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
        else:
            out[mine, theirs] += price(a.cells(i, c)[:, None, :], b.cells(j, c)[None, :, :]).sum(axis=2)
    return out


def _compare_tile(table: pa.Table) -> pa.Table:
    """One tile's rows (lang, lo, hi, row_tile, source, term, share, width) to (lang, source, item, value) for its pairs of sources.

    A row without term gives a source's share of empty cells and the tile's
    number of columns.
    """
    lang, lo, hi = (table.column(c)[0].as_py() for c in ("lang", "lo", "hi"))
    term = np.array(["" if t is None else t for t in table.column("term").to_pylist()], dtype=object)
    source = np.array(table.column("source").to_pylist(), dtype=object)
    row_tile, share = table.column("row_tile").to_numpy(), table.column("share").to_numpy()
    head = table.column("term").is_null().to_numpy()
    width = int(table.column("width").to_numpy()[head].max(initial=0))
    cells = np.flatnonzero(~head)
    column_of = {t: k for k, (t, _) in enumerate(sorted(Counter(term[cells].tolist()).items(), key=lambda x: (-x[1], x[0])))}
    trees: dict[int, tuple[QuadTree, list[str]]] = {}
    for tile in {lo, hi}:
        heads = np.flatnonzero(head & (row_tile == tile))
        row_of = {s: k for k, s in enumerate(source[heads].tolist())}
        own = cells[row_tile[cells] == tile]
        rows, columns = (np.array([of[x] for x in names[own].tolist()], dtype=np.int64) for of, names in ((row_of, source), (column_of, term)))
        trees[tile] = QuadTree(share[heads], width, rows, columns, share[own]), list(row_of)
    found: list[tuple[str, str, int]] = []
    for left, right in {(lo, hi), (hi, lo)}:
        (a, of_a), (b, of_b) = trees[left], trees[right]
        values = divergence(a, b)
        found += [(x, y, int(values[i, j])) for i, x in enumerate(of_a) for j, y in enumerate(of_b) if x != y]
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "source": pa.array([f[0] for f in found], pa.string()), "item": pa.array([f[1] for f in found], pa.string()), "value": pa.array([f[2] for f in found], pa.int64())})


def _share(count, total, terms):
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(38, 0)) * ({count} + 1)) DIV ({total} + {terms})").cast("long")


def audit(docs: DataFrame, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank for ``docs`` (text, lang, source)."""
    spark = docs.sparkSession
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    with Scratch(spark) as scratch:
        counted = read.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        counted = scratch.keep(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
        kept = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).where(F.col("lang_docs") >= MIN_DOCS).drop("lang_docs")
        kept = scratch.keep(kept, "terms")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
        langs = scratch.keep(counted.select("lang", "source").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(langs.hint("merge"), "lang", "left").na.fill(0, ["terms", "lang_total"]), "langs")
        cells = scratch.keep(counted.where("term IS NOT NULL").join(kept.hint("merge"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "cells")
        totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counted.where("term IS NULL").select("lang", "source").join(totals.hint("merge"), ["lang", "source"], "left").na.fill(0, ["total"]).join(langs.hint("merge"), "lang")
        groups = groups.withColumn("empty", F.when(F.col("terms") > 0, _share("0L", "total", "terms")).otherwise(1))
        groups = groups.withColumn("row_tiles", F.ceil(F.col("sources") / TILE_ROWS).cast("int")).withColumn("column_tiles", F.greatest(F.lit(1), F.ceil(F.col("terms") / TILE_COLUMNS).cast("int")))
        groups = scratch.keep(groups.withColumn("row_tile", F.pmod(F.xxhash64("source"), "row_tiles").cast("int")), "groups")
        own = groups.select("lang", "source", "total", "terms", "lang_total", "row_tiles", "column_tiles", "row_tile")
        priced = cells.join(own.hint("merge"), ["lang", "source"]).withColumn("share", _share("n", "total", "terms"))
        tile = F.pmod(F.xxhash64("term"), "column_tiles").cast("int")
        priced = scratch.keep(priced.withColumn("tile", tile).withColumn("lang_share", _share("lang_n", "lang_total", "terms")), "priced")
        widths = kept.join(langs.hint("merge"), "lang").withColumn("column_tiles", F.greatest(F.lit(1), F.ceil(F.col("terms") / TILE_COLUMNS).cast("int"))).groupBy("lang", tile.alias("tile")).agg(F.count(F.lit(1)).cast("int").alias("width"))
        heads = groups.where("sources > 1").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("column_tiles") - 1))).join(widths.hint("merge"), ["lang", "tile"], "left").na.fill(0, ["width"])
        heads = heads.select("lang", "tile", "row_tile", "row_tiles", "source", F.lit(None).cast("string").alias("term"), F.col("empty").cast("long").alias("share"), "width")
        rows = heads.unionByName(priced.select("lang", "tile", "row_tile", "row_tiles", "source", "term", "share", F.lit(0).alias("width")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("row_tiles") - 1))).select("lang", "tile", F.least("row_tile", "other").alias("lo"), F.greatest("row_tile", "other").alias("hi"), "row_tile", "source", "term", "share", "width")
        pairs = rows.groupBy("lang", "tile", "lo", "hi").applyInArrow(_compare_tile, "lang string, source string, item string, value long")
        pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
        ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        pairs = pairs.withColumn("rank", F.row_number().over(ranked))
        above = priced.where("share > lang_share").select("lang", "source", F.col("term").alias("item"), F.expr("((share - lang_share) * (share - lang_share)) DIV lang_share").alias("value"), F.lit("term").alias("part"))
        above = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= term_ranks)
        return materialize(pairs.unionByName(above).select("lang", "source", "part", "item", "value", "rank"), "divergence")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from every other of its language, and the terms that stand out: lang, source, part, item, value, rank."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))
