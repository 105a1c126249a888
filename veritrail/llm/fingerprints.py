"""SimHash document fingerprints (operator 9), in DataFrame functions only.

Terms are runs of two words (a text with fewer has one term, its word or none).  Each occurrence votes on every bit of a 128-bit
fingerprint with its term's hash, weighted by how often the term stands in the
text; a bit is set when more than half of the votes are for it.  Likeness is
the cosine that the share of equal bits stands for, between 0 and 1.

Votes are summed by Spark's own aggregation, two bits a counter of 32 bits
each, on rows that are already together.

``edited`` texts need each document's successor in descending doc_id order:
rows are dealt once, by ranges of doc_id; only the first row of each range is
also given to the range before it.

Defined results: a null text is an empty one; empty texts have the fingerprint
of the empty term.  With one row, a document is its own successor.  Rows of
equal doc_id follow each other in order of a hash of their texts; null doc_ids
come last.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import WORD_GAP, Scratch, let, materialize

TERM_WORDS = 2
#: 32 counters of two bits for each 64-bit half.
_LANES = 32
_PAIR = 0x0000000100000001


def term_hashes(text: Column) -> Column:
    """64-bit hashes of a text's terms in order."""

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - TERM_WORDS)
        return F.when(F.size(h) >= TERM_WORDS, F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(TERM_WORDS)]))).otherwise(F.array(F.xxhash64(h)))

    return let(F.transform(F.filter(F.split(text, WORD_GAP), lambda w: w != F.lit("")), lambda w: F.xxhash64(w)), runs)


def simhash(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """(keys…, high, low): the fingerprint of each row's ``hashes`` (array of long), by votes of equal weight for each occurrence.

    ``keys`` tell the rows apart; if they include the column that the rows are
    dealt by, nothing is dealt again.
    """
    terms = rows.select(*keys, F.explode(hashes).alias("__t")).withColumn("__u", F.xxhash64("__t", F.lit(1)))
    sums = [F.sum(F.shiftrightunsigned(F.col(half), lane).bitwiseAND(F.lit(_PAIR))).alias(f"{half}{lane}") for half in ("__t", "__u") for lane in range(_LANES)]
    votes = terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *sums)

    def half(name: str) -> Column:
        bits = []
        for lane in range(_LANES):
            v = F.col(f"{name}{lane}")
            top = (1 << (lane + 32)) if lane < 31 else -(1 << 63)
            bits.append(F.when(2 * v.bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("__n"), F.lit(1 << lane)).otherwise(F.lit(0)).cast("long"))
            bits.append(F.when(2 * F.shiftrightunsigned(v, 32) > F.col("__n"), F.lit(top)).otherwise(F.lit(0)).cast("long"))
        while len(bits) > 1:
            bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2], strict=True)]
        return bits[0]

    return votes.select(*keys, half("__t").alias("high"), half("__u").alias("low"))


def likeness(high_a: Column, low_a: Column, high_b: Column, low_b: Column) -> Column:
    """Cosine of the angle that the share of differing bits stands for; 0 from half of the bits on."""
    differ = F.bit_count(high_a.bitwiseXOR(high_b)) + F.bit_count(low_a.bitwiseXOR(low_b))
    return F.when(differ == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.cos(differ * F.lit(3.141592653589793 / 128))))


def as_text(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def with_successor(docs: DataFrame, parts: int, ranges: int) -> DataFrame:
    """(bucket, row, ghost, doc_id, text, next_text) of ``docs`` in descending doc_id order, in ``bucket`` and ``row`` order.

    ``next_text`` is the text of the next row, and of the first row after the
    last.  Buckets are ranges between quantiles of doc_id; each ends with a
    ghost, the first row of the bucket after it.  Dealt by ``bucket``.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = plain.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    cuts = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]).cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(cuts, lambda c: c >= F.col("doc_id"))), F.lit(len(bounds) + 1))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(bucket)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = plain.withColumn("bucket", bucket)
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # at most ``ranges`` + 1 rows
    numbered = heads.select(F.col("bucket").alias("h_bucket"), "top", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy(F.lit(1)))).alias("before"))
    first = Window.partitionBy("bucket").orderBy(F.xxhash64("text"))
    tops = dealt.join(F.broadcast(numbered), (F.col("bucket") == F.col("h_bucket")) & F.col("doc_id").eqNullSafe(F.col("top"))).withColumn("__r", F.row_number().over(first)).where("__r = 1")
    ghosts = tops.select("doc_id", "text", F.col("before").alias("bucket"), F.lit(True).alias("ghost"))
    both = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition(parts, "bucket")
    run = Window.partitionBy("bucket").orderBy("ghost", *order)
    return both.select("bucket", F.row_number().over(run).alias("row"), "ghost", "doc_id", "text", F.lead("text").over(run).alias("next_text"))


def edit(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n / 3) characters replaced by the next text's first as many, or all."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(next_text, F.lit(1), cut))


def halves(text: Column) -> tuple[Column, Column]:
    """(high, low) of a fingerprint as ``as_text`` writes it."""
    return tuple(F.conv(F.substring(text, at, 16), 16, -10).cast("long") for at in (1, 17))


def _signed(mask: int, size: int) -> list[int]:
    """A mask of ``size`` bits as signed longs, high to low."""
    parts = [(mask >> at) & ((1 << 64) - 1) for at in range(size - 64, -1, -64)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in parts]


def _tables(size: int, radius: int, blocks: int) -> list[list[int]]:
    """The masks of the permuted tables: each choice of ``blocks - radius`` blocks of the bits."""
    from itertools import combinations

    if not 0 <= radius < blocks:
        raise ValueError("more blocks than the radius are needed")
    cuts = [round(size * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_signed(sum(chosen), size) for chosen in combinations(masks, blocks - radius)]


def _masked(values: list[Column], mask: list[int]) -> list[Column]:
    return [v.bitwiseAND(F.lit(m)) for v, m in zip(values, mask, strict=True)]


def _keyed(prints: DataFrame, names: list[str], tables: list[list[int]], side: list[str], *others: str) -> DataFrame:
    """``prints`` once for each table, with its number ``t`` and its key ``k``."""
    own = [F.col(n) for n in names]
    keys = F.array(*[F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_masked(own, m))]) for m in tables])
    return prints.select(*[F.col(n).alias(x) for n, x in zip(names, side, strict=True)], *others, F.posexplode(keys).alias("t", "k"))


def _met(left: DataFrame, right: DataFrame, a: list[str], b: list[str], tables: list[list[int]], radius: int) -> DataFrame:
    """Rows of both sides within the radius, each pair from the first table that has it."""
    diff = [F.col(x).bitwiseXOR(F.col(y)) for x, y in zip(a, b, strict=True)]
    distance = sum((F.bit_count(d) for d in diff[1:]), F.bit_count(diff[0]))
    first = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(tables))):
        same = [x == 0 for x in _masked(diff, m)]
        first = F.when(same[0] & same[-1], F.lit(i)).otherwise(first)
    return left.join(right.hint("merge"), ["t", "k"]).withColumn("distance", distance).where((F.col("distance") <= radius) & (first == F.col("t")))


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs of distinct fingerprints within Hamming ``radius``, a < b.

    Permuted block tables: the bits fall into ``blocks`` blocks, and two
    fingerprints within the radius agree on at least ``blocks - radius`` of
    them; there is a table for each choice of that many blocks, keyed by their
    bits, and a pair is taken from the first table that has it.  ``prints``
    has the columns ``high`` and ``low`` of 128-bit fingerprints, for
    (a_high, a_low, b_high, b_low, distance), or one column ``fingerprint``
    (long) of 64 bits, for (a, b, distance); equal ones count once, so copies
    make no pairs.
    """
    wide = "fingerprint" not in prints.columns
    names = ["high", "low"] if wide else ["fingerprint"]
    tables = _tables(64 * len(names), radius, blocks)
    a, b = ([side + (f"_{n}" if wide else "") for n in names] for side in ("a", "b"))
    distinct = prints.select(*names).dropna().distinct()
    before = F.struct(*a) < F.struct(*[F.col(y).alias(x) for x, y in zip(a, b, strict=True)])
    met = _met(_keyed(distinct, names, tables, a), _keyed(distinct, names, tables, b), a, b, tables, radius)
    return met.where(before).select(*a, *b, "distance")


def near_counts(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(high, low, n_near) for each distinct fingerprint of ``queries`` (high, low): how many rows of ``prints`` (high, low) lie within Hamming ``radius``.

    By the tables of ``near_pairs``; rows of one fingerprint are counted
    first, so copies meet a query once.
    """
    names, a, b = ["high", "low"], ["a_high", "a_low"], ["b_high", "b_low"]
    tables = _tables(128, radius, blocks)
    counted = prints.select(*names).dropna().groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    met = _met(_keyed(counted, names, tables, b, "n"), _keyed(queries.select(*names).dropna().distinct(), names, tables, a), a, b, tables, radius)
    return met.groupBy(*a).agg(F.sum("n").alias("n_near")).select(F.col("a_high").alias("high"), F.col("a_low").alias("low"), "n_near")


def fingerprint_documents(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, high, low for each row of ``docs`` (doc_id, text)."""
    rows = with_successor(docs, parts, min(8 * parts, 2_048))
    rows = rows.withColumn("edited", edit(F.col("text"), F.coalesce("next_text", F.lit(""))))
    versions = F.array(
        F.struct(F.lit(0).alias("v"), term_hashes(F.col("text")).alias("h"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("v"), term_hashes(F.col("edited")).alias("h"), F.sha2("edited", 256).alias("sha")),
    )
    each = rows.select("bucket", "row", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.explode(versions).alias("e"))
    keys = ["bucket", "row", "ghost", "doc_id", "n_chars", "v", "sha"]
    prints = simhash(each.select("bucket", "row", "ghost", "doc_id", "n_chars", "e.v", "e.sha", "e.h"), keys, "h")
    pick = lambda name, v: F.max(F.when(F.col("v") == v, F.col(name)))
    one = prints.groupBy("bucket", "row", "ghost", "doc_id", "n_chars").agg(pick("high", 0).alias("high"), pick("low", 0).alias("low"), pick("high", 1).alias("e_high"), pick("low", 1).alias("e_low"), F.max("sha").alias("edited_sha256"))
    run = Window.partitionBy("bucket").orderBy("row")
    last = one.withColumn("n_high", F.lead("high").over(run)).withColumn("n_low", F.lead("low").over(run)).where(~F.col("ghost"))
    own = (F.col("high"), F.col("low"))
    return last.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(*own).alias("fingerprint"), as_text(F.col("e_high"), F.col("e_low")).alias("edited_fingerprint"),
        likeness(*own, F.col("e_high"), F.col("e_low")).alias("near_edited"), likeness(*own, F.col("n_high"), F.col("n_low")).alias("near_next"), "high", "low",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; and, for doc_ids divisible by 50, n_near: how many other documents have a fingerprint within 3 bits."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as scratch:
        made = scratch.keep(fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), parts), "fingerprints")
        asked = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
        found = near_counts(made.where(asked), made).withColumn("n_near", F.col("n_near") - 1)
        with_near = made.where(asked).join(found.hint("merge"), ["high", "low"]).unionByName(made.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
        return materialize(with_near.drop("high", "low"), "op9")
