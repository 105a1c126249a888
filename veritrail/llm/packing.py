"""Best-fit packing after Martello-Toth dominance reduction (operator 7).

A sequence holds at most ``capacity`` tokens.  Pieces of one length are alike,
so the whole packing is a plan over at most ``capacity`` lengths and their
counts: the driver works on that bounded histogram, never on pieces, and plans
*patterns* (a multiset of lengths that share a sequence, and how many such
sequences).  Reduction fixes sets that dominate every other use of one of
their pieces; best-fit decreasing places the rest.  Spark then numbers the pieces of
each length and each takes its place in the plan.

Defined results: a null or empty text is one piece with just the end id.  A
piece longer than ``capacity`` cannot occur.  Repeated rows and doc_ids keep
pieces of their own; a null doc_id is kept.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import materialize

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as pieces of at most ``capacity`` tokens; only longer documents are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from veritrail.llm.tokens import encoder

        enc, tail = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                raw += tail
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def _reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello and Toth's reduction: the sets that it fixes, and the counts that it leaves undecided.

    A set that holds a piece and dominates all feasible sets with that piece
    stands in some best packing.  Sets of up to three pieces are looked at, for
    every length, the longest first, until a pass fixes nothing.  What holds
    for one piece holds for the next of its length while the set's other
    pieces last, so each set is taken as often as counts allow.
    """
    left = dict(counts)
    plan: list[tuple[tuple[int, ...], int]] = []
    fixed = True
    while fixed:
        fixed = False
        lengths = sorted(x for x, n in left.items() if n)
        for length in reversed(lengths):
            while left[length]:
                left[length] -= 1
                others = _dominant(left, lengths, capacity - length)
                left[length] += 1
                if others is None:
                    break
                need = Counter((length, *others))
                times = min(left[x] // n for x, n in need.items())
                for x, n in need.items():
                    left[x] -= n * times
                plan.append(((length, *others), times))
                fixed = True
    return plan, {x: n for x, n in left.items() if n}


def _longest(left: dict[int, int], lengths: list[int], bound: int) -> int:
    """The longest length <= bound with a piece left, or 0."""
    i = bisect_right(lengths, bound) - 1
    while i >= 0 and not left[lengths[i]]:
        i -= 1
    return lengths[i] if i >= 0 else 0


def _smallest(left: dict[int, int], lengths: list[int], above: int, n: int) -> list[int]:
    """The ``n`` smallest pieces longer than ``above``, or as many as there are."""
    out: list[int] = []
    for i in range(bisect_right(lengths, above), len(lengths)):
        out += [lengths[i]] * min(n - len(out), left[lengths[i]])
        if len(out) == n:
            break
    return out


def _dominant(left: dict[int, int], lengths: list[int], room: int) -> tuple[int, ...] | None:
    """What to put beside a piece that leaves ``room``, where that dominates all else; None where undecided."""
    small = _smallest(left, lengths, 0, 3)
    if not small or small[0] > room:
        return ()
    partner = _longest(left, lengths, room)
    if partner == room or len(small) < 2 or small[0] + small[1] > room:
        return (partner,)
    if len(small) == 3 and sum(small) <= room:
        return None
    # Two more fit, and never three: the pair of the largest sum.
    best, low, high = 0, 0, bisect_right(lengths, room) - 1
    while low <= high:
        a, b = lengths[low], lengths[high]
        if a + b > room or not left[b]:
            high -= 1
        elif not left[a] or (a == b and left[a] < 2):
            low += 1
        else:
            best = max(best, a + b)
            low += 1
    if best <= partner:
        return (partner,)
    left[partner] -= 1
    second = _longest(left, lengths, room - partner)
    left[partner] += 1
    if not second or partner + second < best:
        return None
    # No pair may have both pieces longer than the second: else neither set dominates the other.
    longer = _smallest(left, lengths, second, 2)
    return (partner, second) if len(longer) < 2 or sum(longer) > room else None


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: each piece goes to the open sequence with the least room that holds it, or opens one.

    Sequences of like room are filled in groups.  A sequence that took a piece
    is the tightest for the next of its length, so it takes as many as fit.
    """
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room: (pattern, how many)
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if times:
            if room not in opened:
                opened[room] = []
                insort(rooms, room)
            opened[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // length
            if at < len(rooms):
                pattern, times = opened[room].pop()
                if not opened[room]:
                    del opened[room], rooms[at]
            else:
                pattern, times = (), -(-n // each)
            full = min(times, n // each)
            put(pattern + (length,) * each, full, room - each * length)
            n -= full * each
            if full < times:
                put(pattern + (length,) * n, 1, room - n * length) if n else None
                put(pattern, times - full - (n > 0), room)
                n = 0
    return [group for room in rooms for group in opened[room]]


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences) that use every piece once: the sets that reduction fixes, and best-fit decreasing for the rest."""
    plan, rest = _reduce({x: n for x, n in counts.items() if n}, capacity)
    return plan + _best_fit(rest, capacity)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with ``length``; materialized, as it is read several times) with ``sequence_id`` and ``offset``.

    Pieces of one length are numbered in two levels (partition, then rank), so
    a length that most pieces share is not gathered anywhere.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = plan_patterns(counts, capacity)
    slots, first_sequence, used = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in plan:
        at = 0
        for length in pattern:
            slots.append((length, used[length], used[length] + times, first_sequence, at))
            used[length] += times
            at += length
        first_sequence += times
    # At most a few rows for each length and pattern: bounded by the histogram, not by the pieces.
    slot_rows = spark.createDataFrame(slots, "s_length long, s_from long, s_to long, s_sequence long, s_offset long")
    numbered = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1024)))
    totals = numbered.groupBy("length", "__salt").count()
    base = totals.select("length", "__salt", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = numbered.withColumn("__in", F.row_number().over(inner) - 1).join(base, ["length", "__salt"]).withColumn("__rank", F.col("__base") + F.col("__in"))
    # Rank ranges of a length are met block by block: both sides carry the block, so the join is an equi-join.
    block = max(256, max(counts.values(), default=1) // 4096)
    spans = slot_rows.withColumn("s_block", F.explode(F.sequence(F.floor(F.col("s_from") / block), F.floor((F.col("s_to") - 1) / block))))
    on = (F.col("length") == F.col("s_length")) & (F.floor(F.col("__rank") / block) == F.col("s_block")) & (F.col("__rank") >= F.col("s_from")) & (F.col("__rank") < F.col("s_to"))
    out = ranked.join(spans, on)
    return out.select(*pieces.columns, (F.col("s_sequence") + F.col("__rank") - F.col("s_from")).alias("sequence_id"), F.col("s_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    pieces = materialize(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return place(pieces, capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
