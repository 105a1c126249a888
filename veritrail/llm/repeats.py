"""Removing repeated passages by prefix-free parsing (operator 3).

A byte goes when a string of ``WIDTH`` bytes that covers it also starts
anywhere else in the corpus.  Which strings repeat is the question a suffix
array answers with neighbours of common prefix ``WIDTH`` or more; here the
order is built piecewise, so that no task holds a corpus.

Parsing: the trigger of a window is the place, among the windows's ``GRAM``-byte
rolling hashes, of the least one (the first, on ties).  It depends on the
window's bytes alone, so equal windows have equal triggers at equal places.
Consecutive windows with one trigger make a *phrase*: the bytes from the first
window's start to the last one's end.  The dictionary holds distinct phrases,
the parse their occurrences.

Combining: a window's rank in corpus order is decided by its phrase and its
place in it.  Three levels settle equality, coarse to fine, each by grouping
hashes of 128 bits with map-side counts:

1. phrases that occur again whole repeat in all their windows; phrases whose
   trigger gram occurs once repeat in none;
2. what is left, with one representative of each repeated phrase that shares a
   gram with it, falls into *cells* of ``CELL`` windows, numbered from the
   trigger: a cell's windows all repeat if their union does, none if the bytes
   common to them don't;
3. in the remaining cells each window is hashed by itself.

Groups are only ever counted, never gathered; repeated windows of a text are
gathered as one bit each.  Texts longer than ``SEGMENT``
are parsed in segments, which may split a phrase but changes no result.

``remove_repeats`` with ``words`` also takes every passage of that many words,
however few bytes they are: the same search over the texts' words, each as a
code of ``CODE`` bytes, adds its spans to those over the bytes.

Defined results: a null or empty text has 0 bytes and the hash of nothing.
Texts under ``WIDTH`` bytes keep everything.  Repeated rows (also of one
doc_id) repeat each other.  A null doc_id is kept.  An empty table gives no
rows.  Cuts may fall inside a multi-byte character; ``remove_repeats`` with
``with_text`` drops the broken rest of such a character.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import Scratch, materialize

WIDTH, GRAM, CELL, SEGMENT = 400, 64, 16, 1 << 19
#: Bytes of a word's code.  Windows that start inside a code are equal only if the words about its ends are, or by a clash of 64 bits, so spans are narrowed to whole words.
CODE = 8
_U = np.uint64
_LOW = _U((1 << 20) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ID = ["rid1", "rid2"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordCodes(dict):
    """64-bit codes of words; emptied when it holds 200,000."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@dataclass(frozen=True)
class Windows:
    """Windows of ``width`` bytes of texts or, with ``words``, of the codes of their words."""

    width: int = WIDTH
    words: bool = False

    def data(self, raw: pa.Buffer, memo: dict) -> np.ndarray:
        if not self.words:
            return np.frombuffer(raw, dtype=np.uint8)
        found = raw.to_pybytes().split()
        return np.fromiter(map(memo.__getitem__, found), dtype="<u8", count=len(found)).view(np.uint8)


class _Hasher:
    """Hashes of any stretch of a byte string, from prefix sums; all arithmetic is modulo 2**64."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        size = SEGMENT + 2 * width + 1
        self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407))
        self.power, self.inverse = [], []
        for base in _BASES:
            inverse = pow(base, -1, 1 << 64)
            for table, value in ((self.power, base), (self.inverse, inverse)):
                run = np.full(size, _U(value))
                run[0] = 1
                table.append(np.multiply.accumulate(run))

    def prefix(self, data: np.ndarray) -> list[np.ndarray]:
        codes = self.byte[data]
        return [np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * p[: len(codes)])]) for p in self.power]

    def stretch(self, prefix: list[np.ndarray], start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of each [start, end) with a salt and the length."""
        extra = _mix((end - start).astype(np.uint64) * _U(0x2545F4914F6CDD1D) + salt.astype(np.uint64))
        return [_mix((h[end] - h[start]) * inv[start] + extra) for h, inv in zip(prefix, self.inverse, strict=True)]

    def grams(self, data: np.ndarray) -> np.ndarray:
        """Rolling hash of the ``GRAM`` bytes from each place."""
        h, width = self.byte[data], 1
        while width < GRAM:
            h = _mix(h[: len(h) - width] * _U(_BASES[0]) + h[width:])
            width *= 2
        return h


def _triggers(grams: np.ndarray, windows: int, width_of_window: int) -> np.ndarray:
    """For each window start, the place of the least gram of the window, the first on ties."""
    span = width_of_window - GRAM + 1
    low = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = span - width
    return (np.minimum(low[:windows], low[rest : rest + windows]) & _LOW).astype(np.int64)


def _phrases(data: np.ndarray, hasher: _Hasher) -> Iterator[tuple[np.ndarray, ...]]:
    """(trigger, first, last, gram hash, phrase hashes) of the phrases, by segment."""
    width = hasher.width
    for base in range(0, max(0, len(data) - width + 1), SEGMENT):
        part = data[base : base + SEGMENT + width - 1]
        windows = len(part) - width + 1
        grams = hasher.grams(part)
        at = _triggers(grams, windows, width)
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts - 1, [windows - 1]])
        trigger = at[first]
        h1, h2 = hasher.stretch(hasher.prefix(part), first, last + width, trigger - first)
        yield trigger + base, first + base, last + base, grams[trigger], h1, h2


_ITEM = "rid1 long, rid2 long, trigger int, first int, last int, part long, whole1 long, whole2 long"
_NAMES = [x.split()[0] for x in _ITEM.split(", ")]


def _batch(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    kinds = [np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64, np.int64]
    columns = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, k) for i, k in enumerate(kinds)]
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def parse(base: DataFrame, kind: Windows) -> DataFrame:
    """Every phrase occurrence of ``base`` (rid1, rid2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, memo = _Hasher(kind.width), _WordCodes()
        with np.errstate(over="ignore"):
            for batch in batches:
                rows: list[tuple[np.ndarray, ...]] = []
                size = 0
                texts = batch.column(2).cast(pa.binary())
                for i in range(batch.num_rows):
                    raw = texts[i].as_buffer()
                    data = None if raw is None else kind.data(raw, memo)
                    if data is None or len(data) < kind.width:
                        continue
                    for found in _phrases(data, hasher):
                        n = len(found[0])
                        ids = [np.full(n, batch.column(k)[i].as_py(), dtype=np.int64) for k in (0, 1)]
                        rows.append((*ids, *found))
                        size += n
                    if size > 50_000:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return base.select(*_ID, "text").mapInArrow(run, _ITEM)


def settle(items: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """``items`` (as of ``parse``) that may repeat, with ``repeats`` (the whole occurs again) and ``open`` (to be looked into).

    ``part`` is a hash of bytes that all of the item's windows share: where it
    occurs once, nothing repeats.  Where all items of a part are one whole,
    all is settled.  Otherwise items that don't repeat whole are open, and so
    is one item of each whole that does.  ``whole1`` is null for an item that
    can't be compared whole.
    """
    # Counts are written before they are joined, so that the join's sides are plain exchanges, whose hot keys adaptive execution splits.
    parts = items.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("whole1").alias("n_whole"), F.min("whole1").alias("low"), F.max("whole1").alias("high")).where("n > 1").select("part", ((F.col("n_whole") < F.col("n")) | (F.col("low") != F.col("high"))).alias("mixed"))
    shared = scratch.keep(items.join(scratch.keep(parts, f"{name}-parts"), "part"), name)
    place = F.struct(*_ID, "trigger", "first")
    wholes = shared.where(F.col("whole1").isNotNull()).groupBy("whole1", "whole2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("head")).where("n > 1")
    wholes = scratch.keep(wholes, f"{name}-wholes")
    out = shared.join(wholes, ["whole1", "whole2"], "left").withColumn("repeats", F.col("n").isNotNull())
    return out.withColumn("open", F.col("mixed") & (~F.col("repeats") | (F.col("head") == place))).select(*_ID, "trigger", "first", "last", "repeats", "open")


def _per_text(found: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """``base`` rows with the list of their items; only one text's items are gathered."""
    lists = found.groupBy(*_ID).agg(F.collect_set(F.struct(*columns)).alias("items"))
    return base.select(*_ID, "text").join(lists, _ID).select(*_ID, "text", "items")


def _within(items: list[dict], data: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Items (trigger, first, last) in groups that lie within one segment, with its start and bytes."""
    rows = np.array(sorted((x["first"], x["last"], x["trigger"]) for x in items), dtype=np.int64)
    at = 0
    while at < len(rows):
        start = rows[at, 0]
        end = at + int(np.searchsorted(rows[at:, 0], start + SEGMENT - width))
        group = rows[at:end]
        yield group, int(start), data[start : int(group[:, 1].max()) + width]
        at = end


def cells(open_items: DataFrame, base: DataFrame, kind: Windows) -> DataFrame:
    """Cells of open phrases, as items: ``part`` hashes the bytes common to the cell's windows, ``whole`` their union (null unless the phrase has all of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, memo = _Hasher(kind.width), _WordCodes()
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = batch.column(2).cast(pa.binary())
                for i in range(batch.num_rows):
                    data = kind.data(texts[i].as_buffer(), memo)
                    rows = []
                    for group, start, part in _within(batch.column(3)[i].as_py(), data, kind.width):
                        first, last, trigger = (group - start).T
                        low, high = (trigger - last) // CELL, (trigger - first) // CELL
                        n = high - low + 1
                        which = np.repeat(np.arange(len(group)), n)
                        cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
                        t = trigger[which]
                        full_first, full_last = t - CELL * cell - CELL + 1, t - CELL * cell
                        own_first, own_last = np.maximum(full_first, first[which]), np.minimum(full_last, last[which])
                        prefix = hasher.prefix(part)
                        shared = hasher.stretch(prefix, full_last, full_first + kind.width, cell + 1)[0]
                        w1, w2 = hasher.stretch(prefix, own_first, own_last + kind.width, cell + 1)
                        whole = (own_first == full_first) & (own_last == full_last)
                        rows.append((t + start, own_first + start, own_last + start, shared, w1, w2, whole))
                    total = [np.concatenate([r[k] for r in rows]) for k in range(7)]
                    n = len(total[0])
                    ids = [pa.array(np.full(n, batch.column(k)[i].as_py(), dtype=np.int64)) for k in (0, 1)]
                    hashes = [pa.array(total[3].view(np.int64)), *(pa.array(total[k].view(np.int64), mask=~total[6]) for k in (4, 5))]
                    yield pa.RecordBatch.from_arrays([*ids, *(pa.array(total[k].astype(np.int32)) for k in range(3)), *hashes], names=_NAMES)

    return _per_text(open_items, base, ["trigger", "first", "last"]).mapInArrow(run, _ITEM)


def windows(open_cells: DataFrame, base: DataFrame, kind: Windows) -> DataFrame:
    """(rid1, rid2, first, h1, h2) of every window of open cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, memo = _Hasher(kind.width), _WordCodes()
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = batch.column(2).cast(pa.binary())
                for i in range(batch.num_rows):
                    data = kind.data(texts[i].as_buffer(), memo)
                    for group, start, part in _within(batch.column(3)[i].as_py(), data, kind.width):
                        n = group[:, 1] - group[:, 0] + 1
                        first = np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(group[:, 0] - start, n))
                        h1, h2 = hasher.stretch(hasher.prefix(part), first, first + kind.width, np.zeros(len(first), np.int64))
                        ids = [pa.array(np.full(len(first), batch.column(k)[i].as_py(), dtype=np.int64)) for k in (0, 1)]
                        yield pa.RecordBatch.from_arrays([*ids, pa.array((first + start).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=[*_ID, "first", "h1", "h2"])

    return _per_text(open_cells, base, ["trigger", "first", "last"]).mapInArrow(run, "rid1 long, rid2 long, first int, h1 long, h2 long")


def repeated_spans(base: DataFrame, kind: Windows, scratch: Scratch) -> DataFrame:
    """(rid1, rid2, start, end, mask) of stretches of ``base`` (rid1, rid2, text) whose windows all occur elsewhere; stretches may overlap.

    With a ``mask``, ``end`` is null and bit k stands for the window that starts ``k`` after ``start``.
    """
    phrases = scratch.keep(settle(scratch.keep(parse(base, kind), "phrases"), "phrases-shared", scratch), "phrases-settled")
    found = scratch.keep(settle(scratch.keep(cells(phrases.where("open"), base, kind), "cells"), "cells-shared", scratch), "cells-settled")
    single = scratch.keep(windows(found.where("open"), base, kind), "windows")
    again = scratch.keep(single.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "windows-again")
    bit = F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]), F.col("first") % 64 + 1)
    lone = single.join(again.hint("merge"), ["h1", "h2"], "left_semi").groupBy(*_ID, F.floor(F.col("first") / 64).alias("block")).agg(F.bit_or(bit).alias("mask"))
    lone = lone.select(*_ID, (F.col("block") * 64).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "mask")
    whole = phrases.union(found).where("repeats").select(*_ID, F.col("first").alias("start"), (F.col("last") + kind.width).alias("end"), F.lit(None).cast("long").alias("mask"))
    return whole.union(lone)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _stretches(spans: list[dict], width: int) -> Iterator[tuple[int, int]]:
    """(start, end) of spans, runs of windows in a mask as one."""
    for x in spans:
        if x["mask"] is None:
            yield x["start"], x["end"]
        else:
            for run in re.finditer("1+", f"{x['mask'] & (1 << 64) - 1:064b}"[::-1]):
                yield x["start"] + run.start(), x["start"] + run.end() - 1 + width


def _in_bytes(spans: list[dict], raw: bytes, words: int | None) -> Iterator[tuple[int, int]]:
    """Spans of a text; those over codes of words, from the first whole word's start to the last one's end."""
    yield from _stretches([x for x in spans if not x.get("words")], WIDTH)
    if coded := [x for x in spans if x.get("words")]:
        places = [m.span() for m in _WORD.finditer(raw)]
        for start, end in _stretches(coded, words * CODE):
            if (first := -(-start // CODE)) < (after := end // CODE):
                yield places[first][0], places[after - 1][1]


def cut(texts: DataFrame, with_text: bool, words: int | None) -> DataFrame:
    """Contract columns from rows (doc_id, rest, text, spans); ``words`` is the length of the spans over words; ``with_text`` adds ``rest`` and the kept bytes as text."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += f", kept_text string, rest {texts.schema['rest'].dataType.simpleString()}"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = raw or b""
                at, removed, count, kept = 0, 0, 0, []
                end = -1
                for a, b in sorted(_in_bytes(spans or [], raw, words)):
                    if a > end:
                        count += 1
                        kept.append(raw[at:a])
                        removed += b - a
                        at = end = b
                    elif b > end:
                        removed += b - end
                        at = end = b
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((len(raw), removed, count, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [batch.column(0), *(pa.array(columns[k], pa.int64()) for k in range(3)), *(pa.array(columns[k], pa.string()) for k in range(3, 5 if with_text else 4)), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    return texts.select("doc_id", "text", "spans", *(["rest"] if with_text else [])).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, with_text: bool = False, words: int | None = None) -> DataFrame:
    """The contract's columns for each row of ``docs`` (doc_id, text); ``with_text`` adds kept_text and ``rest``, a struct of the row's other columns.

    With ``words``, passages of that many words that occur elsewhere go too, from the first word to the last.

    Texts are needed where their items are, three times; so they are written
    once as a table bucketed by row id.
    """
    if words is not None and words * CODE < GRAM:
        raise ValueError(f"windows are of {GRAM // CODE} words or more")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(F.lit(0).alias("__row"), *others).alias("rest")] if with_text else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *rest, F.xxhash64(F.lit(1), "doc_id", text).alias("rid1"), F.xxhash64(text, "doc_id", F.lit(2)).alias("rid2"))
    with Scratch(spark) as scratch:
        base = scratch.bucketed(rows, "texts", parts, _ID)
        found, place = repeated_spans(base, Windows(), scratch), ["start", "end", "mask"]
        if words is not None:
            place.append("words")
            found = found.withColumn("words", F.lit(False)).union(repeated_spans(base, Windows(words * CODE, words=True), scratch).withColumn("words", F.lit(True)))
        spans = found.groupBy(*_ID).agg(F.collect_set(F.struct(*place)).alias("spans"))
        return materialize(cut(base.join(spans.hint("merge"), _ID, "left"), with_text, words), "cut")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when passages repeated anywhere are removed: the contract's columns and ``text``, the kept bytes."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_text=True)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))
