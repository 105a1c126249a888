"""Language identification by bit-sliced Bloom filters of n-grams (operator 2).

Fitting counts letter n-grams by language over a bounded sample of labelled
rows and keeps, for each n-gram, the set of languages in which it is usual.
The sets go into one table of bit masks, a bit for each language: a look-up
ANDs the ``HASHES`` slots of an n-gram and gives all languages that contain it
at once.  A text is judged by its per-language counts, each corrected for the
filter's own false-positive rate.

Defined results: a null text, or one without a letter, is ``und`` with score
0.  A text none of whose n-grams is known gets the language that is most
frequent in the sample, with score 0.  Ties go to the language first in
code-point order.  A language that is null is not learned from.  Without any
labelled row all texts are ``und``.  Texts of any length are read whole.
Repeated rows are judged alike.  An empty table gives no rows.  Other columns
are carried by ``identify``, whose own start with ``lid_`` and replace columns
of these names; ``judge_rows`` keeps both.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import Scratch

N = 4
HASHES = 3
_P = np.uint64(0x100000001B3)
_CHARS_AT_ONCE = 250_000
#: Slots of the filter, as powers of two: at least, and at most, whatever is learned.
_SLOT_BITS = (10, 21)


@cache
def _fold_table() -> np.ndarray:
    """Code point to lower-case letter (letters and marks), or 32."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
        elif c > 0x2FF and unicodedata.category(ch)[0] == "M":
            table[c] = c
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all letter n-grams of the texts, one after another, and where each text's begin (one more at the end).

    Runs of other characters count as one space, and a text begins and ends with one.
    """
    joined = " \x00 ".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    folded = np.where(codes == 0, np.uint32(0), _fold_table()[np.where(codes > 0x10FFFF, 32, codes)])
    spaces = folded == 32
    folded = folded[~(spaces & np.concatenate([[False], spaces[:-1]]))].astype(np.uint64)
    marks = np.flatnonzero(folded == 0)
    if len(folded) < N:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    count = len(folded) - N + 1
    h = np.zeros(count, dtype=np.uint64)
    clean = np.ones(count, dtype=bool)
    with np.errstate(over="ignore"):
        for k in range(N):
            h = h * _P + folded[k : k + count]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    for k in range(N):
        clean[np.clip(marks - k, 0, count - 1)] = False
    before = np.concatenate([[0], np.cumsum(clean)])
    starts = before[np.minimum(marks, count)]
    return h[clean], starts.astype(np.int64)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``_CHARS_AT_ONCE`` characters; a NUL in a text reads as a space."""
    first, some, size = 0, [], 0
    for i, text in enumerate(texts):
        some.append((text or "").replace("\x00", " "))
        size += len(some[-1])
        if size >= _CHARS_AT_ONCE:
            yield first, some
            first, some, size = i + 1, [], 0
    if some:
        yield first, some


class LanguageFilter:
    """Bit-sliced Bloom filter: ``table[word][slot]`` holds a bit for each language."""

    def __init__(self, languages: list[str], table: np.ndarray, fallback: str):
        self.languages, self.table, self.fallback = languages, table, fallback
        slots = table.shape[1]
        fills = [np.count_nonzero((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) / slots for i in range(len(languages))]
        self.false_rate = np.array([f**HASHES for f in fills])

    @staticmethod
    def _slot(h: np.ndarray, k: int, slot_bits: int) -> np.ndarray:
        return ((h >> np.uint64(21 * k)) & np.uint64((1 << slot_bits) - 1)).astype(np.int64)

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """(language, score, corrected number of the language's n-grams, number of n-grams) of each text."""
        out: list[tuple[str, float, float, int]] = []
        slot_bits = int(self.table.shape[1]).bit_length() - 1
        for _, some in _groups(texts):
            h, starts = grams(some)
            total = np.diff(starts)
            counts = np.zeros((len(some), len(self.languages)))
            slots = [self._slot(h, k, slot_bits) for k in range(HASHES)]
            for word in range(self.table.shape[0]):
                mask = self.table[word][slots[0]]
                for s in slots[1:]:
                    mask &= self.table[word][s]
                for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                    hit = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                    counts[:, i] = hit[starts[1:]] - hit[starts[:-1]]
            right = np.maximum(0.0, (counts - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate)) if len(self.languages) else counts
            for row, n, text in zip(right, total.tolist(), some, strict=True):
                if not self.languages or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0, 0.0, n))
                elif row.sum() <= 0:
                    out.append((self.fallback, 0.0, 0.0, n))
                else:
                    i = int(np.argmax(row))
                    out.append((self.languages[i], float(row[i] / row.sum()), min(float(n), float(row[i])), n))
        return out


def learn_grams(labelled: DataFrame, sample_per_language: int, usual: float) -> tuple[dict[str, int], DataFrame | None]:
    """Labelled rows by language, and (lang, gram): the n-grams that are usual in each language; see ``fit``."""
    from pyspark.sql import Window

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return sizes, None
    chosen = F.lit(False)
    for language, n in sizes.items():
        keep = F.pmod(F.xxhash64(F.lit("lid"), "doc_id"), F.lit(1_000_000)) < int(min(1.0, sample_per_language / n) * 1_000_000 + 0.5)
        chosen = chosen | ((F.col("lang") == language) & keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for _, some in _groups([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    h, n = np.unique(grams(some)[0].view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h), pa.array(n)], names=["lang", "gram", "n"])

    counted = rows.where(chosen).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counted.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    usual_in = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where((F.col("rate") >= usual * F.col("top")) & (F.col("n") >= 2))
    return sizes, usual_in.select("lang", "gram")


def fit(labelled: DataFrame, sample_per_language: int = 3_000, usual: float = 0.25) -> LanguageFilter:
    """A filter from rows of (doc_id, text, lang).

    ``sample_per_language`` bounds, in expectation, the rows read for each
    language; they are chosen by a hash of doc_id, so reruns agree.  An n-gram
    belongs to a language if it occurs there twice or more, at ``usual`` times
    its highest rate over languages or more.  All such n-grams go into the
    filter.  Its slots are filled by an aggregation, so what reaches the driver
    is the filter itself, at most 2**21 slots for each 64 languages: 16 MB.
    A filter of as many slots as it may have gets fuller with more n-grams,
    which the correction for its false-positive rate takes into account.
    """
    sizes, kept = learn_grams(labelled, sample_per_language, usual)
    if kept is None:
        return LanguageFilter([], np.zeros((1, 1 << _SLOT_BITS[0]), np.uint64), "und")
    languages = sorted(sizes)
    with Scratch(labelled.sparkSession) as scratch:
        kept = scratch.keep(kept, "usual-grams")
        most = max((r["count"] for r in kept.groupBy("lang").count().collect()), default=0)
        slot_bits = min(_SLOT_BITS[1], max(_SLOT_BITS[0], (8 * most).bit_length()))
        place = F.element_at(F.create_map(*[F.lit(x) for i, language in enumerate(languages) for x in (language, i)]), F.col("lang"))
        slots = [F.shiftrightunsigned("gram", 21 * k).bitwiseAND(F.lit((1 << slot_bits) - 1)) for k in range(HASHES)]
        filled = kept.select(F.floor(place / 64).alias("word"), _bit(place).alias("bit"), F.explode(F.array(*slots)).alias("slot"))
        found = filled.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    table = np.zeros((-(-len(languages) // 64), 1 << slot_bits), dtype=np.uint64)
    word, slot, mask = (found.column(name).to_numpy() for name in ("word", "slot", "mask"))
    table[word, slot] = mask.astype(np.int64).view(np.uint64)
    return LanguageFilter(languages, table, max(languages, key=lambda x: (sizes[x], x)))


def _bit(place: Column) -> Column:
    """The bit of a language's place in its word of 64."""
    return F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]), (F.pmod(place, F.lit(64)) + 1).cast("int"))


_FOUND = "struct<lang: string, score: double, cover: double, cover_high: double>"


def judge_rows(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """(row, lid): each row of ``docs`` as a struct, and lang, score, cover (the language's share of the n-grams) and cover_high (upper end of the share's Wilson interval at three standard deviations, which allows for short texts).

    The filter, of bounded size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.fallback))

    @F.arrow_udf(_FOUND)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mine = LanguageFilter(*shared.value)
        for texts in batches:
            names, scores, hits, n = zip(*mine.judge(texts.to_pylist()), strict=True) if len(texts) else ((), (), (), ())
            n = np.maximum(1, np.array(n, dtype=float))
            share, z2 = np.array(hits, dtype=float) / n, 9.0
            high = (share + z2 / (2 * n) + np.sqrt(z2 * share * (1 - share) / n + (z2 / (2 * n)) ** 2)) / (1 + z2 / n)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(share), pa.array(high)], names=["lang", "score", "cover", "cover_high"])

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), judge(F.col("text").cast("string")).alias("lid"))


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``docs`` with lid_lang, lid_score and lid_cover."""
    own = {f"lid_{n}": F.col(f"lid.{n}").alias(f"lid_{n}") for n in ("lang", "score", "cover")}
    return judge_rows(docs, model).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in own], *own.values())


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document: doc_id, held_out, lang_pred, score, cover."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out("doc_id")).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"), F.col("lid_cover").alias("cover"))
