"""Line-first cleaning rules (operator 1), in DataFrame functions only.

Each line with a word is judged by rules on its punctuation, on navigation
marks and on boilerplate; failing lines are removed, and a document that loses
too much of its text with them is rejected.  The base figures of the contract
are computed beside this.  All work stays in the row: nothing is shuffled.

Defined results: a null or empty text has no words and no lines, fails the
base and isn't kept.  A text whose lines are all blank is like it.  Repeated
rows are judged alike.  An empty table gives no rows.  ``clean_lines`` keeps
all other columns and adds its own, starting with ``q_``, which replace columns
of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import let, words

#: Characters counted as symbols and as white space between words.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Phrases of site furniture; a short line with one of them is boilerplate.
BOILERPLATE = ("cookie", "javascript", "lorem ipsum", "all rights reserved", "privacy policy", "terms of use", "terms of service", "click here", "sign in", "log in", "subscribe to our", "share this", "skip to content")
WINDOW = 8


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated_words(word_list: Column, window: int = WINDOW) -> Column:
    """How many words stand in a run of ``window`` words that occurs twice or more in the list.

    Windows are compared by 64-bit hash.  Lists without a repeat, nearly all,
    end after one distinct count; otherwise windows are sorted with their
    places, so the work is n log n for any text.
    """

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        return F.aggregate(F.transform(places, lambda p, i: F.when(i == last, F.lit(window)).otherwise(F.least(F.lit(window), F.get(places, i + 1) - p))), F.lit(0), lambda a, b: a + b)

    def repeats(s: Column) -> Column:
        last = F.size(s) - 1
        again = F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == e["h"])))
        return let(F.sort_array(F.transform(again, lambda e: e["i"])), covered)

    def by_windows(g: Column) -> Column:
        placed = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.sort_array(placed), repeats))

    def by_words(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - window)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])), by_windows)

    return F.when(F.size(word_list) <= window, F.lit(0)).otherwise(let(F.transform(word_list, lambda w: F.xxhash64(w)), by_words)).cast("long")


def line_fails(line: Column, min_words: int = 4, max_symbols: float = 0.1, max_shouted: float = 0.5, max_separated: float = 0.3) -> Column:
    """Whether a line fails a rule.

    punctuation  under ``min_words`` words without a closing mark; or marks
                 such as ``!!`` on more than ``max_separated`` of its words.
    navigation   separators (``|``, arrows, bullets) beside more than
                 ``max_separated`` of its words, at least two.
    boilerplate  symbols on more than ``max_symbols`` of its words; more than
                 ``max_shouted`` of its letters in capitals, beyond three words;
                 a phrase of site furniture in a line of under 25 words.
    """

    def of_words(n: Column) -> Column:
        ends = F.rtrim(line).rlike(r"[.!?:;…。！？؟।][\"'”’»)\]]*$")
        doubled = F.size(F.regexp_extract_all(line, F.lit(r"[!?]{2,}"), F.lit(0)))
        separators = _count_of(line, "|»›→•·")
        letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
        capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
        low = F.lower(line)
        furniture = F.lit(False)
        for phrase in BOILERPLATE:
            furniture = furniture | low.contains(phrase)
        return (
            ((n < min_words) & ~ends)
            | (doubled > n * max_separated)
            | ((separators >= 2) & (separators > n * max_separated))
            | (_count_of(line, SYMBOLS) > n * max_symbols)
            | ((n > 3) & (capitals > letters * max_shouted))
            | ((n < 25) & furniture)
        )

    return let(F.size(words(line)), of_words)


def clean_lines(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """``docs`` with q_n_words, q_word_chars, q_n_symbols, q_n_dup_lines, q_n_repeat_words, q_text (kept lines), q_lost (share of characters on failing lines), q_base_failed and q_kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    judged = let(lines, lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"), F.filter(ls, lambda x: ~line_fails(x)).alias("kept"), F.aggregate(ls, F.lit(0), lambda a, x: a + F.length(x)).alias("chars")))
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"), judged.alias("l"), counted.alias("w"))
    text, kept_chars = F.col("t"), F.aggregate(F.col("l.kept"), F.lit(0), lambda a, x: a + F.length(x))
    own = {
        "q_n_words": F.col("w.n"),
        "q_word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "q_n_symbols": _count_of(text, SYMBOLS),
        "q_n_dup_lines": F.col("l.dup"),
        "q_n_repeat_words": F.col("w.repeated"),
        "q_text": F.array_join("l.kept", "\n"),
        "q_lost": F.when(F.col("l.chars") > 0, 1 - kept_chars / F.col("l.chars")).otherwise(F.lit(1.0)),
        "q_base_failed": (F.col("w.n") < 20) | (100 * F.col("w.repeated") > 30 * F.col("w.n")),
    }
    out = inner.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in own and c != "q_kept"], *[v.alias(k) for k, v in own.items()])
    return out.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_lost") <= max_lost))


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's figures for every document, with ``lost``."""
    out = clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost")
    return out.select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names])


