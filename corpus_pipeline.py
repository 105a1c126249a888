"""Corpus pipeline: five stages, each written as Parquet and read again by the next.

Each stage works on all rows that its predecessor kept and returns the columns
of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import materialize
from veritrail.llm.language_id import fit, judge_rows
from veritrail.llm.mixing import training_rows
from veritrail.llm.near_dup import near_duplicates
from veritrail.llm.packing import pack_documents
from veritrail.llm.repeats import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without letters go, and those of which surely under a fifth of the n-grams is known (the share's upper bound, so short texts need more proof)."""
    judged = judge_rows(docs, fit(docs.select("doc_id", "text", "lang")))
    return judged.where((F.col("lid.lang") != "und") & (F.col("lid.cover_high") >= 0.2)).select("row.*")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more), and one of rows that share doc_id and text; rows without doc_id link nothing and stay."""
    kept = near_duplicates(docs.select("doc_id", "text"), percent=80, text_key=True).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_text")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_text"))
    stay = rows.join(kept.hint("merge"), (F.col("own_id") == F.col("kept_id")) & (F.col("own_text") == F.col("kept_text")), "left_semi").dropDuplicates(["own_id", "own_text"])
    return stay.unionByName(rows.where(F.col("own_id").isNull())).select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 400 bytes or of over 50 words that repeat anywhere, and n_chars to match; documents left without a word go."""
    cut = remove_repeats(docs, with_text=True, words=51).where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    out = cut.select(*[columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return training_rows(docs).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dup", near_dup),
    ("repeats", repeats),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Hash signatures, Bloom filters and best fit have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
