"""Documents through a row of stages, where a failure is a value: each document carries what every stage gave or why it did not.

A stage sees only documents that are still under way and whose needed stages
succeeded.  A fatal failure ends a document as ``failed``, any other leaves a
warning and lets later stages go on; a stage may also end a document on
purpose, or stand in for another that failed.  One document never stops the
rest of its batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.sources.shared import written

_DONE = "array<struct<stage: string, result: string>>"


@dataclass(frozen=True)
class Stage:
    """``work`` is a Column of ``outcome`` or a function from the documents due to rows (key, outcome); a document without a row fails with ``no result``."""

    name: str
    work: Column | Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    #: Runs only for documents where this stage failed.
    instead_of: str | None = None
    when: Column | None = None
    fatal: bool = False


def outcome(result: Column | None = None, error: Column | None = None, ends: Column | None = None) -> Column:
    """What a stage gives for a document: a result, or an error (then the result does not count); ``ends`` names the state in which the document ends here."""
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(text(result).alias("result"), text(error).alias("error"), text(ends).alias("ends"))


def process(documents: DataFrame, stages: Iterable[Stage], key: str, last: str = "processed") -> DataFrame:
    """``documents`` with state, error, stages (stage, result) and warnings.

    ``key`` is a document's own and not null; columns of those names are
    replaced.  An empty table gives an empty one.  What a joined stage gave is
    written before the next one, so a lost executor repeats one stage.
    """
    out = documents.drop("state", "error", "stages", "warnings", "__failed", "__o", "__due")
    out = out.select("*", F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("error"), F.expr(f"CAST(array() AS {_DONE})").alias("stages"), F.expr("CAST(array() AS array<string>)").alias("warnings"), F.expr("CAST(array() AS array<string>)").alias("__failed"))
    names: list[str] = []
    for stage in stages:
        unknown = {*stage.needs, *filter(None, [stage.instead_of])} - {*names}
        if unknown or stage.name in names:
            raise ValueError(f"stage {stage.name} is named twice or rests on later stages: {sorted(unknown)}")
        due = F.col("state").isNull()
        for need in stage.needs:
            due = due & F.array_contains(F.col("stages")["stage"], need)
        if stage.instead_of:
            due = due & F.array_contains("__failed", stage.instead_of)
        if stage.when is not None:
            due = due & F.coalesce(stage.when, F.lit(False))
        out = out.withColumn("__due", due)
        if callable(stage.work) and not isinstance(stage.work, Column):
            given = stage.work(out.where("__due").drop("__due", "__failed")).select(key, F.col("outcome").alias("__o"))
            out = out.join(given, key, "left").withColumn("__o", F.coalesce("__o", outcome(error=F.lit("no result"))))
        else:
            out = out.withColumn("__o", stage.work)
        failed, ran = F.col("__due") & F.col("__o.error").isNotNull(), F.col("__due") & F.col("__o.error").isNull()
        ended = F.when(failed & F.lit(stage.fatal), "failed").when(ran, F.col("__o.ends"))
        note = F.concat(F.lit(f"{stage.name}: "), F.col("__o.error"))
        none = F.expr("CAST(array() AS array<string>)")
        out = out.withColumns({
            "stages": F.concat("stages", F.when(ran, F.array(F.struct(F.lit(stage.name).alias("stage"), F.col("__o.result").alias("result")))).otherwise(F.expr(f"CAST(array() AS {_DONE})"))),
            "warnings": F.concat("warnings", F.when(failed & ~F.lit(stage.fatal), F.array(note)).otherwise(none)), "__failed": F.concat("__failed", F.when(failed, F.array(F.lit(stage.name))).otherwise(none)),
            "error": F.coalesce("error", F.when(failed & F.lit(stage.fatal), note)), "state": F.coalesce("state", ended),
        }).drop("__o", "__due")
        if callable(stage.work) and not isinstance(stage.work, Column):
            out = written(out, f"stage-{stage.name}")
        names.append(stage.name)
    return out.withColumn("state", F.coalesce("state", F.lit(last))).drop("__failed")


def into(path: str, stages: Callable[[SparkSession], Iterable[Stage]], key: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: processes a batch and puts its rows in a folder of its own, which a repeated batch replaces.

    A document that a batch holds several times counts once, any one of its rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        once = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        process(once, stages(batch.sparkSession), key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Each document as its last batch left it."""
    newest = Window.partitionBy(key).orderBy(F.desc("batch"))
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
