"""Mixing sources to target weights on a time-varying curriculum (operator 10).

Target: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share ``budget`` times all words; no target passes ``max_epochs`` times its
source's size, and what is cut off is shared again by weight among the rest,
until none is above.

Positions: each source has a piecewise-linear weight schedule over training
time 0..1.  Its integral, scaled to the source's target, is the source's
cumulative demand; the word at demand c is trained at the time the demand
reaches c.  A source's documents lie one after another in an order given by
hash, epoch after epoch, until its target is used up, so the last document may
be taken in part.

Defined results: a null text has size 0 and takes 0.  A null source is a
source of its own.  A source of size 0 has target 0.  Repeated rows and ids
each count; rows that are equal in doc_id and text take their places side by
side.  An empty table gives no rows.  Other columns are carried by ``mix`` and
ignored by the query; the operator's own start with ``mix_`` and replace
columns of such names, which only ``training_rows`` keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import Scratch, materialize, words

#: Fixed value: the weights of the contract, repeating over the sources in order.
WEIGHTS = (5, 2, 1)
#: Schedules by the source's place, repeating: weights at even steps from time 0 to time 1, linear between.
SCHEDULES = ((1.0, 1.0, 1.0), (0.2, 1.0, 1.8), (1.8, 1.0, 0.2))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, max_epochs: float) -> DataFrame:
    """(source, source_size) to (source, source_size, place, weight, target): water-filling in closed form.

    With sources sorted by cap / weight, all up to some place are capped and
    the others share what is left by weight.  One row a source, so the sorted
    window over all of them stays small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    base = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ratio = F.col("cap") / F.col("weight")
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy(ratio, "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("want") - F.col("capped_before")) / (F.col("weight_all") - F.col("weight_before"))
    filled = (
        base.withColumn("want", F.least(F.sum("source_size").over(everything) * F.lit(float(budget)), F.sum("cap").over(everything)))
        .withColumn("weight_all", F.sum("weight").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", level)
    )
    # The water level is that of the first source, in order, that stays under its cap.
    found = filled.withColumn("free_level", F.min(F.when(ratio > F.col("level"), F.struct(ratio.alias("r"), F.col("place").alias("p"), F.col("level").alias("l")))).over(everything)["l"])
    target = F.when(F.col("free_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("free_level")))
    return found.select("source", "source_size", "place", "weight", target.alias("target"))


def demand_time(share: Column, schedule: Column, steps: int) -> Column:
    """The time at which the schedule's integral reaches ``share`` (0 to 1) of the whole: the inverse of a piecewise quadratic."""
    step = 1.0 / steps
    areas = [(schedule[i] + schedule[i + 1]) * (step / 2) for i in range(steps)]
    total = sum(areas[1:], areas[0])
    want = share * total
    before, out = F.lit(0.0), F.lit(1.0)
    pieces = []
    for i in range(steps):
        rest = want - before
        slope = (schedule[i + 1] - schedule[i]) / step
        root = F.sqrt(F.greatest(schedule[i] * schedule[i] + 2 * slope * rest, F.lit(0.0)))
        # 2c / (b + sqrt(b^2 + 2ac)): stable where the slope is 0
        pieces.append((before + areas[i], F.lit(i * step) + F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (schedule[i] + root))))
        before = before + areas[i]
    for end, at in reversed(pieces):
        out = F.when(want <= end, F.least(at, F.lit(1.0))).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, max_epochs: int = 2, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, buckets: int = 1024, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with mix_size, mix_source_size, mix_target, mix_before (words of the source before the document), mix_taken and mix_position.

    Sums in document order use two levels: ``buckets`` runs of the hash order
    for each source, so a source with any share of the rows is summed by many
    tasks.  The rows are dealt once, by source and run.
    """
    sized = docs.select(*(carry or [F.col(f"`{c}`") for c in docs.columns if not c.startswith("mix_")]), F.size(words(F.col("text"))).cast("long").alias("mix_size"), F.xxhash64(F.lit("mix"), "doc_id", "text").alias("mix_key"), F.xxhash64("text").alias("mix_tie"))
    sized = sized.withColumn("mix_bucket", F.shiftrightunsigned(F.col("mix_key"), 64 - (buckets - 1).bit_length()).cast("int"))
    sized = materialize(sized, "mix-sized")
    runs = materialize(sized.groupBy("source", "mix_bucket").agg(F.sum("mix_size").alias("run_size")), "mix-runs")
    sizes = runs.groupBy("source").agg(F.sum("run_size").alias("source_size"))
    targets = source_targets(sizes, weights, budget, max_epochs)
    bases = runs.select(F.col("source").alias("b_source"), F.col("mix_bucket").alias("b_bucket"), F.coalesce(F.sum("run_size").over(Window.partitionBy("source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b_base"))
    kept = targets.join(bases, F.col("source").eqNullSafe(F.col("b_source"))).select("b_source", "b_bucket", "b_base", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("place").alias("mix_place"))
    inner = Window.partitionBy("source", "mix_bucket").orderBy("mix_key", "mix_tie", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("mix_run", F.coalesce(F.sum("mix_size").over(inner), F.lit(0))).join(kept, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("mix_bucket") == F.col("b_bucket")))
    before = F.col("b_base") + F.col("mix_run")
    whole = F.floor(F.col("mix_target") + F.lit(1e-6)).cast("long")
    taken = F.lit(0).cast("long")
    for epoch in range(max_epochs):
        taken = taken + F.greatest(F.lit(0), F.least(F.col("mix_size"), whole - epoch * F.col("mix_source_size") - F.col("mix_before")))
    schedule = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules]), (F.pmod(F.col("mix_place"), F.lit(len(schedules))) + 1).cast("int"))
    position = demand_time(F.col("mix_before") / F.greatest(F.col("mix_target"), F.lit(1.0)), schedule, len(schedules[0]) - 1)
    return placed.withColumn("mix_before", before).withColumn("mix_taken", taken).withColumn("mix_position", F.when(F.col("mix_taken") > 0, position)).drop("mix_key", "mix_tie", "mix_bucket", "mix_run", "b_source", "b_bucket", "b_base")


def training_copies(mixed: DataFrame, max_epochs: int = 2, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """One row for each time a document is trained, with mix_epoch and mix_position.

    A document counts for an epoch when the demand passes its middle, so each
    source's words stay within one document of its target.
    """
    middle = F.col("mix_before") + F.col("mix_size") / 2
    copies = mixed.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("__at", F.col("mix_epoch") * F.col("mix_source_size") + F.col("mix_before")).where((F.col("mix_size") > 0) & (F.col("mix_epoch") * F.col("mix_source_size") + middle <= F.col("mix_target")))
    schedule = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules]), (F.pmod(F.col("mix_place"), F.lit(len(schedules))) + 1).cast("int"))
    return copies.withColumn("mix_position", demand_time(F.col("__at") / F.greatest(F.col("mix_target"), F.lit(1.0)), schedule, len(schedules[0]) - 1)).drop("__at")


def training_rows(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(row, mix_position): the rows of ``docs``, as structs, as often as the mix takes them, range-sorted by position.

    Places are worked out on narrow rows; texts are dealt twice only, to meet
    their places and to be sorted.  Rows that are equal in all columns share
    their places: one of them stands for all.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), "doc_id", "source", "text", F.xxhash64(F.lit(1), *columns).alias("mix_r1"), F.xxhash64(*columns, F.lit(2)).alias("mix_r2"))
    places = training_copies(mix(keyed, carry=["mix_r1", "mix_r2", "doc_id", "source"])).groupBy("mix_r1", "mix_r2").agg(F.collect_list("mix_position").alias("mix_positions"))
    met = keyed.select("row", "doc_id", "mix_r1", "mix_r2").join(places.hint("merge"), ["mix_r1", "mix_r2"])
    one = met.withColumn("mix_n", F.row_number().over(Window.partitionBy("mix_r1", "mix_r2").orderBy("mix_r1"))).where("mix_n = 1")
    timed = one.select("row", "doc_id", F.explode("mix_positions").alias("mix_position"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return timed.repartitionByRange(parts, "mix_position", "doc_id").sortWithinPartitions("mix_position", "doc_id").select("row", "mix_position")


def training_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``docs`` as often as the mix takes them, with mix_position, range-sorted by it."""
    return training_rows(docs, parts).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "mix_position"], "mix_position")


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix, range-sorted by position: doc_id, size, source_size, target, taken, source, position."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), carry=["doc_id", "source"])
    out = mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), "source", F.col("mix_position").alias("position"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    # Written first, so that sampling for the ranges reads narrow rows and does not mix again.
    with Scratch(spark) as scratch:
        ranged = scratch.keep(out, "mixed").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        return materialize(ranged, "mixed")
