"""Stages with failures as values, in batches and on a stream that is stopped and started again."""

import pytest
from pyspark.sql import functions as F

from veritrail.sources.shared import fresh_path
from veritrail.streaming.stages import Stage, into, latest, outcome, process

SCHEMA = "k long, text string, state string"


def line(spark=None):
    counted = lambda due: due.where("text <> 'lost'").groupBy("k").agg(outcome(F.max(F.length("text")), F.when(F.max("text") == "bad", "unreadable")).alias("outcome"))
    return [
        Stage("fetch", outcome(F.col("text"), F.when(F.col("text").isNull(), "nothing there"), F.when(F.col("text") == "pdf", "no_page")), fatal=True), Stage("count", counted, ("fetch",)), Stage("guess", outcome(F.lit("?")), instead_of="count"),
        Stage("double", outcome(F.col("k") * 2), ("count",), when=F.col("k") < 10), Stage("check", outcome(error=F.when(F.col("text") == "worst", "refused")), ("fetch",), fatal=True), Stage("link", outcome(F.col("k"))),
    ]


def brief(df):
    return {r.k: (r.state, r.error, [s.stage for s in r.stages], list(r.warnings)) for r in df.collect()}


WANT = {
    1: ("processed", None, ["fetch", "count", "double", "check", "link"], []), 2: ("failed", "fetch: nothing there", [], []), 3: ("no_page", None, ["fetch"], []), 4: ("processed", None, ["fetch", "guess", "check", "link"], ["count: unreadable"]),
    5: ("processed", None, ["fetch", "guess", "check", "link"], ["count: no result"]), 6: ("failed", "check: refused", ["fetch", "count", "double"], []), 10: ("processed", None, ["fetch", "count", "check", "link"], []), 7: ("processed", None, ["fetch", "count", "double", "check", "link"], []),
}
ROWS = [(1, "abc", "x"), (2, None, None), (3, "pdf", "x"), (4, "bad", None), (5, "lost", None), (6, "worst", None), (10, "abc", None), (7, "", None)]


def test_failures_are_values(spark):
    assert brief(process(spark.createDataFrame(ROWS, SCHEMA), line(), "k")) == WANT
    assert process(spark.createDataFrame([], SCHEMA), line(), "k").count() == 0
    with pytest.raises(ValueError):
        process(spark.createDataFrame([], SCHEMA), [Stage("a", outcome(), needs=("b",))], "k")


def test_stream_goes_on_where_it_stopped_and_repeats_no_batch(spark):
    root = fresh_path(spark, "stages").removeprefix("file://")
    source, target, state = f"{root}/in", f"{root}/out", f"{root}/state"

    def drain():
        query = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(into(target, line, "k")).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(120)

    spark.createDataFrame(ROWS[:4] + ROWS[:1] + [(None, "a", None)], SCHEMA).coalesce(1).write.parquet(source)
    drain()
    spark.createDataFrame([*ROWS[4:], (2, "back", None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    drain()
    drain()
    want = WANT | {2: ("processed", None, ["fetch", "count", "double", "check", "link"], [])}
    assert brief(latest(spark, target, "k")) == want
    # A batch that is given again replaces its own rows.
    into(target, line, "k")(spark.createDataFrame(ROWS[4:], SCHEMA), 0)
    assert latest(spark, target, "k").where("batch = 0").count() == 0 and set(brief(latest(spark, target, "k"))) == {2, 5, 6, 7, 10}
