"""Frame streams: content dedup across polls and restarts, event-time retention, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_untrusted(frames: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Frames with a readable time of enough confidence, and the others with the reason; nothing is dropped silently."""
    good = F.coalesce(F.col("frame_ts").isNotNull() & (F.col("confidence") >= least), F.lit(False))
    reason = F.when(F.col("frame_ts").isNull(), "unreadable_time").otherwise("low_confidence")
    return frames.where(good), frames.where(~good).withColumn("reason", reason)


def first_sight(frames: DataFrame, keep: str = "6 hours") -> DataFrame:
    """Each content once within the retention; on a stream the state survives restarts with the checkpoint."""
    if frames.isStreaming:
        return frames.withWatermark("frame_ts", keep).dropDuplicatesWithinWatermark(["frame_sha"])
    return frames.groupBy("frame_sha").agg(F.min(F.struct("frame_ts", *[c for c in frames.columns if c not in ("frame_ts", "frame_sha")])).alias("r")).select("frame_sha", "r.*")


def retained(frames: DataFrame, hours: int = 6) -> DataFrame:
    """Batch form of the rolling window: frames newer than the newest one less ``hours``."""
    newest = frames.agg(F.max("frame_ts").alias("__newest"))
    return frames.crossJoin(F.broadcast(newest)).where(F.col("frame_ts") > F.col("__newest") - F.make_interval(hours=F.lit(hours))).drop("__newest")


def cycle_counts(frames: DataFrame, least: float, window: str = "10 minutes") -> DataFrame:
    """(cycle, frames, contents, repeats, rejected, oldest, newest) of each poll cycle of a batch of frames, with exact counts; on a stream, call it from ``foreachBatch``."""
    good = F.coalesce(F.col("confidence") >= least, F.lit(False))
    contents = F.countDistinct(F.when(good, F.col("frame_sha")))
    sums = frames.groupBy(F.window("polled_at", window).alias("cycle")).agg(F.count(F.lit(1)).alias("frames"), contents.alias("contents"), (F.count(F.when(good, F.lit(1))) - contents).alias("repeats"), F.count(F.when(~good, F.lit(1))).alias("rejected"), F.min(F.when(good, F.col("frame_ts"))).alias("oldest"), F.max(F.when(good, F.col("frame_ts"))).alias("newest"))
    return sums
