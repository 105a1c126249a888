"""Work-queue states as set operations on a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import backoff_seconds


def eligible(queue: DataFrame, now: Column) -> DataFrame:
    """Items that may be claimed: pending, done or failed, and due."""
    return queue.where(F.col("status").isin("pending", "done", "error") & (F.col("due").isNull() | (F.col("due") <= now)))


def head(queue: DataFrame, now: Column, k: int) -> DataFrame:
    """The next ``k`` items: indexes first, then by depth, due time and first sight."""
    return eligible(queue, now).orderBy(F.when(F.col("item_type") == "index", 0).otherwise(1), "depth", F.col("due").asc_nulls_first(), "first_seen", "url").limit(k)


def advance(queue: DataFrame, outcomes: DataFrame, now: Column, refresh: int = 604_800, base: int = 60, most: int = 21_600) -> DataFrame:
    """The queue after ``outcomes`` (url, ok): done items are due after ``refresh`` seconds, failed ones after a backoff; others stay."""
    joined = queue.join(outcomes, "url", "left")
    wait = F.when(F.col("ok"), F.lit(refresh)).otherwise(backoff_seconds(F.col("attempts"), base, most))
    return joined.select(
        *[c for c in queue.columns if c not in ("status", "due", "attempts")],
        F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "done").otherwise("error").alias("status"),
        F.when(F.col("ok").isNull(), F.col("due")).otherwise(F.timestamp_seconds(F.unix_timestamp(now) + wait)).alias("due"),
        F.when(F.col("ok").isNull(), F.col("attempts")).otherwise(F.col("attempts") + 1).alias("attempts"),
    )


def fail_stale(queue: DataFrame, now: Column, limit: int) -> DataFrame:
    """Items running longer than ``limit`` seconds become failed and due."""
    stale = (F.col("status") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("started") > limit)
    return queue.withColumn("due", F.when(stale, now).otherwise(F.col("due"))).withColumn("status", F.when(stale, "error").otherwise(F.col("status")))


def enqueue(queue: DataFrame, found: DataFrame) -> DataFrame:
    """(url, depth) of found links (url, depth, parent) that the queue lacks, each once at its least depth."""
    return found.groupBy("url").agg(F.min("depth").alias("depth")).join(queue.select("url"), "url", "left_anti")


def claim(queue: DataFrame, now: Column, k: int) -> DataFrame:
    """The queue with its next ``k`` items running, once more attempted and started now."""
    chosen = head(queue, now, k).select(F.col("url").alias("__u"))
    marked = queue.join(chosen, F.col("url") == F.col("__u"), "left")
    mine = F.col("__u").isNotNull()
    return marked.withColumn("status", F.when(mine, "running").otherwise(F.col("status"))).withColumn("attempts", F.col("attempts") + mine.cast("int")).withColumn("started", F.when(mine, now).otherwise(F.col("started"))).drop("__u")


def rearm(queue: DataFrame, index_seconds: int = 21_600, document_seconds: int = 604_800) -> DataFrame:
    """Done items with the time when they are due again: indexes sooner than documents."""
    wait = F.when(F.col("item_type") == "index", index_seconds).otherwise(document_seconds)
    return queue.where("status = 'done'").select("url", F.timestamp_seconds(F.unix_timestamp("started") + wait).alias("due"))


def in_scope(queue: DataFrame, scope: str) -> DataFrame:
    """Items whose address the scope allows; ``all`` allows every one."""
    return queue if scope == "all" else queue.where(F.col("url").contains(scope))
