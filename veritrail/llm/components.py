"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step joins edges with per-node minima, so no node's neighbours are ever
gathered; a hub with a third of all edges is a skewed join side, which
adaptive execution splits.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import Scratch


#: Edges up to which a round is one job: a task then holds at most so many, however they are spread.
ONE_JOB = 1_000_000


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a, b) are stars already: no ``a`` has two ``b``, and none is one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    found = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return found.where("below > 1 OR (below = 1 AND above = 1)").limit(1).count() == 0


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(a, b) edges to (node, component), component being the smallest node reachable.

    Null ends and loops are ignored; a node in no other edge is not returned.
    The result reads a table of ``scratch``.  Sides grow with the corpus, so
    they meet in merge joins and are never broadcast.  Of more than ``ONE_JOB``
    edges the minima are written before they are joined, so that the join's
    hot keys can be split; fewer are worked on in one job a round.
    """
    one = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = scratch.keep(edges.where(F.col("a") != F.col("b")).select(*one).distinct(), "cc")
    many = now.count() > ONE_JOB
    keep = scratch.keep if many else lambda df, name: df
    for _ in range(rounds):
        if _settled(now):
            break
        both = now.union(now.select("b", "a"))
        low = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc")
        large = both.join(low.hint("merge"), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        large = keep(large, "cc")
        low = keep(large.groupBy("a").agg(F.min("b").alias("m")), "cc")
        small = large.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where(F.col("a") != F.col("b")).distinct()
        now = scratch.keep(small, "cc")
    else:
        raise RuntimeError("connected components did not settle")
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
