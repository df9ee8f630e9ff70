"""Connected components of links by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import shared


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link: ``root`` is the smallest node reachable.

    ``links`` (a, b) may hold loops and repeats. Each round is written to the shared folder, so
    a lost executor never replays earlier ones; rounds grow with the logarithm of the longest
    path. Minima are combined before each shuffle; a node with very many links is one row then,
    and the join back to its links is one that Spark splits when it is skewed.
    """
    now, seen = shared(links.where("a <> b").select("a", "b").distinct(), "links"), None
    while True:
        both = now.union(now.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        now = shared(small.union(least.select("a", F.col("low").alias("b"))).distinct(), "links")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
