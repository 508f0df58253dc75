"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Workspace


def _mirrored(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, work: Workspace | None = None, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node), for each node of links (a, b: long). Self-links and repeated links do no harm.

    Each round hangs every node's neighbours on the smallest of them, first the larger ones, then the smaller ones,
    and ends when nothing changes; chains halve with each round. A round is one job, which also sums up what it writes
    to tables of work (by default to one of its own, which stays); only those two sums reach the driver.
    """
    work = work or Workspace(links.sparkSession)

    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = work.saved(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")))
        return out, (seen.get["n"], seen.get["hashes"])

    links, seen = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds if seen[0] else 0):
        both = _mirrored(links)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Now each link goes from a node to a smaller one.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        before = seen
        links, seen = stored(small.where("a <> b").distinct())
        if before == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct().toDF("node", "component")).distinct()
