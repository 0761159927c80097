"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop_written, written


def _sum_of(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links in, (node, root) out: root is the smallest node reachable, for every node with a link that isn't itself the smallest.

    Alternates the large-star and small-star steps until the links no longer change. Each step is an
    aggregation and an equi-join, whose skewed partitions adaptive execution can split; no step gathers
    the neighbours of a node. Each round is written to the shared folder, so a lost executor costs one
    round at most. Null ends and self-links are ignored; an empty input gives an empty result.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "links")
    state = _sum_of(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        new = written(near.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        found = _sum_of(new)
        drop_written(now)
        now = new
        if found == state:
            break
        state = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
