"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import discard, written


def _nearest(pairs: DataFrame) -> DataFrame:
    """(n, m): each node ``u`` of (u, v) with the smallest of itself and its ``v``."""
    return pairs.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b), root being the smallest node it can reach.

    Links may repeat, run either way or join a node with itself; null ends are ignored. An empty
    table gives none. Each round writes its links to the shared folder in the place of the last ones, and the driver sees only
    a count and a checksum; a node of many links is never collected: minima are pre-aggregated
    and the joins can be split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = written(e.distinct(), "links")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), both.u == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        near = _nearest(large)
        small = large.join(near, large.u == F.col("n")).select(F.col("v").alias("x"), F.col("m").alias("y"))
        small = small.where("x <> y").unionByName(near.where("n <> m").select(F.col("n").alias("x"), F.col("m").alias("y")))
        last, e = e, written(small.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
