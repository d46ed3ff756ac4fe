"""Connected components by alternating large and small stars, every step a join written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import emptied, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (large star) or all not larger (small star) neighbours of each node on its smallest one."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    hung = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: long); the label is the component's smallest node.

    Stops when the edges are stars around their smallest nodes, which more steps don't change. An empty table gives none.
    """
    known, now = None, stored(edges.where("a <> b").distinct(), "edges")
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == known:
            break
        known, before = seen, now
        now = stored(_star(_star(before, True), False), "edges")
        emptied(before)
    labels = stored(now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "labels")
    emptied(now)
    return labels
