"""Connected components of a graph that may have hubs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """Join each (node, other) with the least of node and its others. Minima are summed up in the tasks first, so the
    join is the one step that meets a hub's rows, and it can be split."""
    least = materialize(pairs.groupBy("node").agg(F.min("other").alias("least"))).withColumn("least", F.least("node", "least"))
    return pairs.join(least, "node")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for the nodes of edges (a, b: long). Loops and repeats are allowed."""
    current = materialize(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = current.select(F.col("a").alias("node"), F.col("b").alias("other")).union(current.select(F.col("b"), F.col("a")))
        large = _star(both).where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
        loops = current.where("a = b")
        large = materialize(large.union(loops).distinct())
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        small = _star(down).select(F.explode(F.array(F.struct(F.col("other").alias("a"), F.col("least").alias("b")), F.struct(F.col("node").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.a", "e.b")
        current = materialize(small.distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = state
