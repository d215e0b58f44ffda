"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.operators.skew import spread_join
from pairloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes of ``edges`` (columns a, b): the least node of each component, once for each node.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing
    changes: every step links neighbours to their least one, so a long chain shrinks by half or
    more each time. No component is gathered. Null ends and loops are left out.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = materialize(spread_join(both, least, ["a"]).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, ["a"]).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = materialize(small.filter("a <> b").distinct(), "small")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
