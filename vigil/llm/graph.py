"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); the component is
    its smallest node. Alternates large-star and small-star steps, each a
    group minimum over map-side combined rows joined back on the node, until
    every node points at its root. No group is ever collected; each round is
    written to the shared folder."""
    now = (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
           .filter("a <> b").distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours of a node point at the smallest one
        now = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .filter("a <> b").distinct())
        # small star: a node's smaller neighbours and the node itself point at the smallest
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        now = (now.join(low, "a")
               .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                         F.struct("a", F.col("m").alias("b")))).alias("e"))
               .select("e.*").filter("a <> b").distinct())
        now = stored(now, "components")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct())
        before = mark
