"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's least node.

    Each round hangs larger neighbours below the least one (large star), then
    links a node's lesser neighbours (small star); the edges become a star for
    each component in a number of rounds that grows with the logarithm of the
    largest distance. Each round is a table in the shared folder, and only a
    stop flag reaches the driver.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        nodes = e.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if not nodes.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # least neighbours as tables, so that both sides of the joins are plain shuffles and a hub's join can be split
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = (e, least, large, lowest), materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(*old)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
