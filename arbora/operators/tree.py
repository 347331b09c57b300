"""Trees as adjacency lists (node_id, parent_id, ...).

Ancestor pairs are made one level at a time by an equi-join on the parent. Sums
over subtrees don't need them: they rise a level at a time, so that each node is
aggregated once. Each level is written to the shared folder, so that no level
repeats the work of those before it. Both stop at a depth guard, which a cycle
would reach.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.sources.shared import materialize

MOST_LEVELS = 64


def load_nodes(nodes: DataFrame) -> DataFrame:
    """Of rows with one node_id the last by ``ord``, in the place of the first."""
    w = Window.partitionBy("node_id")
    kept = nodes.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("ord"))), "_o": F.min("ord").over(w)}).filter("_n = 1")
    return kept.withColumn("ord", F.col("_o")).drop("_n", "_o")


def children(nodes: DataFrame) -> DataFrame:
    """(parent_id, children): child ids in order."""
    return nodes.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.array_sort(F.collect_list("node_id")).alias("children"))


def ancestors(nodes: DataFrame, *, hop: Column | None = None, most: int = MOST_LEVELS) -> DataFrame:
    """(node_id, ancestor, depth) of every node, itself at depth 0 included.

    ``hop``, a condition on a node's columns, must hold for each node that a path
    leaves upwards.
    """
    up = nodes if hop is None else nodes.filter(hop)
    step = up.filter(F.col("parent_id").isNotNull()).select(F.col("node_id").alias("ancestor"), F.col("parent_id").alias("_up"))
    level = nodes.select("node_id", F.col("node_id").alias("ancestor"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, most + 1):
        level = materialize(level.join(step, "ancestor").select("node_id", F.col("_up").alias("ancestor"), F.lit(depth).alias("depth")), "ancestors")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"paths are longer than {most} levels, or there is a cycle")


def levels(nodes: DataFrame, most: int = MOST_LEVELS) -> list[DataFrame]:
    """Nodes by depth: roots, their children, and so on."""
    ids = nodes.select(F.col("node_id").alias("_p"))
    out = [materialize(nodes.join(ids, nodes["parent_id"] == ids["_p"], "left_anti"), "level")]
    while len(out) <= most:
        above = out[-1].select(F.col("node_id").alias("_p"))
        below = materialize(nodes.join(above, nodes["parent_id"] == above["_p"], "left_semi"), "level")
        if below.isEmpty():
            return out
        out.append(below)
    raise ValueError(f"paths are longer than {most} levels, or there is a cycle")


def rollup(nodes: DataFrame, values: dict[str, Column], merge: Callable[[Column], Column] = F.sum, *, most: int = MOST_LEVELS) -> DataFrame:
    """(node_id, values): each value over the node and all below it."""
    names = list(values)
    by_level = [n.select("node_id", "parent_id", *[c.alias(k) for k, c in values.items()]) for n in levels(nodes, most)]
    done = by_level[-1]
    out = done.select("node_id", *names)
    for own in reversed(by_level[:-1]):
        risen = done.select(F.col("parent_id").alias("node_id"), F.lit(None).cast(own.schema["parent_id"].dataType).alias("parent_id"), *names)
        done = own.unionByName(risen).groupBy("node_id").agg(F.max("parent_id").alias("parent_id"), *[merge(F.col(k)).alias(k) for k in names])
        done = materialize(done, "rollup")
        out = out.unionByName(done.select("node_id", *names))
    return out


def preorder(nodes: DataFrame, key: Column, *, most: int = MOST_LEVELS) -> DataFrame:
    """(node_id, depth, place): a depth-first walk from place 0; siblings, and roots, go by ``key``, then id.

    Sizes of subtrees rise by rollup(); places descend a level at a time. Siblings are
    dealt over ranges of the order, and only the ranges' sums meet, so that a
    node with very many children is no task of its own.
    """
    kept = nodes.select("node_id", "parent_id", key.alias("_key"))
    sizes = rollup(kept, {"_size": F.lit(1).cast("long")}, most=most)
    order = ("_up", "_key", "node_id")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    above, out = None, None
    for depth, level in enumerate(levels(kept, most)):
        up = F.lit(None).cast(kept.schema["parent_id"].dataType) if above is None else F.col("parent_id")
        dealt = materialize(level.join(sizes, "node_id").select("node_id", up.alias("_up"), "_key", "_size").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "siblings")
        sums = dealt.groupBy("_up", "_range").agg(F.sum("_size").alias("_n"))
        ahead = sums.select(F.col("_up").alias("_u"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier("_up").orderBy("_range")), F.lit(0)).alias("_ahead"))
        within = F.coalesce(F.sum("_size").over(earlier("_up", "_range").orderBy("_key", "node_id")), F.lit(0))
        placed = dealt.withColumn("_within", within).join(ahead, F.col("_up").eqNullSafe(F.col("_u")) & (F.col("_range") == F.col("_r")))
        start = F.lit(0)
        if above is not None:
            placed, start = placed.join(above.select(F.col("node_id").alias("_a"), F.col("place").alias("_start")), F.col("_up") == F.col("_a")), F.col("_start") + 1
        above = materialize(placed.select("node_id", F.lit(depth).alias("depth"), (start + F.col("_ahead") + F.col("_within")).cast("long").alias("place")), "preorder")
        out = above if out is None else out.unionByName(above)
    return out


def descendants(pairs: DataFrame, of: Column) -> DataFrame:
    """Nodes below those that ``of`` picks by ``ancestor``, from ancestors()."""
    return pairs.filter(of & (F.col("depth") > 0)).select("ancestor", "node_id", "depth")


def nearest(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node_id, ancestor): each node's closest ancestor-or-self among ``wanted`` (ancestor)."""
    met = pairs.join(wanted, "ancestor", "left_semi")
    return met.groupBy("node_id").agg(F.min_by("ancestor", "depth").alias("ancestor"))
