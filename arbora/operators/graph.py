"""Dependency graphs between packages and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.paths import component_name, segments


def aliases(packages: DataFrame) -> DataFrame:
    """(alias, package, path): a package goes by its path, dotted path and last name."""
    dotted = F.translate("path", "/", ".")
    names = F.array_distinct(F.array("path", dotted, F.element_at(F.split("path", "/"), -1)))
    return packages.select(F.explode(names).alias("alias"), F.col("node_id").alias("package"), "path").filter("alias <> ''")


def resolve_imports(edges: DataFrame, known: DataFrame, branch: DataFrame | None = None) -> DataFrame:
    """(src, target, package) for edges (src package, target text).

    The target's first segment that is an alias decides; among several packages
    of that alias one on the source's branch (``branch``: src, package pairs) goes
    first, then the least path; without any the source itself stays.
    """
    each = edges.select("src", "target", F.posexplode(segments(F.col("target"))).alias("pos", "alias"))
    met = each.join(known, "alias")
    if branch is not None:
        met = met.join(branch.withColumn("near", F.lit(1)), ["src", "package"], "left")
    else:
        met = met.withColumn("near", F.lit(None).cast("int"))
    order = Window.partitionBy("src", "target").orderBy("pos", F.desc_nulls_last("near"), "path")
    best = met.withColumn("n", F.row_number().over(order)).filter("n = 1").select("src", "target", "package")
    return edges.select("src", "target").distinct().join(best, ["src", "target"], "left").withColumn("package", F.coalesce("package", "src"))


def dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, deps): sorted distinct targets, without the node itself; nodes without any keep an empty list."""
    out = edges.filter("src <> dst").distinct().groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    return nodes.join(out, nodes["node"] == out["src"], "left").select("node", F.coalesce("deps", F.array().cast(out.schema["deps"].dataType)).alias("deps"))


def dependents(edges: DataFrame) -> DataFrame:
    """(node, dependents): who depends on it."""
    return edges.filter("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))


def component_edges(edges: DataFrame) -> DataFrame:
    """Package edges (src, dst paths) as distinct edges between components."""
    return edges.select(component_name(F.col("src")).alias("src"), component_name(F.col("dst")).alias("dst")).filter("src <> dst").distinct()


def shown_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Distinct edges with both ends among ``shown`` (id)."""
    at = lambda end: F.col(end) == F.col("id")
    return edges.join(shown, at("src"), "left_semi").join(shown, at("dst"), "left_semi").select("src", "dst").distinct()


def missing(allowed: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    return allowed.join(covered, key, "left_anti")


def coverage(allowed: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """(allowed, missing, coverage) in one row."""
    told = allowed.select(key).distinct().join(covered.select(key).distinct().withColumn("_c", F.lit(1)), key, "left")
    return told.agg(F.count("*").alias("allowed"), F.count_if(F.col("_c").isNull()).alias("missing")).withColumn("coverage", F.when(F.col("allowed") > 0, 1 - F.col("missing") / F.col("allowed")).otherwise(1.0))
