"""What the page of a search shows, as relations over its trace, the nodes and the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators import graph, search, tree
from arbora.sources.shared import materialize

#: Fixed sizes of the impact map: columns of files, its width, margin, widest step of nodes, height of a file's area and of a node's row, and where nodes start in it.
COLUMNS, WIDTH, MARGIN, STEP, AREA, ROW, TOP = 5, 1000.0, 40.0, 60.0, 200.0, 40.0, 40.0
#: Kinds of nodes on the impact map.
MAPPED = ("func", "class")


def reached(trace: DataFrame, by: str) -> DataFrame:
    """(by, node_id, explored, answer): nodes that a search went over (``evaluate``, ``expand``) or answered with; other events tell of none."""
    own = lambda *events: F.bool_or(F.col("event").isin(*events))
    each = trace.filter(F.col("node_id").isNotNull()).groupBy(by, "node_id").agg(own("evaluate", "expand").alias("explored"), own("answer").alias("answer"))
    return each.filter("explored or answer")


def reasoning(trace: DataFrame, by: str, order: str) -> DataFrame:
    """(by, place, event, node_id, parent, and the trace's other columns): each ``expand`` under the last ``evaluate`` before it.

    ``place`` numbers all of a search's events by ``order``; ``parent`` is the place of the
    row above, null for ``evaluate`` and for what is expanded before any. A search's
    events are no more than its budget allows.
    """
    placed = trace.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    above = search.sticky_last(placed, F.col("place"), F.col("event") == "evaluate", by, order)
    return placed.withColumn("parent", above).withColumn("parent", F.when(F.col("event") == "expand", F.col("parent"))).filter(F.col("event").isin("evaluate", "expand"))


def filtered(nodes: DataFrame, text: str) -> DataFrame:
    """(node_id, own): nodes whose name, or else kind, holds ``text`` in any case (``own``), and all above such.

    Each round climbs from what it found to parents that aren't shown yet, so that
    neither a wide tree nor a cycle is walked twice.
    """
    met = nodes.filter(F.contains(F.lower(F.coalesce("symbol", "kind")), F.lit(text.lower())))
    up = nodes.select("node_id", "parent_id").filter("parent_id is not null")
    known = nodes.select("node_id")
    level = shown = materialize(met.select("node_id", F.lit(True).alias("own")).distinct(), "filtered")
    while True:
        parents = level.join(up, "node_id").select(F.col("parent_id").alias("node_id")).distinct().join(known, "node_id", "left_semi")
        level = materialize(parents.join(shown, "node_id", "left_anti").withColumn("own", F.lit(False)), "filtered")
        if level.isEmpty():
            return shown
        shown = shown.unionByName(level)


def impact_map(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions and classes with their place (x, y) in the areas of their files, and the files' areas (path, x, y).

    Files go by path, COLUMNS in a row; a file's nodes go by ``ord``, then id, in a
    grid as wide as the square root of their number. A node without a path is
    in the file ``unknown``.
    """
    shown = nodes.filter(F.col("kind").isin(*MAPPED)).withColumn("path", F.coalesce(F.nullif("path", F.lit("")), F.lit("unknown")))
    files = materialize(shown.groupBy("path").agg(F.count("*").alias("n")), "files")
    columns = max(min(files.count(), COLUMNS), 1)
    width = WIDTH / columns
    walk = tree.preorder(files.select(F.col("path").alias("node_id"), F.lit(None).cast("string").alias("parent_id")), F.col("node_id")).select(F.col("node_id").alias("path"), "place")
    wide = F.ceil(F.sqrt(F.col("n")))
    area = files.join(walk, "path").select("path", (F.col("place") % columns * width).alias("_x"), (F.floor(F.col("place") / columns) * AREA).alias("_y"), wide.alias("_wide"), F.least(F.lit(STEP), F.lit(width - MARGIN) / wide).alias("_step"))
    area = materialize(area, "areas")
    at = F.row_number().over(Window.partitionBy("path").orderBy("ord", "node_id")) - 1
    placed = shown.withColumn("_at", at).join(area, "path")
    x, y = F.col("_x") + MARGIN + F.col("_at") % F.col("_wide") * F.col("_step"), F.col("_y") + TOP + F.floor(F.col("_at") / F.col("_wide")) * ROW
    return placed.select("node_id", "kind", "path", "symbol", x.alias("x"), y.alias("y")), area.select("path", F.col("_x").alias("x"), F.col("_y").alias("y"))


def impact_edges(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(src, dst, x1, y1, x2, y2): distinct edges between different nodes of impact_map()."""
    each = graph.shown_edges(edges, placed.select(F.col("node_id").alias("id"))).filter("src <> dst")
    at = lambda end, k: placed.select(F.col("node_id").alias(end), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    return each.join(at("src", 1), "src").join(at("dst", 2), "dst").select("src", "dst", "x1", "y1", "x2", "y2")


def package_cards(nodes: DataFrame) -> DataFrame:
    """(package, files, classes, functions): each package's name, with what has it as the first segment of its path."""
    names = nodes.filter("kind = 'pkg' and symbol is not null").select(F.col("symbol").alias("package")).distinct()
    n = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    counts = nodes.groupBy(F.split("path", "/")[0].alias("package")).agg(n("file", "files"), n("class", "classes"), n("func", "functions"))
    return names.join(counts, "package", "left").na.fill(0)


def escaped(text: Column) -> Column:
    """``text`` as HTML shows it; null as nothing."""
    out = F.coalesce(text, F.lit(""))
    for mark, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\n", " ")):
        out = F.replace(out, F.lit(mark), F.lit(shown))
    return out
