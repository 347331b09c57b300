"""Mermaid diagrams: parsing, validation of one and of a set, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.text import diagram_id

# What counts as a header, a node, an edge, and lines that hold neither.
HEADER = r"(?i)^\s*graph\s+(LR|TD|RL|BT)\b"
IDENT = r"[A-Za-z][\w-]*"
EDGE = rf"(?U)({IDENT})\s*[-.]{{1,3}}(?:\|[^|]+\|)?\s*>\s*({IDENT})"
NODE = rf"(?U)^\s*({IDENT})\s*(?:\[([^\]]*)\]|\(\((.*?)\)\)|\((?!\()([^)]*)\)|\{{([^}}]*)\}}|<([^>]*)>)"
NO_CONTENT = r"(?i)^\s*($|%%|subgraph\b)"


def lines(diagrams: DataFrame) -> DataFrame:
    """(name, line_no, line) of diagrams (name, text), numbered from 1; blank lines, comments and heads of subgraphs go."""
    each = diagrams.select("name", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.filter(~F.col("line").rlike(NO_CONTENT)).withColumn("line_no", F.col("line_no") + 1)


def _unquoted(label: Column) -> Column:
    """Without one pair of quotes around it, if there is one, and without blanks."""
    label = F.trim(label)
    return F.trim(F.when(label.rlike("(?s)^['\"].*['\"]$"), F.substring(label, F.lit(2), F.length(label) - 2)).otherwise(label))


def definitions(each: DataFrame) -> DataFrame:
    """(name, line_no, id, label) of lines() that define a node; ``unlabelled``: the brackets are empty, and the id is the label."""
    shown = F.concat(*[F.regexp_extract("line", NODE, k) for k in range(2, 7)])  # one kind of bracket has matched
    met = each.select("name", "line_no", F.regexp_extract("line", NODE, 1).alias("id"), _unquoted(shown).alias("label")).filter("id <> ''")
    return met.withColumns({"unlabelled": F.col("label") == "", "label": F.coalesce(F.nullif("label", F.lit("")), "id")})


def nodes(each: DataFrame) -> DataFrame:
    """(name, id, label) of lines(); a label of a later line replaces an earlier one's."""
    return definitions(each).groupBy("name", "id").agg(F.max_by("label", "line_no").alias("label"))


def edges(each: DataFrame) -> DataFrame:
    """(name, line_no, place, src, dst): every edge of a line, in order. A line that defines a node has none; an edge begins where the last one ended, so a chain gives its first."""
    rest = each.filter(~F.col("line").rlike(NODE))
    ends = lambda group: F.regexp_extract_all("line", F.lit(EDGE), F.lit(group))
    met = rest.select("name", "line_no", F.posexplode(F.arrays_zip(ends(1).alias("src"), ends(2).alias("dst"))).alias("place", "x"))
    return met.select("name", "line_no", "place", "x.src", "x.dst")


def errors(diagrams: DataFrame) -> DataFrame:
    """(name, line_no, error): empty diagrams, first lines that are no header, nodes with empty labels."""
    text = F.coalesce("text", F.lit(""))
    first = F.when(text == "", "empty diagram").when(~F.regexp_extract(text, "^([^\n]*)", 1).rlike(HEADER), "missing header")
    heads = diagrams.select("name", F.lit(1).alias("line_no"), first.alias("error")).filter("error is not null")
    bare = definitions(lines(diagrams)).filter("unlabelled").select("name", "line_no", F.concat(F.lit("missing label: "), "id").alias("error"))
    return heads.unionByName(bare)


def labelled_edges(found_nodes: DataFrame, found_edges: DataFrame) -> DataFrame:
    """(name, line_no, place, src, dst, times) by label, or by id where a node has none; ``times``: which occurrence of the edge it is."""
    label = lambda end: found_nodes.select("name", F.col("id").alias(end), F.col("label").alias(f"_{end}"))
    told = found_edges.join(label("src"), ["name", "src"], "left").join(label("dst"), ["name", "dst"], "left")
    told = told.select("name", "line_no", "place", F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
    return told.withColumn("times", F.row_number().over(Window.partitionBy("name", "src", "dst").orderBy("line_no", "place")))


def references(diagrams: DataFrame, allowed: DataFrame) -> DataFrame:
    """(name, label, defined, known, edge): labels of nodes and of edges' ends, and whether ``allowed`` (label) has them.

    Each label of a diagram comes once as a node (``defined``) and once for each end of an edge.
    """
    each = lines(diagrams)
    found = nodes(each)
    ends = labelled_edges(found, edges(each))
    spot = F.struct("line_no", "place", "times")
    used = ends.select("name", F.explode(F.array("src", "dst")).alias("label"), F.lit(False).alias("defined"), spot.alias("edge"))
    met = found.select("name", "label").distinct().select("name", "label", F.lit(True).alias("defined"), F.lit(None).cast(used.schema["edge"].dataType).alias("edge")).unionByName(used)
    return met.join(allowed.select("label").distinct().withColumn("_ok", F.lit(True)), "label", "left").withColumn("known", F.col("_ok").isNotNull()).select("name", "label", "defined", "known", "edge")


def validate(diagrams: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row for each diagram: its errors, allowed nodes that it defines, nodes that aren't allowed, edges with an end that isn't, repeated edges, and whether it is valid.

    Repeated edges alone leave a diagram valid.
    """
    met = references(diagrams, allowed)
    by_edge = met.filter("not defined").groupBy("name", "edge").agg(F.bool_or(~F.col("known")).alias("bad"))
    of_edges = by_edge.groupBy("name").agg(F.count_if("bad").alias("unknown_edges"), F.count_if(F.col("edge.times") > 1).alias("repeated_edges"))
    of_nodes = met.filter("defined").groupBy("name").agg(F.count_if("known").alias("covered"), F.count_if(~F.col("known")).alias("unknown_nodes"))
    wrong = errors(diagrams).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "error"))), lambda x: x["error"]).alias("errors"))
    out = diagrams.select("name").join(wrong, "name", "left").join(of_nodes, "name", "left").join(of_edges, "name", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("name", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), *map(count, ("covered", "unknown_nodes", "unknown_edges", "repeated_edges")))
    return out.withColumn("valid", (F.size("errors") == 0) & (F.col("unknown_nodes") == 0) & (F.col("unknown_edges") == 0))


def summary(diagrams: DataFrame, allowed: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row for a set of diagrams: allowed labels, those that some diagram defines, labels that aren't allowed, diagrams with errors, coverage, and whether all of it passes.

    No label allowed at all counts as covered.
    """
    met = references(diagrams, allowed)
    of = met.agg(F.countDistinct(F.when(F.col("defined") & F.col("known"), F.col("label"))).alias("covered"), F.countDistinct(F.when(~F.col("known"), F.col("label"))).alias("unknown"))
    total = allowed.agg(F.countDistinct("label").alias("allowed"))
    wrong = errors(diagrams).agg(F.countDistinct("name").alias("with_errors"))
    one = total.join(F.broadcast(of)).join(F.broadcast(wrong))  # one row each
    one = one.withColumn("coverage", F.when(F.col("allowed") > 0, F.col("covered") / F.col("allowed")).otherwise(1.0))
    return one.withColumn("passes", (F.col("coverage") >= threshold) & (F.col("unknown") == 0) & (F.col("with_errors") == 0))


def drawn(labels: DataFrame, ends: DataFrame, *, by: str = "name") -> DataFrame:
    """(by, k, line): the lines of a diagram for each group from labels (by, label) and edges (by, src, dst), nodes first."""
    one = labels.select(by, F.lit(1).alias("k"), F.concat(F.lit("    "), diagram_id(F.col("label")), F.lit('["'), "label", F.lit('"]')).alias("line"))
    two = ends.select(by, F.lit(2).alias("k"), F.concat(F.lit("    "), diagram_id(F.col("src")), F.lit(" --> "), diagram_id(F.col("dst"))).alias("line"))
    return one.unionByName(two).distinct()


def render(labels: DataFrame, ends: DataFrame, *, by: str = "name", header: str = "graph TD") -> DataFrame:
    """(by, text): drawn() as one text for each group."""
    body = drawn(labels, ends, by=by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("x"))
    return body.select(by, F.concat(F.lit(header + "\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))


def faults(diagrams: DataFrame, allowed: DataFrame) -> DataFrame:
    """(name, errors, unknown_nodes, unknown_edges) of diagrams that have any: what a redraft must mend, as sorted lists."""
    each = lines(diagrams)
    found = nodes(each)
    ends = labelled_edges(found, edges(each)).select("name", F.explode(F.array("src", "dst")).alias("label"), F.concat("src", F.lit("->"), "dst").alias("edge"))
    used = found.select("name", "label", F.lit(None).cast("string").alias("edge")).unionByName(ends)
    unknown = used.join(allowed.select("label").distinct(), "label", "left_anti")
    listed = lambda c: F.array_sort(F.collect_set(c))
    of_labels = unknown.groupBy("name").agg(listed(F.when(F.col("edge").isNull(), F.col("label"))).alias("unknown_nodes"), listed("edge").alias("unknown_edges"))
    wrong = errors(diagrams).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "error"))), lambda x: x["error"]).alias("errors"))
    some = wrong.join(of_labels, "name", "full")
    return some.select("name", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("errors", "unknown_nodes", "unknown_edges")])
