"""Architecture documents of an index: Markdown and diagrams, written line by line from tasks."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.text import ellipsis, stats_text
from arbora.operators import arch, graph, mermaid, tree
from arbora.plans.redraft import Draft, latest, redraft
from arbora.sources.documents import fixed, lines, write_documents
from arbora.sources.shared import materialize
from arbora.sources.sinks import IndexFiles, write_text

MODES = ("deterministic", "hybrid", "model")


@dataclass
class DescribeConfig:
    """draft: a drafter of diagrams for the modes ``model`` and ``hybrid`` (rendered ones where the drafts fail); ``deterministic`` renders all."""

    draft: Draft | None = None
    mode: str = "deterministic"
    coverage: float = 0.95
    redrafts: int = 2
    #: Guides to write: a title, the components in focus, and words that flows of others must have.
    guides: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.mode != "deterministic" and self.draft is None:
            raise ValueError(f"mode {self.mode!r} is none of {MODES}, or lacks a drafter")


def package_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) paths of packages: imports as resolved by alias, and calls between files' packages."""
    pairs = tree.ancestors(nodes)
    pkgs = nodes.filter("kind = 'pkg'")
    near = materialize(tree.nearest(pairs, pkgs.select(F.col("node_id").alias("ancestor"))), "package-of")
    path = pkgs.select(F.col("node_id").alias("package"), "path")
    src = near.select(F.col("node_id").alias("src"), F.col("ancestor").alias("from"))
    out = edges.filter("type = 'import'").join(src, "src").select(F.col("from").alias("src"), F.col("dst").alias("target")).distinct()
    branch = pairs.select(F.col("node_id").alias("src"), F.col("ancestor").alias("package"))
    found = graph.resolve_imports(out, graph.aliases(pkgs), branch).select("src", F.col("package").alias("dst"))
    direct = edges.filter("type <> 'import'").join(src, "src").join(near.select(F.col("node_id").alias("dst"), F.col("ancestor").alias("to")), "dst").select(F.col("from").alias("src"), F.col("to").alias("dst"))
    ids = found.unionByName(direct).filter("src <> dst").distinct()
    at = lambda end: path.select(F.col("package").alias(end), F.col("path").alias(f"{end}_path"))
    return ids.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))


def role_pairs(nodes: DataFrame) -> DataFrame:
    """(role, component), distinct."""
    return arch.component_roles(nodes).select("role", "component").distinct()


def _told(names: Column, without: str) -> Column:
    return F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit(without))


def component_pages(records: DataFrame) -> DataFrame:
    """Lines of components/NAME.md from component_records() with stats and used_by."""
    texts = lambda c, shown: F.coalesce(F.transform(c, shown), F.array().cast("array<string>"))
    head = F.array(
        F.concat(F.lit("# "), "component"),
        F.lit(""),
        F.concat("stats", F.lit(", "), F.col("loc").cast("string"), F.lit(" lines. Roles: "), _told(F.col("roles"), "other"), F.lit(".")),
        F.lit(""),
        F.concat(F.lit("Depends on: "), _told(F.col("deps"), "nothing"), F.lit(". Used by: "), _told(F.col("used_by"), "nothing"), F.lit(".")),
        *map(F.lit, ("", "## Files", "")),
    )
    files = texts("important_files", lambda x: F.concat(F.lit("- `"), x["path"], F.lit("` ("), F.coalesce(x["loc"].cast("string"), F.lit("0")), F.lit(" lines)")))
    flows = texts("flows", lambda x: F.concat(F.lit("- "), x["category"], F.lit(": `"), x["entry_path"], F.lit("` "), F.coalesce(x["entry_symbol"], F.lit("")), F.lit(" calls "), _told(x["calls"], "nothing")))
    each = records.select("component", F.posexplode(F.flatten(F.array(head, files, F.array(*map(F.lit, ("", "## Flows", ""))), flows))).alias("n", "line"))
    return lines(each, F.concat(F.lit("components/"), "component", F.lit(".md")), 0, F.col("line"), n=F.col("n"))


def diagram_pages(drawn: DataFrame) -> DataFrame:
    """Lines of diagrams/NAME.mmd from mermaid.drawn()."""
    file = F.concat(F.lit("diagrams/"), "name", F.lit(".mmd"))
    return lines(drawn.select("name").distinct(), file, 0, F.lit("graph TD")).unionByName(lines(drawn, file, 1, F.col("line"), n=F.col("k")))


def draft_pages(drafts: DataFrame) -> DataFrame:
    """Lines of diagrams/NAME.mmd from (name, text)."""
    each = drafts.select("name", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines(each, F.concat(F.lit("diagrams/"), "name", F.lit(".mmd")), 0, F.col("line"), n=F.col("n"))


def wanted_diagrams(names: DataFrame, links: DataFrame) -> DataFrame:
    """(name, labels, ends) for a drafter: the system with all components (name), and each component with what it depends on and what uses it."""
    near = links.select(F.col("src").alias("name"), "src", "dst").unionByName(links.select(F.col("dst").alias("name"), "src", "dst"))
    near = near.unionByName(links.select(F.lit("system").alias("name"), "src", "dst"))
    shown = names.select("name", F.col("name").alias("label")).unionByName(names.select(F.lit("system").alias("name"), F.col("name").alias("label")))
    shown = shown.unionByName(near.select("name", F.explode(F.array("src", "dst")).alias("label")))
    listed = lambda c: F.array_sort(F.collect_set(c))
    ends = near.groupBy("name").agg(listed(F.struct("src", "dst")).alias("ends"))
    return shown.groupBy("name").agg(listed("label").alias("labels")).join(ends, "name", "left")


def guide_pages(spark: SparkSession, records: DataFrame, title: str, focus: tuple[str, ...], words: tuple[str, ...]) -> DataFrame:
    """Lines of a guide: what its focus depends on, then arch.guide_flows()."""
    file = f"guides/{title.lower().replace(' ', '-')}.md"
    flows = arch.guide_flows(records.select("component", F.explode("flows").alias("x")).select("component", "x.*"), focus, words)
    shown = F.concat(F.lit("- "), "component", F.lit(", "), "category", F.lit(": `"), "entry_path", F.lit("` "), F.coalesce("entry_symbol", F.lit("")))
    deps = arch.focus_dependencies(records.select(F.col("component").alias("node"), "deps"), focus)
    told = F.concat(F.lit(f"In focus: {', '.join(focus)}. Depends on: "), _told(F.col("deps"), "nothing"), F.lit("."))
    return fixed(spark, file, 0, f"# {title}", "").unionByName(lines(deps, F.lit(file), 1, told)).unionByName(fixed(spark, file, 2, "")).unionByName(lines(flows, F.lit(file), 3, shown, n=F.col("rank")))


def folder_pages(folders: DataFrame, last: int) -> DataFrame:
    """Lines of the mind map, of structure.json and of the overview's folders from arch.walked_folders(); ``last``: the greatest place."""
    shown, place = F.coalesce(F.nullif("path", F.lit("")), F.lit("root")), F.col("place")
    record = F.to_json(F.struct("node_id", "parent_id", "path", "files", "classes", "functions", "text"), {"ignoreNullFields": "false"})
    each = lines(folders, F.lit("structure.json"), 1, F.concat(F.lit("  "), record, F.when(place < last, ",").otherwise("")), n=place)
    each = each.unionByName(lines(folders, F.lit("diagrams/structure.mmd"), 1, F.col("line"), n=place))
    return each.unionByName(lines(folders, F.lit("index.md"), 3, F.concat(F.lit("- `"), shown, F.lit("`: "), "text"), n=place))


def describe(spark: SparkSession, index: str, out: str, config: DescribeConfig | None = None) -> dict[str, int]:
    """Writes overview, file list, component documents, diagrams, guides and meta.json; gives the counts in it.

    Tasks write the documents; counts, and the names of written files, are all
    that reaches the driver. An index without components but the root describes that.
    """
    config, files = config or DescribeConfig(), IndexFiles(spark, index)
    nodes, edges = tree.load_nodes(files.read("nodes")), files.edges()
    inside = nodes.filter("kind <> 'repo'")
    ends = materialize(package_edges(nodes, edges), "package-edges")
    between = materialize(graph.component_edges(ends), "component-edges")
    counted = stats_text(files=F.col("files"), classes=F.col("classes"), functions=F.col("functions"))
    used = graph.dependents(between).select(F.col("node").alias("component"), F.col("dependents").alias("used_by"))
    records = materialize(arch.component_records(inside, edges, ends).withColumn("stats", counted).join(used, "component", "left"), "components")
    names = records.filter("component not in ('root', '.')").select(F.col("component").alias("name"))
    components = names.count()
    if not components:
        names, components = spark.createDataFrame([("root",)], "name string"), 1
    folders = materialize(arch.walked_folders(arch.directory_summary(nodes).withColumn("text", counted)), "folders")
    roles = role_pairs(inside).select(F.lit("roles").alias("name"), F.col("role").alias("src"), F.col("component").alias("dst"))

    label = lambda name, c: names.select(F.lit(name).alias("name"), F.col(c).alias("label"))
    system = mermaid.drawn(label("system", "name"), between.select(F.lit("system").alias("name"), "src", "dst"))
    by_pkg = arch.with_component(inside.filter("kind = 'pkg'")).select(F.col("component").alias("name"), F.col("path").alias("label"))
    own = arch.with_component(ends.withColumnRenamed("src", "path")).select(F.col("component").alias("name"), F.col("path").alias("src"), "dst")
    diagrams = diagram_pages(system.unionByName(mermaid.drawn(by_pkg, own)))
    if config.mode != "deterministic":
        drafts, passed = redraft(wanted_diagrams(names, between), names.select(F.col("name").alias("label")), config.draft, coverage=config.coverage, most=config.redrafts, store=f"{index.rstrip('/')}/answers")
        if passed:
            diagrams = draft_pages(latest(drafts))
        elif config.mode == "model":
            raise RuntimeError(f"no drafts passed after {config.redrafts} rounds")
    diagrams = materialize(diagrams, "diagrams")

    by_role = arch.role_clusters(inside)
    listed = nodes.filter("kind = 'file'").select("path", F.coalesce(ellipsis(F.col("summary"), 140), F.lit("")).alias("summary"))
    index_md = F.lit("index.md")
    drawn_in = diagrams.filter("file = 'diagrams/system.mmd'")
    pages = [
        component_pages(records),
        diagrams,
        diagram_pages(mermaid.drawn(roles.select("name", F.explode(F.array("src", "dst")).alias("label")), roles)),
        folder_pages(folders, folders.count() - 1),
        fixed(spark, "structure.json", 0, "["),
        fixed(spark, "structure.json", 2, "]"),
        fixed(spark, "diagrams/structure.mmd", 0, "mindmap"),
        fixed(spark, "index.md", 0, "# Overview", "", "All files: [files.md](files.md)", ""),
        lines(names, index_md, 1, F.concat(F.lit("- ["), "name", F.lit("](components/"), "name", F.lit(".md)")), key=F.col("name")),
        fixed(spark, "index.md", 2, "", "## Folders", ""),
        fixed(spark, "index.md", 4, "", "## Roles", ""),
        lines(by_role, index_md, 5, F.concat(F.lit("- "), "role", F.lit(": "), F.array_join("components", ", ")), key=F.col("role")),
        fixed(spark, "index.md", 6, "", "```mermaid"),
        drawn_in.withColumns({"file": index_md, "part": F.col("part") + 7}),
        fixed(spark, "index.md", 9, "```"),
        fixed(spark, "files.md", 0, "# Files", ""),
        lines(listed, F.lit("files.md"), 1, F.rtrim(F.concat(F.lit("- `"), "path", F.lit("` "), "summary")), key=F.col("path")),
        *[guide_pages(spark, records, *g) for g in config.guides],
    ]
    write_documents(reduce(DataFrame.unionByName, pages), out)
    counts = files.read("meta").first().asDict() | {"components": components}
    write_text(spark, f"{out}/meta.json", json.dumps(counts, default=str))
    return counts
