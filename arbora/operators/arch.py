"""Architecture views of an index: roles, flows, important files, component records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import paths
from arbora.operators import tree

FLOWS, CALLS, FILES = 12, 15, 5
#: Most packages and files that a component's context lists.
CONTEXT_PACKAGES, CONTEXT_FILES = 20, 10


def with_component(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("component", paths.component_name(F.col("path")))


def component_stats(nodes: DataFrame) -> DataFrame:
    """(component, files, classes, functions, loc): lines are those of files."""
    kind = F.col("kind")
    return (
        with_component(nodes)
        .groupBy("component")
        .agg(
            F.count_if(kind == "file").alias("files"),
            F.count_if(kind == "class").alias("classes"),
            F.count_if(kind.isin("func", "block")).alias("functions"),
            F.coalesce(F.sum(F.when(kind == "file", F.col("loc"))), F.lit(0)).cast("long").alias("loc"),
        )
    )


def component_roles(nodes: DataFrame, rules: tuple = paths.COMPONENT_ROLES) -> DataFrame:
    """(component, role): by all its paths and its name; ``other`` where no rule fits."""
    each = with_component(nodes)
    told = each.select("component", F.explode_outer(paths.tags(rules, path=F.col("path"), name=F.col("component"))).alias("role")).distinct()
    every = Window.partitionBy("component")
    return told.withColumn("n", F.count("role").over(every)).filter("role is not null or n = 0").select("component", F.coalesce("role", F.lit("other")).alias("role"))


def role_clusters(nodes: DataFrame) -> DataFrame:
    """(role, components): sorted; a component of several roles stands under each."""
    return component_roles(nodes).groupBy("role").agg(F.array_sort(F.collect_set("component")).alias("components"))


def component_packages(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(component, packages): paths of a component's packages, sorted; the first ``most`` of them."""
    each = with_component(nodes.filter("kind = 'pkg' and path is not null")).select("component", "path").distinct()
    if most is not None:
        each = each.withColumn("_n", F.row_number().over(Window.partitionBy("component").orderBy("path"))).filter(F.col("_n") <= most)
    return each.groupBy("component").agg(F.array_sort(F.collect_list("path")).alias("packages"))


def component_context(nodes: DataFrame, edges: DataFrame, packages: int = CONTEXT_PACKAGES, files: int = CONTEXT_FILES) -> DataFrame:
    """(component, packages, files, classes, functions, deps, dependents, roles, key_files): what a drafter is told of each component.

    edges (src, dst) are between components; lists are empty where there is nothing,
    and packages and key files are capped before they are gathered.
    """
    stats = component_stats(nodes).drop("loc")
    roles = component_roles(nodes).groupBy("component").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    best = important_files(with_component(nodes.filter("kind = 'file'")), "component", min(files, FILES)).groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("key_files"))
    out = edges.filter("src <> dst").groupBy(F.col("src").alias("component")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    back = edges.filter("src <> dst").groupBy(F.col("dst").alias("component")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))
    for part in (component_packages(nodes, packages), out, back, roles, best):
        stats = stats.join(part, "component", "left")
    listed = ("packages", "deps", "dependents", "roles", "key_files")
    return stats.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in listed})


def package_roles(packages: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, roles) of packages by their path and their files' names (files: package, path)."""
    name = F.element_at(F.split(files["path"], "/"), -1)
    by_file = files.select("package", F.explode(paths.tags(paths.PACKAGE_ROLES, file=name)).alias("role"))
    by_path = packages.select(F.col("node_id").alias("package"), F.explode(paths.tags(paths.PACKAGE_ROLES, path=F.col("path"))).alias("role"))
    told = by_file.unionByName(by_path).groupBy("package").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return packages.select("node_id").join(told, F.col("node_id") == F.col("package"), "left").select("node_id", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


def important_files(files: DataFrame, by: str = "package", most: int = FILES) -> DataFrame:
    """The first files of each package: preferred names, then most lines, then name."""
    name = F.element_at(F.split("path", "/"), -1)
    order = Window.partitionBy(by).orderBy(paths.file_rank(name), F.desc(F.coalesce("loc", F.lit(0))), name, "path")
    return files.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def flows(nodes: DataFrame, edges: DataFrame, most: int = FLOWS, calls: int = CALLS) -> DataFrame:
    """(component, category, entry_path, entry_symbol, loc, calls, place): entry files and functions with what they call.

    Files are cli, workflow or route modules by their path; functions directly in
    files that look like entries get their category, and those in route files are
    http routes.
    """
    low = F.lower("path")
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(low, F.lit(words[0]))
    files = nodes.filter("kind = 'file'").withColumn(
        "category",
        F.when(has("cli", "main.py", "manage.py"), "cli").when(has("workflow", "worker"), "workflow").when(has("/routes/") | F.endswith(low, F.lit("routes.py")), "route-module"),
    )
    above = nodes.select(F.col("node_id").alias("_p"), F.col("kind").alias("_kind"), F.lower("path").alias("_path"))
    kids = nodes.filter("kind in ('func', 'block')").join(above, F.col("parent_id") == F.col("_p"), "left").filter("_p is null or _kind = 'file'")
    kids = kids.withColumn(
        "category",
        F.when(paths.looks_like_entry(F.col("path"), F.col("symbol")), paths.category(F.col("path"), F.col("symbol"))).when(F.contains("_path", F.lit("/routes/")), "http-route"),
    )
    entries = files.unionByName(kids.select(*files.columns)).filter(F.col("category").isNotNull())
    order = Window.partitionBy("component").orderBy(paths.category_rank(F.col("category")), F.desc(F.coalesce("loc", F.lit(0))), "path", "node_id")
    kept = with_component(entries).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    called = edges.filter("type = 'call'").join(nodes.select(F.col("node_id").alias("dst"), F.col("symbol").alias("_callee")), "dst", "left")
    label = F.coalesce("_callee", "detail", "dst")
    by_src = called.join(kept.select(F.col("node_id").alias("src")), "src", "left_semi").groupBy("src").agg(F.slice(F.array_sort(F.collect_set(label)), 1, calls).alias("calls"))
    return kept.join(by_src, kept["node_id"] == by_src["src"], "left").select(
        "component", "category", F.col("path").alias("entry_path"), F.col("symbol").alias("entry_symbol"), "loc", F.coalesce("calls", F.array().cast("array<string>")).alias("calls"), "place"
    )


def directory_summary(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id, path, files, classes, functions) of packages, counts over all below."""
    kind = F.col("kind")
    one = lambda *kinds: F.when(kind.isin(*kinds), 1).otherwise(0).cast("long")
    counts = tree.rollup(nodes, {"files": one("file"), "classes": one("class"), "functions": one("func", "block")})
    return nodes.filter("kind in ('pkg', 'repo')").select("node_id", "parent_id", "path").join(counts, "node_id")


def walked_folders(folders: DataFrame) -> DataFrame:
    """directory_summary() rows with depth, place in a walk by path, and the line of a Mermaid mind map, from a column ``text``."""
    walk = tree.preorder(folders.select("node_id", "parent_id", "path"), F.col("path"))
    shown = F.concat(F.lit('("'), F.coalesce(F.nullif("path", F.lit("")), F.lit("root")), F.lit(": "), "text", F.lit('")'))
    return folders.join(walk, "node_id").withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), shown))


def guide_flows(flows: DataFrame, focus: tuple[str, ...], words: tuple[str, ...], most: int = CALLS) -> DataFrame:
    """The first flows of a guide, with ``rank`` from 1: those of components in focus, then those of others whose path has one of the words; by place, then path, then component."""
    low, mine = F.lower(F.coalesce("entry_path", F.lit(""))), F.col("component").isin(*focus)
    fits = [F.contains(low, F.lit(w)) for w in words]
    kept = flows.withColumn("_other", ~mine).filter(mine | (F.greatest(*fits) if len(fits) > 1 else fits[0] if fits else F.lit(False)))
    order = [F.col("_other"), F.col("place"), F.coalesce("entry_path", F.lit("")), F.col("component")]
    first = kept.orderBy(*order).limit(most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).drop("_other")  # ``most`` rows


def focus_dependencies(dependencies: DataFrame, focus: tuple[str, ...]) -> DataFrame:
    """One row (deps): what the nodes in focus depend on beside themselves, from graph.dependencies()."""
    out = dependencies.filter(F.col("node").isin(*focus)).select(F.explode("deps").alias("dep")).filter(~F.col("dep").isin(*focus))
    return out.agg(F.array_sort(F.collect_set("dep")).alias("deps"))


def component_records(nodes: DataFrame, edges: DataFrame, package_edges: DataFrame) -> DataFrame:
    """One row for each component: stats, roles, important files, dependencies and flows."""
    from arbora.operators import graph

    stats = component_stats(nodes)
    roles = component_roles(nodes, paths.DOCUMENT_ROLES).groupBy("component").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    best = important_files(with_component(nodes.filter("kind = 'file'")), "component").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("place", "path", "loc"))).alias("important_files"))
    ends = graph.component_edges(package_edges)
    deps = graph.dependencies(stats.select(F.col("component").alias("node")), ends).withColumnRenamed("node", "component")
    told = flows(nodes, edges).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("place", "category", "entry_path", "entry_symbol", "calls"))).alias("flows"))
    return stats.join(roles, "component", "left").join(best, "component", "left").join(deps, "component", "left").join(told, "component", "left")
