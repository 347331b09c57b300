"""Queries of walks, mind maps, guides and redrafts; importing this adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.text import repair_json, stats_text
from arbora.operators import arch, graph, mermaid, search, tree
from arbora.plans import queries, redraft, tables
from arbora.plans.queries import query

WALK = "walk AS (SELECT node_id, 0 AS depth, [coalesce({0}, ''), node_id] AS trail FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, depth + 1, trail || [coalesce(n.{0}, ''), n.node_id] FROM walk JOIN nodes n ON n.parent_id = walk.node_id)"


@query(f"WITH RECURSIVE {tables.CODE_NODES}, {WALK.format('symbol')} SELECT node_id, depth, row_number() OVER (ORDER BY trail) - 1 AS place FROM walk")
def tree_preorder(spark, sf_dir):
    """A walk of regions, nations, customers and orders, siblings by symbol."""
    return tree.preorder(tables.code_nodes(spark, sf_dir), F.coalesce("symbol", F.lit("")))


@query(rf"""WITH RECURSIVE {tables.SITE_PAGES}, {tables.SITE_NODES}, {WALK.format('path')},
n AS (SELECT 'web' AS node_id, count(*) AS pages FROM site UNION ALL SELECT host, count(*) FROM site GROUP BY host UNION ALL SELECT host || '/' || lang, count(*) FROM site GROUP BY host, lang)
SELECT row_number() OVER (ORDER BY trail) - 1 AS place, repeat('  ', (depth + 1)::INT) || '("' || CASE WHEN node_id = 'web' THEN 'root' ELSE node_id END || ': ' || pages || ' functions")' AS line FROM walk JOIN n USING (node_id)""")
def mindmap_lines(spark, sf_dir):
    """The mind map of hosts and their languages, with the pages below each."""
    folders = arch.directory_summary(tables.site_nodes(spark, sf_dir))
    counted = folders.withColumn("text", stats_text(files=F.col("files"), classes=F.col("classes"), functions=F.col("functions")))
    return arch.walked_folders(counted).select("place", "line")


FOCUS, WORDS = ("nation_1", "nation_11"), ("routes",)


@query(f"""WITH {tables.CODE_NODES}, {queries.COMP}, {queries.FLOWS.split('called AS')[0].rstrip().rstrip(',')},
met AS (SELECT *, component NOT IN ('nation_1', 'nation_11') AS other FROM placed WHERE place <= 12 AND (component IN ('nation_1', 'nation_11') OR contains(path, 'routes')))
SELECT rank, component, category, entry_path, entry_symbol FROM (SELECT component, category, path AS entry_path, symbol AS entry_symbol, row_number() OVER (ORDER BY other, place, path, component) AS rank FROM met) WHERE rank <= 30""")
def guide_flows(spark, sf_dir):
    """A guide's first 30 flows: those of two nations in focus, then those of others under routes."""
    found = arch.flows(tables.code_nodes(spark, sf_dir), tables.call_edges(spark, sf_dir))
    return arch.guide_flows(found, FOCUS, WORDS, 30).select(F.col("rank").cast("long").alias("rank"), "component", "category", "entry_path", "entry_symbol")


@query(f"""WITH {tables.CODE_NODES}, {tables.CALL_EDGES}, {queries.COMP}, ce AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM edges JOIN comp a ON a.node_id = src JOIN comp b ON b.node_id = dst)
SELECT coalesce(array_to_string(list_sort(list(DISTINCT dst)), ','), '') AS deps FROM ce WHERE src IN ('nation_1', 'nation_11') AND dst NOT IN ('nation_1', 'nation_11')""")
def focus_dependencies(spark, sf_dir):
    """What two nations' orders call in others."""
    n = tables.code_nodes(spark, sf_dir).select("node_id", "path")
    at = lambda end: n.select(F.col("node_id").alias(end), F.col("path").alias(f"{end}_path"))
    ends = tables.call_edges(spark, sf_dir).select("src", "dst").join(at("src"), "src").join(at("dst"), "dst")
    edges = graph.component_edges(ends.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")))
    nodes = arch.with_component(n).select(F.col("component").alias("node")).distinct()
    return arch.focus_dependencies(graph.dependencies(nodes, edges), FOCUS).select(F.array_join("deps", ",").alias("deps"))


def _careless(name: str, labels: list[str], ends: list[tuple[str, str]], faults: dict | None) -> str:
    """Drafts that lack a header, state a stray node or lead nowhere, by the number in the name; a redraft mends one kind of fault."""
    k, text = int(name[1:]), redraft.plain_draft(name, labels, ends, faults)
    told = faults or {"errors": [1], "unknown_nodes": [1], "unknown_edges": [1]}
    headless = k % 5 == 0 and faults is None
    stray = k % 3 == 0 and (faults is None or bool(told["errors"]))
    astray = k % 7 == 0 and (faults is None or bool(told["errors"] or told["unknown_nodes"]))
    return (text.removeprefix("graph TD\n") if headless else text) + ('\n    stray["elsewhere"]' if stray else "") + ("\n    n0 --> nowhere" if astray else "")


def _order_drafts(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All drafts of the customers' diagrams, in at most three rounds, and the allowed labels."""
    labels, ends = tables.order_diagrams(spark, sf_dir)
    listed = labels.groupBy("name").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    joined = ends.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("ends"))
    allowed = labels.select("label").distinct()
    return redraft.redraft(listed.join(joined, "name"), allowed, _careless, coverage=1.0, most=3)[0], allowed


@query("""WITH k AS (SELECT DISTINCT o_custkey AS k, (o_custkey % 5 = 0)::INT AS h, (o_custkey % 3 = 0)::INT AS s, (o_custkey % 7 = 0)::INT AS a FROM orders),
r AS (SELECT *, unnest(range(1, least(h + s + a, 2) + 2)) AS round FROM k)
SELECT 'c' || k AS name, round::INT AS round, CASE WHEN h = 1 AND round = 1 THEN 1 ELSE 0 END::BIGINT AS errors, CASE WHEN s = 1 AND round <= 1 + h THEN 1 ELSE 0 END::BIGINT AS unknown_nodes, CASE WHEN a = 1 AND round <= 1 + h + s THEN 1 ELSE 0 END::BIGINT AS unknown_edges FROM r""")
def redraft_rounds(spark, sf_dir):
    """Every draft of the customers' diagrams with the number of its faults of each kind: only what failed is drafted again."""
    drafts, allowed = _order_drafts(spark, sf_dir)
    key = F.concat_ws("/", "name", "round")
    found = mermaid.faults(drafts.select(key.alias("name"), "text"), allowed).withColumnRenamed("name", "_key")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return drafts.join(found, key == F.col("_key"), "left").select("name", "round", *map(count, ("errors", "unknown_nodes", "unknown_edges")))


#: Nations with a package for each customer beside its file.
PACKED = "packed AS (SELECT node_id, kind, path, symbol, loc FROM nodes UNION ALL SELECT 'd' || node_id, 'pkg', left(path, -3), symbol, NULL FROM nodes WHERE kind = 'file')"


def _packed(spark, sf_dir: str) -> DataFrame:
    nodes = tables.code_nodes(spark, sf_dir)
    own = nodes.filter("kind = 'file'").withColumns({"node_id": F.concat(F.lit("d"), "node_id"), "kind": F.lit("pkg"), "path": F.regexp_replace("path", "[.]py$", ""), "loc": F.lit(None).cast("int")})
    return nodes.unionByName(own)


def _component_edges(spark, sf_dir: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("src/"), F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))).alias(c)
    return graph.component_edges(tables.nation_edges(spark, sf_dir).select(path("src"), path("dst")))


PACKED_COMP = queries.COMP.replace("FROM nodes", "FROM packed")
ROLE_TAGS = """tags AS (SELECT component, unnest(list_filter([CASE WHEN contains(path, 'router') OR contains(path, 'api/') OR contains(path, '/routes/') THEN 'api' END, CASE WHEN contains(path, 'worker') OR contains(path, 'workflow') OR contains(path, 'temporal') THEN 'worker' END,
  CASE WHEN contains(path, 'test') OR contains(path, 'spec') OR contains(path, 'fixtures') THEN 'tests' END, CASE WHEN contains(path, 'lambda') THEN 'lambda' END, CASE WHEN contains(path, 'infra') OR contains(path, 'terraform') THEN 'infrastructure' END,
  CASE WHEN contains(component, 'app') OR contains(component, 'ui') OR contains(component, 'web') THEN 'frontend' END], lambda x: x IS NOT NULL)) AS role FROM comp),
roles AS (SELECT DISTINCT component, role FROM tags UNION SELECT component, 'other' FROM comp WHERE component NOT IN (SELECT component FROM tags))"""


@query(f"WITH {tables.CODE_NODES}, {queries.COMP}, {ROLE_TAGS} SELECT role, string_agg(component, ',' ORDER BY component) AS components FROM roles GROUP BY role")
def role_clusters(spark, sf_dir):
    """Components under each of their roles."""
    return arch.role_clusters(tables.code_nodes(spark, sf_dir)).withColumn("components", F.array_join("components", ","))


@query(f"WITH {tables.CODE_NODES}, {PACKED}, {PACKED_COMP} SELECT component, string_agg(DISTINCT path, ',' ORDER BY path) AS packages FROM comp WHERE kind = 'pkg' GROUP BY component")
def component_packages(spark, sf_dir):
    """All packages of each component."""
    return arch.component_packages(_packed(spark, sf_dir)).withColumn("packages", F.array_join("packages", ","))


@query(f"""WITH {tables.CODE_NODES}, {tables.NATION_EDGES}, {PACKED}, {PACKED_COMP}, {ROLE_TAGS},
st AS (SELECT component, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind IN ('func', 'block')) AS functions FROM comp GROUP BY component),
pk AS (SELECT component, string_agg(path, ',' ORDER BY path) AS packages FROM (SELECT DISTINCT component, path, dense_rank() OVER (PARTITION BY component ORDER BY path) AS n FROM comp WHERE kind = 'pkg') WHERE n <= 20 GROUP BY component),
ne AS (SELECT DISTINCT {queries.PATH_NAME.format('src')} AS src, {queries.PATH_NAME.format('dst')} AS dst FROM nedges WHERE src <> dst),
de AS (SELECT src AS component, string_agg(dst, ',' ORDER BY dst) AS deps FROM ne GROUP BY src), us AS (SELECT dst AS component, string_agg(src, ',' ORDER BY src) AS dependents FROM ne GROUP BY dst),
ro AS (SELECT component, string_agg(role, ',' ORDER BY role) AS roles FROM roles GROUP BY component),
ke AS (SELECT component, string_agg(path, ',' ORDER BY n) AS key_files FROM (SELECT component, path, row_number() OVER (PARTITION BY component ORDER BY loc DESC, list_last(string_split(path, '/'))) AS n FROM comp WHERE kind = 'file') WHERE n <= 5 GROUP BY component)
SELECT component, files, classes, functions, coalesce(packages, '') AS packages, coalesce(deps, '') AS deps, coalesce(dependents, '') AS dependents, coalesce(roles, '') AS roles, coalesce(key_files, '') AS key_files
FROM st LEFT JOIN pk USING (component) LEFT JOIN de USING (component) LEFT JOIN us USING (component) LEFT JOIN ro USING (component) LEFT JOIN ke USING (component)""")
def component_context(spark, sf_dir):
    """What a drafter is told of each component: at most 20 packages, its best files, both directions of dependencies, roles."""
    got = arch.component_context(_packed(spark, sf_dir), _component_edges(spark, sf_dir))
    return got.withColumns({c: F.array_join(c, ",") for c in ("packages", "deps", "dependents", "roles", "key_files")})


@query("""SELECT user_id AS query, max(event_id) AS steps, count(*) FILTER (event_type = 'view') AS nodes_visited, count(*) FILTER (event_type = 'purchase') AS answers_found, 50 AS budget FROM events GROUP BY user_id""")
def search_statistics(spark, sf_dir):
    """Steps, visited nodes and answers of each trace, where users' views evaluate and purchases answer."""
    kind = F.col("event_type")
    steps = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("step"), F.when(kind == "view", "evaluate").when(kind == "purchase", "answer").otherwise(kind).alias("event"))
    return search.statistics(steps, 50)


@query(r"""SELECT c_custkey, '{"path": "c:\\dir\\' || c_custkey || '\n\u0041\\d", "name": "' || c_name || '\\", "x": "\"\\(' || c_nationkey || '"}' AS text,
'c:\dir\' || c_custkey || chr(10) || 'A\d' AS path, '"\(' || c_nationkey AS x FROM customer""")
def json_repair(spark, sf_dir):
    """Models' JSON with backslashes that start no escape, repaired and then parsed."""
    c = tables.read(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    broken = F.concat(F.lit(r'{"path": "c:\dir\\'), key, F.lit(r'\n\u0041\d", "name": "'), "c_name", F.lit(r'\\", "x": "\"\('), nation, F.lit('"}'))
    fixed = repair_json(broken)
    return c.select("c_custkey", fixed.alias("text"), F.get_json_object(fixed, "$.path").alias("path"), F.get_json_object(fixed, "$.x").alias("x"))
