"""Trees, graphs and code-like indexes that Spark derives from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index-like tree: regions as repositories, nations as packages, customers as files, orders as functions."""
    region, nation, customer, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    ids = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    flat = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))
    none = F.lit(None)
    pkg = nation.withColumn("path", F.concat(F.lit("src/"), flat("n_name")))
    stem = F.get(F.array(*map(F.lit, ("cli", "worker", "routes", "model", "test", "api", "util"))), (F.col("c_custkey") % 7).cast("int"))
    file = customer.join(F.broadcast(pkg), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("path", F.concat("path", F.lit("/"), stem, F.lit("_"), F.col("c_custkey").cast("string"), F.lit(".py")))  # nation has 25 rows at every scale
    symbol = F.get(F.array(*map(F.lit, ("main", "handle_order", "get", "load", "run_job", "_private", "task"))), (F.col("o_orderkey") % 7).cast("int"))
    func = orders.join(file.select("c_custkey", "path"), F.col("o_custkey") == F.col("c_custkey"))
    out = region.select(ids("r", "r_regionkey").alias("node_id"), none.cast("string").alias("parent_id"), F.lit("repo").alias("kind"), F.lit("").alias("path"), F.col("r_name").alias("symbol"), none.cast("int").alias("loc"), F.lit(0.0).alias("value"))
    out = out.unionByName(pkg.select(ids("n", "n_nationkey").alias("node_id"), ids("r", "n_regionkey").alias("parent_id"), F.lit("pkg").alias("kind"), "path", F.col("n_name").alias("symbol"), none.cast("int").alias("loc"), F.lit(0.0).alias("value")))
    out = out.unionByName(file.select(ids("c", "c_custkey").alias("node_id"), ids("n", "c_nationkey").alias("parent_id"), F.lit("file").alias("kind"), "path", F.col("c_name").alias("symbol"), F.abs(F.floor("c_acctbal")).cast("int").alias("loc"), F.lit(0.0).alias("value")))
    return out.unionByName(func.select(ids("o", "o_orderkey").alias("node_id"), ids("c", "o_custkey").alias("parent_id"), F.lit("func").alias("kind"), "path", symbol.alias("symbol"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("loc"), F.col("o_totalprice").alias("value")))


CODE_NODES = """pkgs AS (SELECT *, 'src/' || lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g')) AS ppath FROM nation),
files AS (SELECT *, ppath || '/' || (['cli','worker','routes','model','test','api','util'])[(c_custkey % 7 + 1)::INT] || '_' || c_custkey || '.py' AS fpath FROM customer JOIN pkgs ON c_nationkey = n_nationkey),
nodes AS (
  SELECT 'r' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id, 'repo' AS kind, '' AS path, r_name AS symbol, NULL::INT AS loc, 0.0::DOUBLE AS value FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'pkg', ppath, n_name, NULL, 0.0 FROM pkgs
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'file', fpath, c_name, abs(floor(c_acctbal))::INT, 0.0 FROM files
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'func', fpath, (['main','handle_order','get','load','run_job','_private','task'])[(o_orderkey % 7 + 1)::INT], floor(o_totalprice / 1000)::INT, o_totalprice FROM orders JOIN files ON o_custkey = c_custkey)"""


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, type, detail): an order calls the order whose key is the part's."""
    line = read(spark, sf_dir, "lineitem")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return line.select(key("o", "l_orderkey").alias("src"), key("o", "l_partkey").alias("dst"), F.lit("call").alias("type"), key("part_", "l_partkey").alias("detail"))


CALL_EDGES = "edges AS (SELECT 'o' || l_orderkey AS src, 'o' || l_partkey AS dst, 'call' AS type, 'part_' || l_partkey AS detail FROM lineitem)"


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): nations of suppliers and of the customers they deliver to, distinct."""
    line, orders, supplier, customer, nation = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "customer", "nation"))
    pairs = (
        line.select("l_orderkey", "l_suppkey")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .select("s_nationkey", "c_nationkey")
        .distinct()
    )
    name = lambda k, to: nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(to))
    return pairs.join(name("s_nationkey", "src"), "s_nationkey").join(name("c_nationkey", "dst"), "c_nationkey").select("src", "dst")


NATION_EDGES = """nedges AS (SELECT DISTINCT a.n_name AS src, b.n_name AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey)"""

HOST = r"^[a-z]+://([^/?#]+)"
PATH = r"^[a-z]+://[^/?#]+/?([^?#]*)"


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, lang, path, body) of pages."""
    p = read(spark, sf_dir, "pages")
    path = F.regexp_extract("url", PATH, 1)
    return p.select("page_id", F.regexp_extract("url", HOST, 1).alias("host"), F.split(path, "/")[0].alias("lang"), path.alias("path"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"))


SITE_PAGES = rf"""site AS (SELECT page_id, regexp_extract(url, '{HOST}', 1) AS host, string_split(regexp_extract(url, '{PATH}', 1), '/')[1] AS lang,
  regexp_extract(url, '{PATH}', 1) AS path, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages)"""


def site_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of pages: web, hosts, languages of a host, pages."""
    p = site_pages(spark, sf_dir).drop("body")
    none = F.lit(None).cast("string")
    section = F.concat("host", F.lit("/"), "lang")
    root = p.agg(F.lit("web").alias("node_id"), none.alias("parent_id"), F.lit("repo").alias("kind"), F.lit("").alias("path"), none.alias("symbol"))
    host = p.select(F.col("host").alias("node_id"), F.lit("web").alias("parent_id"), F.lit("pkg").alias("kind"), F.col("host").alias("path"), none.alias("symbol")).distinct()
    lang = p.select(section.alias("node_id"), F.col("host").alias("parent_id"), F.lit("pkg").alias("kind"), section.alias("path"), F.col("lang").alias("symbol")).distinct()
    page = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("node_id"), section.alias("parent_id"), F.lit("func").alias("kind"), F.concat("host", F.lit("/"), "path").alias("path"), F.element_at(F.split("path", "/"), -1).alias("symbol"))
    return root.unionByName(host).unionByName(lang).unionByName(page).withColumn("ord", F.col("node_id"))


SITE_NODES = """nodes AS (SELECT 'web' AS node_id, NULL::VARCHAR AS parent_id, 'repo' AS kind, '' AS path, NULL::VARCHAR AS symbol
  UNION ALL SELECT DISTINCT host, 'web', 'pkg', host, NULL FROM site
  UNION ALL SELECT DISTINCT host || '/' || lang, host, 'pkg', host || '/' || lang, lang FROM site
  UNION ALL SELECT 'p' || page_id, host || '/' || lang, 'func', host || '/' || path, list_last(string_split(path, '/')) FROM site)"""


def order_diagrams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels (name, label) and edges (name, src, dst) of a diagram for each customer: order priorities lead to states."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), "o_orderpriority", "o_orderstatus").distinct()
    labels = o.select("name", F.col("o_orderpriority").alias("label")).unionByName(o.select("name", F.col("o_orderstatus").alias("label")))
    return labels, o.select("name", F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("dst"))


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, text): for each customer a diagram of all orders, with hyphens in ids, a subgraph, a comment, empty labels, several edges a line, chains and repeated edges.

    One in five customers has no header, one in eleven no text.
    """
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    pri, state = F.concat(F.lit("p-"), F.left("o_orderpriority", F.lit(1))), F.concat(F.lit("s-"), "o_orderstatus")
    arrow = F.get(F.array(*map(F.lit, (" --> ", " -.-> ", " --|to|> "))), (F.col("o_orderkey") % 3).cast("int"))
    tail = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("; "), state, F.lit(" --> z-"), (F.col("o_orderkey") % 3).cast("string"))).when(F.col("o_orderkey") % 4 == 1, " --> end").otherwise("")
    shape = F.when(F.col("o_orderstatus") == "F", F.concat(state, F.lit("((F))"))).when(F.col("o_orderstatus") == "O", F.concat(state, F.lit("{ 'O' }"))).otherwise(F.concat(state, F.lit("[]")))
    line = lambda k, key, x: F.struct(F.lit(k).alias("k"), key.alias("key"), F.concat(F.lit("  "), x).alias("line"))
    three = F.array(line(1, F.lit(0).cast("long"), F.concat(pri, F.lit('["'), "o_orderpriority", F.lit('"]'))), line(2, F.lit(0).cast("long"), shape), line(3, F.col("o_orderkey"), F.concat(pri, arrow, state, tail)))
    body = o.select("o_custkey", F.explode(three).alias("x")).distinct().groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    head = F.when(F.col("o_custkey") % 5 == 0, "%% no header\n").otherwise("graph LR\n")
    text = F.when(F.col("o_custkey") % 11 == 0, "").otherwise(F.concat(head, F.lit("subgraph all-orders\n\n"), "body"))
    return body.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), text.alias("text"))


ORDER_TEXTS = """met AS (SELECT 'c' || o_custkey AS name, o_custkey, o_orderkey, o_orderpriority AS pri, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 's-' || o_orderstatus END AS state FROM orders WHERE o_custkey % 11 <> 0),
drawn AS (SELECT name, pri AS src, state AS dst FROM met UNION ALL SELECT name, state, 'z-' || o_orderkey % 3 FROM met WHERE o_orderkey % 4 = 0),
told AS (SELECT DISTINCT name, unnest([pri, state]) AS label FROM met),
ok AS (SELECT DISTINCT unnest([o_orderpriority, o_orderstatus]) AS label FROM orders WHERE o_orderpriority <> '5-LOW'),
wrong AS (SELECT 'c' || o_custkey AS name, CASE WHEN o_custkey % 11 = 0 THEN 'empty diagram' ELSE concat_ws(';', CASE WHEN o_custkey % 5 = 0 THEN 'missing header' END, CASE WHEN bool_or(o_orderstatus NOT IN ('F', 'O')) THEN 'missing label: s-P' END) END AS errors FROM orders GROUP BY o_custkey)"""
