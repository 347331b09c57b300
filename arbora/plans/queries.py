"""The registry: one query for each operator over the given tables, and its SQL where SQL can tell it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions import paths, text
from arbora.operators import arch, bm25, graph, mermaid, resolve, search, tree
from arbora.plans import tables
from arbora.plans.tables import read
from arbora.sources import extract
from arbora.sources.shared import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


TOK = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce({0},''),'[^A-Za-z0-9]+',' ','g'),'([A-Z])',' \1','g')),' +'), lambda x: x <> '')"


def index_sql(docs: str, doc: str, body: str) -> str:
    return f"""toks AS (SELECT {doc} AS doc, {TOK.format(body)} AS w FROM {docs}),
each AS (SELECT doc, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM toks),
tfs AS (SELECT doc, term, count(*) AS tf, min(pos) AS pos FROM each GROUP BY doc, term),
post AS (SELECT doc, term, tf FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY tf DESC, pos) AS n FROM tfs) WHERE n <= 300),
lens AS (SELECT doc, sum(tf)::BIGINT AS dl FROM post GROUP BY doc),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS (SELECT (SELECT count(*) FROM toks) AS n, (SELECT sum(tf) FROM post) / (SELECT count(*) FROM toks) AS avgdl)"""


TERMS = f"terms AS (SELECT query, term, count(*) AS qn FROM (SELECT item_id AS query, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY query, term)"
SCORES = """scored AS (SELECT query, post.doc, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM post JOIN terms USING (term) JOIN dfs USING (term) JOIN lens USING (doc), corpus GROUP BY query, post.doc),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM scored WHERE score > 0)"""
DOC_INDEX = index_sql("documents", "doc_id", "text")


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, bm25.postings(docs, "doc_id", F.col("text"))


# search index


@query(f"WITH {DOC_INDEX} SELECT doc, term, tf FROM post")
def postings(spark, sf_dir):
    return _documents(spark, sf_dir)[1]


@query(f"WITH {DOC_INDEX} SELECT doc, dl FROM lens")
def doc_lengths(spark, sf_dir):
    return bm25.lengths(_documents(spark, sf_dir)[1])


@query(f"WITH {DOC_INDEX} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM dfs, corpus")
def term_frequencies(spark, sf_dir):
    docs, post = _documents(spark, sf_dir)
    both = bm25.frequencies(post).join(F.broadcast(bm25.corpus(docs, post)))  # one row
    return both.select("term", "df", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {DOC_INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM corpus")
def corpus_stats(spark, sf_dir):
    return rounded(bm25.corpus(*_documents(spark, sf_dir)), "avgdl")


@query(f"WITH {DOC_INDEX}, {TERMS}, {SCORES} SELECT query, doc, round(score, 6) AS score, rank FROM top WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    docs, post = _documents(spark, sf_dir)
    post = materialize(post, "postings")  # read three times
    terms = bm25.query_terms(read(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return rounded(bm25.top_k(bm25.scores(post, bm25.corpus(docs, post), terms)), "score")


@query(f"WITH {DOC_INDEX}, t2 AS ({TERMS[10:-1]}), terms AS (SELECT query, term, 2 * qn AS qn FROM t2), {SCORES} SELECT query, doc, round(score, 6) AS score, rank FROM top WHERE rank <= 5")
def bm25_repeated_terms(spark, sf_dir):
    docs, post = _documents(spark, sf_dir)
    post = materialize(post, "postings")  # read three times
    twice = read(spark, sf_dir, "benchmark").withColumn("text", F.concat("text", F.lit(" "), "text"))
    terms = bm25.query_terms(twice, "item_id", F.col("text"))
    return rounded(bm25.top_k(bm25.scores(post, bm25.corpus(docs, post), terms), 5), "score")


@query(f"WITH {DOC_INDEX}, {TERMS} SELECT query, count(DISTINCT doc) AS candidates FROM post JOIN terms USING (term) GROUP BY query")
def bm25_candidates(spark, sf_dir):
    _, post = _documents(spark, sf_dir)
    terms = bm25.query_terms(read(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return bm25.candidates(post, terms).groupBy("query").agg(F.count("*").alias("candidates"))


# text and name functions


@query("SELECT doc_id, sha1(concat_ws(chr(9), 'file', coalesce(source, ''), coalesce(lang, ''), '1', coalesce(n_chars::VARCHAR, '0'))) AS node_id FROM documents")
def stable_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", text.stable_id(F.lit("file"), F.coalesce("source", F.lit("")), F.col("lang"), F.lit(1), F.col("n_chars")).alias("node_id"))


@query(r"""SELECT doc_id, left(nullif(rtrim(regexp_extract(text, '(\S[^\n]*)', 1)), ''), 400) AS first,
  md5(CASE WHEN length(text) > 6000 THEN rtrim(left(text, 4200)) || chr(10) || '...' || chr(10) || ltrim(right(text, 1500)) ELSE text END) AS compressed,
  array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END::INT AS n_lines,
  CASE WHEN length(text) > 90 THEN rtrim(left(text, 87)) || '...' ELSE text END AS short FROM documents""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        text.first_line(t).alias("first"),
        F.md5(text.compress(t)).alias("compressed"),
        text.snippet(t, F.lit(2), F.lit(4)).alias("lines"),
        text.line_count(t).alias("n_lines"),
        text.ellipsis(t, 90).alias("short"),
    )


@query(r"""WITH p AS (SELECT *, repeat('_', (p_partkey % 3)::INT) || replace(p_name, ' ', '_') || repeat('_', (p_partkey % 4)::INT) AS name FROM part)
SELECT p_partkey, CASE WHEN starts_with(name, '__') AND NOT ends_with(name, '__') THEN 'private' WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END AS visibility,
  (p_brand = upper(p_brand) AND p_brand <> lower(p_brand) AND length(p_brand) >= 2) AS constant,
  CASE WHEN regexp_matches(d, '^[0-9]') THEN 'pkg_' || d ELSE d END AS diagram_id, printf('%.3f', p_retailprice) AS price,
  CASE WHEN p_size > 0 THEN p_size || ' files' || CASE WHEN p_partkey % 2 > 0 THEN ', ' || p_partkey % 2 || ' classes' ELSE '' END WHEN p_partkey % 2 > 0 THEN p_partkey % 2 || ' classes' ELSE 'empty' END AS stats
FROM (SELECT *, regexp_replace(p_size || '-' || p_type, '[^0-9a-zA-Z_]', '_', 'g') AS d FROM p)""")
def name_functions(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.concat(F.repeat(F.lit("_"), (key % 3).cast("int")), F.replace("p_name", F.lit(" "), F.lit("_")), F.repeat(F.lit("_"), (key % 4).cast("int")))
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        text.visibility(name).alias("visibility"),
        text.is_constant_name(F.col("p_brand")).alias("constant"),
        text.diagram_id(F.concat(F.col("p_size").cast("string"), F.lit("-"), "p_type")).alias("diagram_id"),
        text.score_text(F.col("p_retailprice")).alias("price"),
        text.stats_text(files=F.col("p_size"), classes=key % 2).alias("stats"),
    )


@query(rf"""WITH {tables.SITE_PAGES} SELECT page_id, CASE WHEN path = '' THEN 'root' WHEN p[1] IN ('src', 'apps', 'packages') AND len(p) > 1 THEN p[2] ELSE p[1] END AS component,
  array_to_string(list_filter(string_split(replace(path, '/', '.'), '.'), lambda x: x <> ''), '|') AS segments FROM (SELECT *, string_split(path, '/') AS p FROM site)""")
def path_functions(spark, sf_dir):
    p = tables.site_pages(spark, sf_dir)
    return p.select("page_id", paths.component_name(F.col("path")).alias("component"), F.array_join(paths.segments(F.col("path")), "|").alias("segments"))


# trees

NODES = tables.CODE_NODES
UP = "up(node_id, ancestor, depth) AS (SELECT node_id, node_id, 0 FROM nodes UNION ALL SELECT up.node_id, nodes.parent_id, depth + 1 FROM up JOIN nodes ON up.ancestor = nodes.node_id WHERE nodes.parent_id IS NOT NULL)"


@query(f"WITH {NODES} SELECT c.node_id, c.kind, p.node_id AS parent, p.kind AS parent_kind FROM nodes c LEFT JOIN nodes p ON c.parent_id = p.node_id")
def tree_parent_child(spark, sf_dir):
    n = tables.code_nodes(spark, sf_dir)
    p = n.select(F.col("node_id").alias("parent"), F.col("kind").alias("parent_kind"))
    return n.join(p, n["parent_id"] == p["parent"], "left").select("node_id", "kind", "parent", "parent_kind")


@query(f"WITH {NODES} SELECT parent_id, array_to_string(list_sort(list(node_id)), ',') AS children FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id")
def tree_children(spark, sf_dir):
    return tree.children(tables.code_nodes(spark, sf_dir)).withColumn("children", F.array_join("children", ","))


@query(f"WITH RECURSIVE {NODES}, {UP} SELECT ancestor AS node_id, round(sum(value), 2) AS total FROM up JOIN nodes USING (node_id) GROUP BY ancestor")
def subtree_sum(spark, sf_dir):
    return rounded(tree.rollup(tables.code_nodes(spark, sf_dir), {"total": F.col("value")}), "total", places=2)


@query(f"WITH RECURSIVE {NODES}, {UP} SELECT a.node_id, a.parent_id, a.path, count(*) FILTER (d.kind = 'file') AS files, count(*) FILTER (d.kind = 'class') AS classes, count(*) FILTER (d.kind IN ('func', 'block')) AS functions FROM up JOIN nodes a ON up.ancestor = a.node_id JOIN nodes d ON up.node_id = d.node_id WHERE a.kind IN ('pkg', 'repo') GROUP BY a.node_id, a.parent_id, a.path")
def subtree_counts(spark, sf_dir):
    return arch.directory_summary(tables.code_nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {NODES}, {UP} SELECT ancestor, node_id, depth FROM up WHERE ancestor LIKE 'r%' AND depth > 0")
def tree_descendants(spark, sf_dir):
    return tree.descendants(tree.ancestors(tables.code_nodes(spark, sf_dir)), F.startswith("ancestor", F.lit("r")))


@query(f"WITH RECURSIVE {NODES}, {UP} SELECT up.node_id, arg_min(ancestor, depth) AS ancestor FROM up JOIN nodes a ON up.ancestor = a.node_id WHERE a.kind = 'pkg' GROUP BY up.node_id")
def nearest_ancestor(spark, sf_dir):
    n = tables.code_nodes(spark, sf_dir)
    return tree.nearest(tree.ancestors(n), n.filter("kind = 'pkg'").select(F.col("node_id").alias("ancestor")))


@query(f"WITH {NODES} SELECT a.node_id AS node_id, a.node_id AS ancestor, 0 AS depth FROM nodes a WHERE kind = 'pkg' UNION ALL SELECT node_id, parent_id, 1 FROM nodes WHERE kind = 'pkg'")
def packages_under(spark, sf_dir):
    n = tables.code_nodes(spark, sf_dir)
    return tree.ancestors(n, hop=F.col("kind") == "pkg").filter(F.startswith("node_id", F.lit("n")))


@query("SELECT o_custkey::VARCHAR AS node_id, min(o_orderkey) AS ord, arg_max(o_orderstatus, o_orderkey) AS symbol FROM orders GROUP BY o_custkey")
def load_nodes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("node_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("symbol"))
    return tree.load_nodes(o)


# hierarchical search on the tree of pages


SITE = f"{tables.SITE_PAGES}, {tables.SITE_NODES}, {index_sql('site', chr(39) + 'p' + chr(39) + ' || page_id', 'body')}, {TERMS}, {SCORES}"
LOCAL = f"""{SITE}, hits AS (SELECT query, doc AS node_id, score FROM top WHERE rank <= 200),
up(query, node_id, v) AS (SELECT query, node_id, score FROM hits UNION ALL SELECT up.query, nodes.parent_id, v FROM up JOIN nodes ON up.node_id = nodes.node_id WHERE nodes.parent_id IS NOT NULL),
agg AS (SELECT query, node_id, sum(v) AS below FROM up GROUP BY query, node_id),
both_ AS (SELECT b.item_id AS query, nodes.*, coalesce(h.score, 0.0) AS local_score, coalesce(agg.below, 0.0) + 0.1 * len(list_filter(list_filter(regexp_split_to_array(lower(trim(b.text)), '\\s+'), lambda x: x <> ''),
  lambda x: contains(lower(coalesce(symbol, '')), x) OR contains(lower(path), x))) AS aggregate_score FROM nodes CROSS JOIN benchmark b LEFT JOIN hits h ON h.query = b.item_id AND h.node_id = nodes.node_id LEFT JOIN agg ON agg.query = b.item_id AND agg.node_id = nodes.node_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query, parent_id ORDER BY round(aggregate_score, 9) DESC, node_id) AS place FROM both_),
reach AS (SELECT query, node_id, 0 AS step FROM ranked WHERE parent_id IS NULL UNION ALL SELECT r.query, r.node_id, step + 1 FROM reach JOIN ranked r ON r.query = reach.query AND r.parent_id = reach.node_id WHERE r.place <= 10)"""


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, BM25 results and queries (query, text)."""
    docs = tables.site_pages(spark, sf_dir).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc"), "body")
    post = bm25.postings(docs, "doc", F.col("body"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    top = bm25.top_k(bm25.scores(post, bm25.corpus(docs, post), bm25.query_terms(items, "query", F.col("text"))), search.pre_limit())
    return tables.site_nodes(spark, sf_dir), top, items


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, top, items = _site(spark, sf_dir)
    return search.beam_reach(nodes, materialize(top.select("query", F.col("doc").alias("node_id"), "score"), "hits"), items)


@query(f"WITH RECURSIVE {LOCAL} SELECT query, node_id, round(below, 6) AS below, round(aggregate_score, 6) AS aggregate_score FROM agg JOIN both_ USING (query, node_id)")
def url_tree_rollup(spark, sf_dir):
    """Each query's BM25 over the subtrees that hold a hit, and those nodes' scores."""
    nodes, top, items = _site(spark, sf_dir)
    totals = search.subtree_scores(nodes, top.select("query", F.col("doc").alias("node_id"), "score"))
    told = totals.join(nodes, "node_id").join(items, "query")
    told = told.withColumn("aggregate_score", search.node_score(F.col("below"), F.col("text"), F.col("symbol"), F.col("path")))
    return rounded(told.select("query", "node_id", "below", "aggregate_score"), "below", "aggregate_score")


@query(f"WITH RECURSIVE {LOCAL} SELECT query, node_id, place AS rank FROM ranked JOIN reach USING (query, node_id) WHERE parent_id IS NOT NULL")
def beam_children(spark, sf_dir):
    """The children that each search may expand, by rank below their parent."""
    return _reached(spark, sf_dir).filter("parent_id is not null").select("query", "node_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH RECURSIVE {LOCAL} SELECT query, node_id, step FROM reach")
def beam_reach(spark, sf_dir):
    return _reached(spark, sf_dir).select("query", "node_id", "step")


@query(f"WITH RECURSIVE {LOCAL} SELECT query, node_id, rank, hybrid_score FROM (SELECT query, node_id, round(2 * local_score + aggregate_score, 6) AS hybrid_score, row_number() OVER (PARTITION BY query ORDER BY round(2 * local_score + aggregate_score, 9) DESC, node_id) AS rank FROM reach JOIN both_ USING (query, node_id) WHERE kind = 'func') WHERE rank <= 10")
def hybrid_search(spark, sf_dir):
    """The answers of a search whose budget covers all that beams reach."""
    found = _reached(spark, sf_dir).filter(F.col("kind").isin(*search.LEAVES)).drop("rank")
    found = found.withColumn("hybrid_score", search.hybrid(F.col("local_score"), F.col("aggregate_score")))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("hybrid_score", 9)), "node_id")
    top = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= search.TOP)
    return rounded(top.select("query", "node_id", "rank", "hybrid_score"), "hybrid_score")


_LEAF = "IN ('func', 'block', 'const')"


@query(
    f"""WITH RECURSIVE {LOCAL}, kids AS (SELECT query, parent_id, list({{'s': -round(aggregate_score, 9), 'n': node_id, 'k': kind}}) AS x FROM ranked WHERE place <= 3 AND parent_id IS NOT NULL GROUP BY query, parent_id),
run(query, step, popped, heap) AS (SELECT query, 0, {{'s': 0.0::DOUBLE, 'n': '', 'k': ''}}, [{{'s': -round(aggregate_score, 9), 'n': node_id, 'k': kind}}] FROM ranked WHERE parent_id IS NULL
  UNION ALL SELECT run.query, step + 1, heap[1], list_sort(CASE WHEN heap[1].k {_LEAF} OR x IS NULL THEN heap[2:] ELSE list_concat(heap[2:], x) END) FROM run LEFT JOIN kids ON kids.query = run.query AND kids.parent_id = heap[1].n WHERE step < 12 AND len(heap) > 0)
SELECT query, step - 1 AS step, CASE WHEN popped.k {_LEAF} THEN 'answer' ELSE 'expand' END AS event, popped.n AS node_id, round(-popped.s, 6) AS score FROM run WHERE step > 0"""
)
def best_first_trace(spark, sf_dir):
    """What each search pops within a budget of twelve steps and beams of three."""
    nodes, top, items = _site(spark, sf_dir)
    hits = materialize(top.select("query", F.col("doc").alias("node_id"), "score"), "hits")
    return rounded(search.best_first(nodes, hits, items, budget=12, beam=3), "score")


@query()
def best_first_search(spark, sf_dir):
    """Search with a budget that binds over many steps; best_first_trace holds a short one against SQL."""
    nodes, top, items = _site(spark, sf_dir)
    answers, _ = search.search(nodes, materialize(top, "bm25"), items)
    return rounded(answers, "local_score", "aggregate_score", "hybrid_score")


@query()
def guided_search(spark, sf_dir):
    """Search by a judge of relevance, here the share of a query's words."""
    nodes = tables.site_nodes(spark, sf_dir).withColumn("summary", F.col("path"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return rounded(search.guided(nodes, items), "score")


# resolution and windows


@query("SELECT event_id, user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS signup FROM events")
def asof_resolve(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    facts = e.filter("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("signup"))
    return resolve.as_of(e.drop("event_type"), facts, ["user_id"], at="event_id", value="signup")


@query("SELECT e.event_id, s.last_id FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS last_id FROM events WHERE event_type = 'signup' GROUP BY user_id) s USING (user_id)")
def last_defined(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    facts = e.filter("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("last_id"))
    return resolve.last_defined(e.select("event_id", "user_id"), facts, ["user_id"], value="last_id", order="event_id").select("event_id", "last_id")


@query("""WITH s AS (SELECT user_id, event_id AS a, event_id + 400 * (1 + event_id % 5) AS b FROM events WHERE event_type = 'signup')
SELECT event_id, user_id, a, b FROM (SELECT e.event_id, e.user_id, a, b, row_number() OVER (PARTITION BY e.event_id ORDER BY b - a, a) AS n FROM events e JOIN s USING (user_id) WHERE event_type = 'click' AND a <= e.event_id AND e.event_id <= b) WHERE n = 1""")
def interval_innermost(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    spans = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("a"), F.expr("event_id + 400 * (1 + event_id % 5)").alias("b"))
    points = e.filter("event_type = 'click'").select("event_id", "user_id")
    return resolve.innermost(points, spans, ["user_id"], at=F.col("event_id"), start="a", end="b", tie="a", width=1000).select("event_id", "user_id", "a", "b")


@query("SELECT event_id, user_id, place, hit AS cap_hit FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, count(*) OVER (PARTITION BY user_id) > 5 AS hit FROM events) WHERE place <= 5")
def cap_per_group(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    return resolve.capped(e, ["user_id"], [F.col("event_id")], 5).select("event_id", "user_id", F.col("place").cast("long").alias("place"), "cap_hit")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events")
def sticky_last(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", search.sticky_last(e, F.col("event_id"), F.col("event_type") == "view", "user_id", "event_id").alias("last_view"))


# graphs


@query(f"WITH {tables.NATION_EDGES} SELECT n_name AS node, coalesce((SELECT array_to_string(list_sort(list(DISTINCT dst)), ',') FROM nedges WHERE src = n_name AND src <> dst), '') AS deps FROM nation")
def dependency_graph(spark, sf_dir):
    nodes = read(spark, sf_dir, "nation").select(F.col("n_name").alias("node"))
    return graph.dependencies(nodes, tables.nation_edges(spark, sf_dir)).withColumn("deps", F.array_join("deps", ","))


@query(f"WITH {tables.NATION_EDGES} SELECT dst AS node, array_to_string(list_sort(list(DISTINCT src)), ',') AS dependents FROM nedges WHERE src <> dst GROUP BY dst")
def dependency_reverse(spark, sf_dir):
    return graph.dependents(tables.nation_edges(spark, sf_dir)).withColumn("dependents", F.array_join("dependents", ","))


@query(f"WITH {tables.CALL_EDGES} SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ',') AS callees, count(DISTINCT dst) AS n FROM edges GROUP BY src")
def distinct_callees(spark, sf_dir):
    e = tables.call_edges(spark, sf_dir).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("callees"))
    return e.select("src", F.array_join("callees", ",").alias("callees"), F.size("callees").cast("long").alias("n"))


@query(f"WITH {NODES}, {tables.CALL_EDGES} SELECT e.src, e.dst, coalesce(n.symbol, e.detail) AS callee FROM (SELECT DISTINCT src, dst, detail FROM edges) e LEFT JOIN nodes n ON e.dst = n.node_id")
def callee_labels(spark, sf_dir):
    n = tables.code_nodes(spark, sf_dir).select(F.col("node_id").alias("dst"), "symbol")
    e = tables.call_edges(spark, sf_dir).select("src", "dst", "detail").distinct()
    return e.join(n, "dst", "left").select("src", "dst", F.coalesce("symbol", "detail").alias("callee"))


@query(f"WITH {NODES}, {tables.CALL_EDGES}, shown AS (SELECT node_id AS id FROM nodes WHERE kind = 'func' AND loc >= 200) SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)")
def shown_edges(spark, sf_dir):
    shown = tables.code_nodes(spark, sf_dir).filter("kind = 'func' and loc >= 200").select(F.col("node_id").alias("id"))
    return graph.shown_edges(tables.call_edges(spark, sf_dir), shown)


@query(rf"""WITH {tables.SITE_PAGES}, pkg AS (SELECT DISTINCT host || '/' || lang AS package, string_split(host, '.')[1] || '/' || lang AS path, lang FROM site),
alias AS (SELECT DISTINCT unnest([path, replace(path, '/', '.'), lang]) AS alias, package, path FROM pkg),
e AS (SELECT DISTINCT a.host || '/' || a.lang AS src, b.path AS target FROM site a JOIN site b ON b.page_id = a.page_id + 1),
seg AS (SELECT src, target, unnest(s) AS alias, generate_subscripts(s, 1) AS pos FROM (SELECT *, list_filter(string_split(replace(target, '/', '.'), '.'), lambda x: x <> '') AS s FROM e)),
best AS (SELECT src, target, package, row_number() OVER (PARTITION BY src, target ORDER BY pos, CASE WHEN package = src THEN 0 ELSE 1 END, path, package) AS n FROM seg JOIN alias USING (alias))
SELECT e.src, e.target, coalesce(split_part(package, '/', 2), split_part(e.src, '/', 2)) AS lang, coalesce(package = e.src, true) AS own FROM e LEFT JOIN (SELECT * FROM best WHERE n = 1) b ON b.src = e.src AND b.target = e.target""")
def alias_resolve(spark, sf_dir):
    p = tables.site_pages(spark, sf_dir).select("page_id", "host", "lang", "path")
    pkgs = p.select(F.concat("host", F.lit("/"), "lang").alias("node_id"), F.concat(F.split("host", "[.]")[0], F.lit("/"), "lang").alias("path")).distinct()
    nexts = p.select((F.col("page_id") - 1).alias("page_id"), F.col("path").alias("target"))
    edges = p.join(nexts, "page_id").select(F.concat("host", F.lit("/"), "lang").alias("src"), "target").distinct()
    own = pkgs.select(F.col("node_id").alias("src"), F.col("node_id").alias("package"))
    found = graph.resolve_imports(edges, graph.aliases(pkgs), own)
    return found.select("src", "target", F.element_at(F.split("package", "/"), 2).alias("lang"), (F.col("package") == F.col("src")).alias("own"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark, sf_dir):
    return graph.missing(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT count(*) AS allowed, count(*) FILTER (l.doc_id IS NULL) AS missing, round(1 - count(*) FILTER (l.doc_id IS NULL) / count(*), 6) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage_ratio(spark, sf_dir):
    return rounded(graph.coverage(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id"), "coverage")


# architecture

COMP = "comp AS (SELECT *, CASE WHEN path = '' THEN 'root' WHEN starts_with(path, 'src/') THEN split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS component FROM nodes)"
HAS = "(contains(path, 'cli') OR contains(path, 'main.py') OR contains(path, 'manage.py'))"


@query(f"WITH {NODES}, {COMP} SELECT component, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind IN ('func', 'block')) AS functions, coalesce(sum(loc) FILTER (kind = 'file'), 0)::BIGINT AS loc FROM comp GROUP BY component")
def component_stats(spark, sf_dir):
    return arch.component_stats(tables.code_nodes(spark, sf_dir))


@query(f"""WITH {NODES}, {COMP}, tags AS (SELECT component, unnest(list_filter([CASE WHEN contains(path, 'router') OR contains(path, 'api/') OR contains(path, '/routes/') THEN 'api' END, CASE WHEN contains(path, 'worker') OR contains(path, 'workflow') OR contains(path, 'temporal') THEN 'worker' END,
  CASE WHEN contains(path, 'test') OR contains(path, 'spec') OR contains(path, 'fixtures') THEN 'tests' END, CASE WHEN contains(path, 'lambda') THEN 'lambda' END, CASE WHEN contains(path, 'infra') OR contains(path, 'terraform') THEN 'infrastructure' END,
  CASE WHEN contains(component, 'app') OR contains(component, 'ui') OR contains(component, 'web') THEN 'frontend' END], lambda x: x IS NOT NULL)) AS role FROM comp)
SELECT DISTINCT component, role FROM tags UNION SELECT component, 'other' FROM comp WHERE component NOT IN (SELECT component FROM tags)""")
def component_roles(spark, sf_dir):
    return arch.component_roles(tables.code_nodes(spark, sf_dir))


@query(f"""WITH {NODES}, t AS (SELECT p.node_id, CASE WHEN starts_with(list_last(string_split(f.path, '/')), 'test') THEN 'tests' WHEN list_last(string_split(f.path, '/')) = 'cli.py' THEN 'cli' END AS role FROM nodes p LEFT JOIN nodes f ON f.parent_id = p.node_id AND f.kind = 'file' WHERE p.kind = 'pkg')
SELECT node_id, coalesce(array_to_string(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), ','), '') AS roles FROM t GROUP BY node_id""")
def package_roles(spark, sf_dir):
    n = tables.code_nodes(spark, sf_dir)
    files = n.filter("kind = 'file'").select(F.col("parent_id").alias("package"), "path")
    return arch.package_roles(n.filter("kind = 'pkg'"), files).withColumn("roles", F.array_join("roles", ","))


PART_FILES = """pf AS (SELECT p_brand AS package, p_brand || '/' || CASE p_partkey % 97 WHEN 0 THEN 'cli' WHEN 1 THEN 'bm25' WHEN 2 THEN 'searcher' ELSE 'f' || p_partkey END || '.py' AS path, p_size AS loc, p_partkey FROM part)"""


@query(f"""WITH {PART_FILES}, r AS (SELECT *, list_last(string_split(path, '/')) AS name, coalesce(list_position(['cli.py', 'indexer.py', 'searcher.py', 'bm25.py', 'llm_search.py'], list_last(string_split(path, '/'))) - 1, 6) AS pref FROM (SELECT DISTINCT package, path, loc FROM pf))
SELECT package, path, loc, place FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY pref, loc DESC, name, path) AS place FROM r) WHERE place <= 5""")
def important_files(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 97
    name = F.when(k == 0, "cli").when(k == 1, "bm25").when(k == 2, "searcher").otherwise(F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    files = p.select(F.col("p_brand").alias("package"), F.concat("p_brand", F.lit("/"), name, F.lit(".py")).alias("path"), F.col("p_size").alias("loc")).distinct()
    return arch.important_files(files).select("package", "path", "loc", F.col("place").cast("long").alias("place"))


FLOWS = f"""entry AS (
  SELECT node_id, component, path, symbol, loc, CASE WHEN {HAS} THEN 'cli' WHEN contains(path, 'workflow') OR contains(path, 'worker') THEN 'workflow' WHEN contains(path, '/routes/') OR ends_with(path, 'routes.py') THEN 'route-module' END AS category FROM comp WHERE kind = 'file'
  UNION ALL SELECT node_id, component, path, symbol, loc, CASE WHEN symbol IN ('main', 'handler', 'run', 'start', 'workflow', 'worker', 'execute', 'process', 'task') OR contains(path, 'workflow') OR contains(path, 'worker') OR contains(path, 'routes') OR contains(path, 'cli') OR starts_with(symbol, 'handle_') OR ends_with(symbol, '_handler')
    THEN CASE WHEN contains(path, 'temporal') OR contains(path, 'workflow') OR contains(path, 'worker') THEN 'workflow' WHEN contains(path, 'routes') OR symbol IN ('get', 'post', 'put', 'delete') THEN 'http-route' WHEN contains(path, 'cli') OR symbol IN ('main', 'cli', 'entrypoint') THEN 'cli' WHEN contains(path, 'task') OR contains(path, 'job') OR symbol IN ('task', 'job') THEN 'task' ELSE 'function' END END FROM comp WHERE kind IN ('func', 'block')),
placed AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY coalesce(list_position(['cli', 'workflow', 'http-route', 'task', 'route-module', 'function'], category) - 1, 9), coalesce(loc, 0) DESC, path, node_id) AS place FROM entry WHERE category IS NOT NULL),
called AS (SELECT src, array_to_string(list_sort(list(DISTINCT coalesce(symbol, detail)))[1:15], ',') AS calls FROM edges LEFT JOIN nodes ON dst = node_id GROUP BY src)"""


@query(f"WITH {NODES}, {tables.CALL_EDGES}, {COMP}, {FLOWS} SELECT component, category, path AS entry_path, symbol AS entry_symbol, loc, coalesce(calls, '') AS calls, place FROM placed LEFT JOIN called ON src = node_id WHERE place <= 12")
def flows(spark, sf_dir):
    f = arch.flows(tables.code_nodes(spark, sf_dir), tables.call_edges(spark, sf_dir))
    return f.withColumns({"calls": F.array_join("calls", ","), "place": F.col("place").cast("long")})


@query(f"WITH {NODES}, {tables.CALL_EDGES}, {COMP}, ce AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM edges JOIN comp a ON a.node_id = src JOIN comp b ON b.node_id = dst WHERE a.component <> b.component) SELECT src, count(*) AS n_deps, array_to_string(list_sort(list(dst)), ',') AS deps FROM ce GROUP BY src")
def component_dependencies(spark, sf_dir):
    n = tables.code_nodes(spark, sf_dir).select("node_id", "path")
    e = tables.call_edges(spark, sf_dir).select("src", "dst")
    at = lambda end: n.select(F.col("node_id").alias(end), F.col("path").alias(f"{end}_path"))
    ends = e.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))
    return graph.component_edges(ends).groupBy("src").agg(F.count("*").alias("n_deps"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("deps"))


PATH_NAME = "lower(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'))"
TAGS = {
    "frontend": "regexp_matches(component, 'app|web|ui|vendor') OR regexp_matches(path, '[.][tj]sx$|components/')",
    "backend": "regexp_matches(component, 'backend|api|server')",
    "worker": "regexp_matches(component, 'worker|temporal') OR regexp_matches(path, '/worker|/workflow')",
    "lambda": "contains(component, 'lambda')",
    "infrastructure": "regexp_matches(component, 'infra|terraform') OR regexp_matches(path, 'infra|terraform')",
    "tests": "regexp_matches(component, 'test|e2e|integration') OR regexp_matches(path, 'tests|spec')",
    "api": "regexp_matches(path, 'routes|router|api/')",
}


@query(f"""WITH {NODES}, {tables.CALL_EDGES}, {tables.NATION_EDGES}, {COMP}, {FLOWS},
tagged AS (SELECT component, unnest(list_filter([{", ".join(f"CASE WHEN {rule} THEN '{role}' END" for role, rule in TAGS.items())}], lambda x: x IS NOT NULL)) AS role FROM comp),
rs AS (SELECT component, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM (SELECT * FROM tagged UNION ALL SELECT component, 'other' FROM comp WHERE component NOT IN (SELECT component FROM tagged)) GROUP BY component),
best AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY loc DESC, list_last(string_split(path, '/'))) AS place FROM comp WHERE kind = 'file'),
fs AS (SELECT component, string_agg(path || ' ' || loc, ',' ORDER BY place) AS important_files FROM best WHERE place <= 5 GROUP BY component),
ds AS (SELECT {PATH_NAME.format('src')} AS component, array_to_string(list_sort(list(DISTINCT {PATH_NAME.format('dst')})), ',') AS deps FROM nedges WHERE src <> dst GROUP BY 1),
fl AS (SELECT component, count(*) AS n_flows, string_agg(category || ' ' || path || ' ' || symbol || ' ' || coalesce(calls, ''), ';' ORDER BY place) AS flows FROM placed LEFT JOIN called ON src = node_id WHERE place <= 12 GROUP BY component),
st AS (SELECT component, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind IN ('func', 'block')) AS functions, coalesce(sum(loc) FILTER (kind = 'file'), 0)::BIGINT AS loc FROM comp GROUP BY component)
SELECT component, files, classes, functions, loc, roles, coalesce(important_files, '') AS important_files, coalesce(deps, '') AS deps, coalesce(n_flows, 0) AS n_flows, coalesce(flows, '') AS flows FROM st LEFT JOIN rs USING (component) LEFT JOIN fs USING (component) LEFT JOIN ds USING (component) LEFT JOIN fl USING (component)""")
def component_records(spark, sf_dir):
    n = tables.code_nodes(spark, sf_dir)
    path = lambda c: F.concat(F.lit("src/"), F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))).alias(c)
    r = arch.component_records(n, tables.call_edges(spark, sf_dir), tables.nation_edges(spark, sf_dir).select(path("src"), path("dst")))
    joined = lambda c, mark, shown: F.coalesce(F.array_join(F.transform(c, shown), mark), F.lit("")).alias(c)
    words = lambda *x: F.concat_ws(" ", *x)
    return r.select(
        "component", "files", "classes", "functions", "loc", joined("roles", ",", lambda x: x), joined("important_files", ",", lambda x: words(x["path"], x["loc"].cast("string"))), joined("deps", ",", lambda x: x),
        F.coalesce(F.size("flows"), F.lit(0)).cast("long").alias("n_flows"), joined("flows", ";", lambda x: words(x["category"], x["entry_path"], x["entry_symbol"], F.array_join(x["calls"], ","))),
    )


@query("SELECT count(*) AS funcs_total, count(*) FILTER (l_discount > 0) AS funcs_with_params, sum(l_linenumber)::BIGINT AS callsites_total, count(*) FILTER (l_returnflag = 'R') AS cap_hits, round(count(*) FILTER (l_discount > 0) / count(*), 6) AS params_ratio, count(*) FILTER (l_discount > 0) / count(*) < 0.6 AS alert, count(*) > 100 AND sum(l_linenumber) = 0 AS alert_callsites FROM lineitem")
def metrics_sum(spark, sf_dir):
    one = read(spark, sf_dir, "lineitem").agg(F.count("*").alias("funcs_total"), F.count_if(F.col("l_discount") > 0).alias("funcs_with_params"), F.sum("l_linenumber").alias("callsites_total"), F.count_if(F.col("l_returnflag") == "R").alias("cap_hits"))
    return rounded(extract.alerts(one), "params_ratio")


@query(f"WITH {NODES}, {tables.CALL_EDGES} SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, count(*) FILTER (kind = 'pkg') AS packages, count(DISTINCT CASE WHEN path = '' THEN 'root' ELSE split_part(path, '/', 2) END) AS components FROM nodes")
def index_counts(spark, sf_dir):
    n, e = tables.code_nodes(spark, sf_dir), tables.call_edges(spark, sf_dir)
    one = arch.with_component(n).agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "pkg").alias("packages"), F.countDistinct("component").alias("components"))
    return one.join(F.broadcast(e.agg(F.count("*").alias("edges")))).select("nodes", "edges", "packages", "components")  # one row each


@query(f"WITH {NODES} SELECT split_part(path, '/', 2) AS package, count(*) FILTER (kind = 'file') AS file, count(*) FILTER (kind = 'func') AS func FROM nodes WHERE path <> '' GROUP BY 1")
def package_kinds(spark, sf_dir):
    n = tables.code_nodes(spark, sf_dir).filter("path <> ''")
    return n.groupBy(F.get(F.split("path", "/"), F.lit(1)).alias("package")).pivot("kind", ["file", "func"]).agg(F.count("node_id")).na.fill(0)


# diagrams

ORDER_LABELS = """od AS (SELECT DISTINCT 'c' || o_custkey AS name, o_orderpriority AS src, o_orderstatus AS dst FROM orders), labels_ AS (SELECT DISTINCT name, unnest([src, dst]) AS label FROM od)"""
MID = "CASE WHEN regexp_matches({0}, '^[0-9]') THEN 'pkg_' || regexp_replace({0}, '[^0-9a-zA-Z_]', '_', 'g') ELSE regexp_replace({0}, '[^0-9a-zA-Z_]', '_', 'g') END"


@query(f"""WITH {ORDER_LABELS}, ls AS (SELECT name, 1 AS k, '    ' || {MID.format('label')} || '["' || label || '"]' AS line FROM labels_ UNION SELECT name, 2, '    ' || {MID.format('src')} || ' --> ' || {MID.format('dst')} FROM od)
SELECT name, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY k, line) AS text FROM ls GROUP BY name""")
def mermaid_render(spark, sf_dir):
    return mermaid.render(*tables.order_diagrams(spark, sf_dir))


@query(f"WITH {tables.ORDER_TEXTS} SELECT name, src, dst, row_number() OVER (PARTITION BY name, src, dst) AS times FROM drawn")
def mermaid_parse(spark, sf_dir):
    """Edges by label of the diagrams' texts: what the orders they were made from say."""
    each = mermaid.lines(tables.order_texts(spark, sf_dir))
    return mermaid.labelled_edges(mermaid.nodes(each), mermaid.edges(each)).select("name", "src", "dst", F.col("times").cast("long").alias("times"))


def _allowed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select(F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("label"))


@query(f"""WITH {tables.ORDER_TEXTS}, l AS (SELECT name, count(*) FILTER (label IN (FROM ok)) AS covered, count(*) FILTER (label NOT IN (FROM ok)) AS unknown_nodes FROM told GROUP BY name),
e AS (SELECT name, count(*) FILTER (src NOT IN (FROM ok) OR dst NOT IN (FROM ok)) AS unknown_edges, count(*) - count(DISTINCT (src, dst)) AS repeated_edges FROM drawn GROUP BY name),
v AS (SELECT name, errors, coalesce(covered, 0) AS covered, coalesce(unknown_nodes, 0) AS unknown_nodes, coalesce(unknown_edges, 0) AS unknown_edges, coalesce(repeated_edges, 0) AS repeated_edges FROM wrong LEFT JOIN l USING (name) LEFT JOIN e USING (name))
SELECT *, errors = '' AND unknown_nodes = 0 AND unknown_edges = 0 AS valid FROM v""")
def mermaid_validate(spark, sf_dir):
    told = mermaid.validate(tables.order_texts(spark, sf_dir), _allowed_labels(spark, sf_dir))
    return told.withColumn("errors", F.array_join("errors", ";"))


@query(f"""WITH {tables.ORDER_TEXTS}, every AS (SELECT label FROM told UNION SELECT src FROM drawn UNION SELECT dst FROM drawn),
one AS (SELECT (SELECT count(*) FROM ok) AS allowed, (SELECT count(*) FROM ok WHERE label IN (SELECT label FROM told)) AS covered, (SELECT count(*) FROM every WHERE label NOT IN (FROM ok)) AS unknown, (SELECT count(*) FROM wrong WHERE errors <> '') AS with_errors)
SELECT *, round(covered / allowed, 6) AS coverage, covered / allowed >= 0.95 AND unknown = 0 AND with_errors = 0 AS passes FROM one""")
def mermaid_summary(spark, sf_dir):
    """All diagrams as one set."""
    return rounded(mermaid.summary(tables.order_texts(spark, sf_dir), _allowed_labels(spark, sf_dir)), "coverage")
