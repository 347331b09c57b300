"""Queries of what the page of a search shows; importing this adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import trace
from arbora.plans import tables
from arbora.plans.queries import query, rounded
from arbora.plans.tables import read


def _steps(spark, sf_dir: str) -> DataFrame:
    """Events of users as traces of searches: views evaluate, clicks expand, purchases answer what ``props`` names."""
    kind = F.col("event_type")
    event = F.when(kind == "view", "evaluate").when(kind == "click", "expand").when(kind == "purchase", "answer").otherwise(kind)
    return read(spark, sf_dir, "events").select("user_id", "event_id", event.alias("event"), F.col("props").alias("node_id"))


@query("""SELECT user_id, props AS node_id, bool_or(event_type IN ('view', 'click')) AS explored, bool_or(event_type = 'purchase') AS answer FROM events
WHERE event_type IN ('view', 'click', 'purchase') AND props IS NOT NULL GROUP BY user_id, props""")
def trace_reached(spark, sf_dir):
    """What each search explored and answered with."""
    return trace.reached(_steps(spark, sf_dir), "user_id")


@query("""WITH e AS (SELECT *, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, last_value(CASE event_type WHEN 'view' THEN place END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM e)
SELECT user_id, event_id, place, CASE event_type WHEN 'view' THEN 'evaluate' ELSE 'expand' END AS event, CASE event_type WHEN 'click' THEN above END AS parent FROM p WHERE event_type IN ('view', 'click')""")
def trace_reasoning(spark, sf_dir):
    """Each expansion under the evaluation before it."""
    got = trace.reasoning(_steps(spark, sf_dir), "user_id", "event_id")
    return got.select("user_id", "event_id", F.col("place").cast("long").alias("place"), "event", F.col("parent").cast("long").alias("parent"))


@query(f"""WITH RECURSIVE {tables.CODE_NODES}, own AS (SELECT text, node_id FROM nodes, (VALUES ('run_job'), ('er#000000011')) AS q(text) WHERE contains(lower(coalesce(symbol, kind)), text)),
up AS (SELECT text, node_id FROM own UNION SELECT text, parent_id FROM up JOIN nodes USING (node_id) WHERE parent_id IS NOT NULL)
SELECT text, node_id, own.node_id IS NOT NULL AS own FROM up LEFT JOIN own USING (text, node_id)""")
def tree_filter(spark, sf_dir):
    """The tree under two filters: what has the text, and all above it."""
    nodes = tables.code_nodes(spark, sf_dir)
    one = lambda text: trace.filtered(nodes, text).withColumn("text", F.lit(text))
    return one("Run_Job").withColumn("text", F.lower("text")).unionByName(one("er#000000011")).select("text", "node_id", "own")


MAP = """shown AS (SELECT node_id, path, row_number() OVER (PARTITION BY path ORDER BY node_id) - 1 AS i, count(*) OVER (PARTITION BY path) AS n FROM nodes WHERE kind = 'func'),
area AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS f, least(count(*) OVER (), 5) AS cols FROM (SELECT DISTINCT path FROM shown)),
placed AS (SELECT node_id, path, (f % cols) * (1000.0::DOUBLE / cols) + 40 + (i % ceil(sqrt(n))::INT) * least(60, (1000.0::DOUBLE / cols - 40) / ceil(sqrt(n))) AS x, (f // cols) * 200.0::DOUBLE + 40 + (i // ceil(sqrt(n))::INT) * 40 AS y FROM shown JOIN area USING (path))"""


def _placed(spark, sf_dir: str) -> DataFrame:
    return trace.impact_map(tables.code_nodes(spark, sf_dir).withColumn("ord", F.lit(0)))[0]


@query(f"WITH {tables.CODE_NODES}, {MAP} SELECT node_id, path, round(x, 6) AS x, round(y, 6) AS y FROM placed")
def impact_map(spark, sf_dir):
    """Functions in the areas of their files."""
    return rounded(_placed(spark, sf_dir).select("node_id", "path", "x", "y"), "x", "y")


@query(f"""WITH {tables.CODE_NODES}, {tables.CALL_EDGES}, {MAP} SELECT DISTINCT src, dst, round(a.x, 6) AS x1, round(a.y, 6) AS y1, round(b.x, 6) AS x2, round(b.y, 6) AS y2
FROM edges JOIN placed a ON a.node_id = src JOIN placed b ON b.node_id = dst WHERE src <> dst""")
def impact_edges(spark, sf_dir):
    """Calls between functions of the map, from place to place."""
    return rounded(trace.impact_edges(tables.call_edges(spark, sf_dir), _placed(spark, sf_dir)), "x1", "y1", "x2", "y2")


@query("""WITH n AS (SELECT lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g')) AS package, n_nationkey FROM nation),
f AS (SELECT c_nationkey, count(DISTINCT c_custkey) AS files, count(o_orderkey) AS functions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey)
SELECT package, coalesce(files, 0) AS files, 0::BIGINT AS classes, coalesce(functions, 0) AS functions FROM n LEFT JOIN f ON c_nationkey = n_nationkey""")
def package_cards(spark, sf_dir):
    """Files and functions below each nation's package."""
    n = tables.code_nodes(spark, sf_dir)
    short = F.regexp_replace("path", "^src/", "")
    return trace.package_cards(n.withColumn("symbol", F.when(F.col("kind") == "pkg", short).otherwise(F.col("symbol"))).withColumn("path", short))
