"""Searching an index, and the report of a search."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import bm25, search, tree
from arbora.plans import page
from arbora.sources.sinks import IndexFiles, write_text


def find(spark: SparkSession, index: str, query: str, *, top: int = search.TOP, budget: int = search.BUDGET, judge: search.Judge | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers (rank, node_id, path, symbol, scores) and trace of one query; with ``judge`` the guided search."""
    nodes = tree.load_nodes(IndexFiles(spark, index).read("nodes"))
    asked = spark.createDataFrame([(1, query)], "query int, text string")
    shown = nodes.select("node_id", "kind", "path", "symbol", "start_line", "end_line", "summary")
    if judge:
        steps = search.guided(nodes.select("node_id", "parent_id", "ord", "kind", "path", "symbol", "summary"), asked, judge, budget=budget)
        best = steps.filter("event = 'answer'").orderBy(F.desc("score"), "step").limit(top)
        return best.join(shown, "node_id").orderBy(F.desc("score"), "step"), steps
    hits = bm25.Index(spark, f"{index}/bm25").search(asked, "query", F.col("text"), search.pre_limit(top))
    answers, steps = search.search(nodes.select("node_id", "parent_id", "ord", "kind", "path", "symbol"), hits, asked, top=top, budget=budget)
    return answers.join(shown, "node_id").orderBy("rank"), steps


def report(spark: SparkSession, index: str, query: str, answers: DataFrame, steps: DataFrame) -> str:
    """Writes results.json and trace.json, whose rows are bounded by top and budget, and the page of all views, which tasks write. Gives the page's path."""
    best = [json.loads(x) for x in answers.toJSON().collect()]
    trace = [json.loads(x) for x in steps.orderBy("step").toJSON().collect()]
    write_text(spark, f"{index}/results.json", json.dumps({"query": query, "results": best}, ensure_ascii=False, indent=2))
    write_text(spark, f"{index}/trace.json", json.dumps(trace, ensure_ascii=False, indent=2))
    files = IndexFiles(spark, index)
    return page.write(tree.load_nodes(files.read("nodes")), files.edges(), query, answers, steps, index)
