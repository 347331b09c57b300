"""The page of a search: five views, written line by line from tasks."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators import trace, tree
from arbora.sources.documents import fixed, lines, write_documents

FILE = "trace.html"
#: Shows a row if it has the text, or if a row below it does: from the last row to the first, what is shown asks for the nearest row one level up.
SCRIPT = """<script>
function sift(q){
  q = q.toLowerCase();
  const due = new Set();
  for (const r of [...document.querySelectorAll('#tree .n')].reverse()) {
    const d = +r.dataset.d, below = due.delete(d + 1);
    const shown = below || r.textContent.toLowerCase().includes(q);
    r.hidden = !shown;
    if (shown) due.add(d);
  }
}
</script>"""
STYLE = "<style>body{font:14px sans-serif} .n.explored{background:#fff3cd} .n.answer{background:#d4edda} .card{border:1px solid #ccc;margin:4px;padding:4px} circle{fill:#667eea} circle.explored{fill:#ffc107} circle.answer{fill:#28a745} line{stroke:#9996} section{border-top:1px solid #ccc}</style>"


def _marks(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with the class names ``marks`` of what a search reached."""
    told = reached.select("node_id", F.concat_ws(" ", F.when(F.col("explored"), "explored"), F.when(F.col("answer"), "answer")).alias("marks"))
    return nodes.join(told, "node_id", "left").withColumn("marks", F.coalesce("marks", F.lit("")))


def write(nodes: DataFrame, edges: DataFrame, query: str, answers: DataFrame, steps: DataFrame, folder: str) -> str:
    """Writes ``trace.html`` into ``folder``: answers, reasoning, tree with a filter, impact map, packages. Gives its path.

    nodes as in an index; answers (rank or score, node_id, kind, path, symbol, ...); steps
    (step, event, node_id, score, and ``reason`` if there is one) of one query.
    """
    spark, esc = nodes.sparkSession, trace.escaped
    file, none = F.lit(FILE), F.lit(None).cast("string")
    column = lambda df, *names: next((F.col(n) for n in names if n in df.columns), none)
    number = lambda c: F.coalesce(F.round(c, 3).cast("string"), F.lit(""))
    s = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    title = html.escape(query)
    out = fixed(spark, FILE, 0, f"<!doctype html><meta charset=utf-8><title>{title}</title>", STYLE, SCRIPT, f"<h1>{title}</h1>", "<section id=answers><h2>Answers</h2>")
    score = column(answers, "hybrid_score", "score")
    card = s("<div class=card><b>", esc(F.col("kind")), "</b> ", esc(F.col("symbol")), " <code>", esc(F.col("path")), "</code> ", number(score), " ", esc(column(answers, "reason")), "</div>")
    rank = column(answers, "rank") if "rank" in answers.columns else F.floor(-score * 1_000_000)
    out = out.unionByName(lines(answers, file, 1, card, n=rank))

    told = steps.withColumn("_one", F.lit(1)).withColumn("_order", F.struct("step", F.when(F.col("event") == "evaluate", 0).when(F.col("event") == "answer", 1).otherwise(2), -F.col("score"), "node_id"))
    told = told.withColumn("reason", column(steps, "reason"))
    reached = trace.reached(told, "_one")
    named = nodes.select("node_id", "path", F.coalesce("symbol", F.left("node_id", F.lit(8))).alias("symbol"))
    reasons = trace.reasoning(told, "_one", "_order").join(named, "node_id", "left")
    row = s("<div style='margin-left:", F.when(F.col("parent").isNotNull(), "30").otherwise("0"), "px'>", F.col("place").cast("string"), ". ", F.col("event"), " <b>", esc(F.col("symbol")), "</b> ", number(F.col("score")), " <code>", esc(F.col("path")), "</code> ", esc(F.col("reason")), "</div>")
    out = out.unionByName(fixed(spark, FILE, 2, "</section>", "<section id=reasoning><h2>Reasoning</h2>"))
    # what is expanded stands below its evaluation, as places go
    out = out.unionByName(lines(reasons, file, 3, row, n=F.coalesce("parent", "place") * 1_000_000 + F.when(F.col("parent").isNotNull(), F.col("place")).otherwise(0)))

    walk = tree.preorder(nodes.select("node_id", "parent_id", "ord"), F.coalesce("ord", F.lit(0)))
    leaf = _marks(reached, nodes).join(walk, "node_id")
    row = s("<div class='n ", F.col("marks"), "' data-d=", F.col("depth").cast("string"), " style='margin-left:", (F.col("depth") * 20).cast("string"), "px'>", esc(F.coalesce("symbol", "kind")), "</div>")
    out = out.unionByName(fixed(spark, FILE, 4, "</section>", "<section><h2>Tree</h2><input oninput='sift(this.value)' placeholder=filter><div id=tree>"))
    out = out.unionByName(lines(leaf, file, 5, row, n=F.col("place")))

    placed, areas = trace.impact_map(nodes)
    size = areas.agg(F.max("y").alias("y"))
    out = out.unionByName(fixed(spark, FILE, 6, "</div></section>", "<section id=impact><h2>Impact</h2>"))
    out = out.unionByName(lines(size, file, 7, s("<svg width=", F.lit(str(int(trace.WIDTH))), " height=", (F.coalesce("y", F.lit(0.0)).cast("int") + 600).cast("string"), ">")))
    text = lambda c: F.round(c, 1).cast("string")
    label = s("<text x=", text(F.col("x") + 10), " y=", text(F.col("y") + 20), ">", esc(F.element_at(F.split("path", "/"), -1)), "</text>")
    out = out.unionByName(lines(areas, file, 8, label, key=F.col("path")))
    edge = s("<line x1=", text(F.col("x1")), " y1=", text(F.col("y1")), " x2=", text(F.col("x2")), " y2=", text(F.col("y2")), " />")
    out = out.unionByName(lines(trace.impact_edges(edges, placed), file, 9, edge, key=s(F.col("src"), F.col("dst"))))
    dot = s("<circle class='", F.col("marks"), "' cx=", text(F.col("x")), " cy=", text(F.col("y")), " r=", F.when(F.contains("marks", F.lit("answer")), "10").otherwise("6"), "><title>", esc(F.col("symbol")), "</title></circle>")
    out = out.unionByName(lines(_marks(reached, placed), file, 10, dot, key=F.col("node_id")))

    counts = F.concat_ws(", ", *[s(F.col(c).cast("string"), f" {c}") for c in ("files", "classes", "functions")])
    out = out.unionByName(fixed(spark, FILE, 11, "</svg></section>", "<section id=packages><h2>Packages</h2>"))
    out = out.unionByName(lines(trace.package_cards(nodes), file, 12, s("<div class=card><b>", esc(F.col("package")), "</b> ", counts, "</div>"), key=F.col("package")))
    write_documents(out.unionByName(fixed(spark, FILE, 13, "</section>")), folder)
    return f"{folder}/{FILE}"
