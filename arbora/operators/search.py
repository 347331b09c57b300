"""Hierarchical search: subtree relevance, beams, and budgeted best-first search.

In a tree each node is pushed once, by its parent, so a budget that covers all
nodes reachable through beams makes the visiting order immaterial to the answer;
then the search is a join of levels. Where the budget binds, order matters: then
each query is a row that holds its heap, and rounds fetch what heaps need next.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import models
from arbora.operators import tree
from arbora.sources.shared import materialize, new_path

TOP, BUDGET, BEAM, WORD_BONUS = 10, 120, 10, 0.1
LEAVES = ("func", "block", "const")


def pre_limit(top: int = TOP) -> int:
    """How many BM25 results take part in a search."""
    return max(20 * top, 200)


def path_bonus(query: Column, symbol: Column, path: Column) -> Column:
    """A tenth for each word of the query that the symbol or the path holds; repeated words count again."""
    words = F.array_remove(F.split(F.lower(F.trim(query)), r"\s+"), "")
    low = F.lower(F.coalesce(symbol, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return F.size(F.filter(words, lambda w: F.contains(low[0], w) | F.contains(low[1], w))) * WORD_BONUS


def subtree_scores(nodes: DataFrame, hits: DataFrame, *, most: int = tree.MOST_LEVELS) -> DataFrame:
    """(query, node_id, below): BM25 of hits (query, node_id, score) summed over each subtree that holds one.

    Only the hits and what lies above them is touched: each level's sums climb to
    the parents, added up on the way.
    """
    up = nodes.filter(F.col("parent_id").isNotNull()).select("node_id", F.col("parent_id").alias("_up"))
    level = out = materialize(hits.groupBy("query", "node_id").agg(F.sum("score").alias("below")), "climb")
    for _ in range(most):
        risen = level.join(up, "node_id").groupBy("query", F.col("_up").alias("node_id")).agg(F.sum("below").alias("below"))
        level = materialize(risen, "climb")
        if level.isEmpty():
            return out.groupBy("query", "node_id").agg(F.sum("below").alias("below"))
        out = out.unionByName(level)
    raise ValueError(f"paths are longer than {most} levels, or there is a cycle")


def node_score(below: Column, query: Column, symbol: Column, path: Column) -> Column:
    """A node's score: BM25 over its subtree, and the bonus of its own name and path."""
    return F.coalesce(below, F.lit(0.0)) + path_bonus(query, symbol, path)


def hybrid(local: Column, aggregate: Column) -> Column:
    return 2 * local + aggregate


class _Scores:
    """A tree's children, and the scores of those that searches for queries (query, text) look at."""

    def __init__(self, nodes: DataFrame, hits: DataFrame, beam: int, most: int) -> None:
        self.totals = materialize(subtree_scores(nodes, hits, most=most), "subtree-scores")
        each = nodes.select("node_id", "parent_id", "ord", "kind", "path", "symbol")
        self.kids = materialize(each.filter(F.col("parent_id").isNotNull()), "children")
        self.root = each.filter(F.col("parent_id").isNull()).orderBy("ord", "node_id").limit(1)  # one row
        self.beam = beam

    def first(self, queries: DataFrame) -> DataFrame:
        return self.best(queries.select("query", "text").crossJoin(F.broadcast(self.root)))

    def below(self, parents: DataFrame) -> DataFrame:
        """The best children of parents (query, text, parent_id)."""
        return self.best(parents.join(self.kids, "parent_id"))

    def best(self, rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query", "parent_id").orderBy(F.desc(F.round("aggregate_score", 9)), "ord")
        told = rows.join(self.totals, ["query", "node_id"], "left").withColumn("aggregate_score", node_score(F.col("below"), F.col("text"), F.col("symbol"), F.col("path")))
        return told.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.beam)


def beam_reach(nodes: DataFrame, hits: DataFrame, queries: DataFrame, beam: int = BEAM, *, most: int = tree.MOST_LEVELS) -> DataFrame:
    """What beams reach from the first root for queries (query, text): (query, node_id, parent_id, kind, rank, step, local_score, aggregate_score).

    From level to level the children of the nodes kept so far are scored, and each
    parent's ``beam`` best stay, ties by ``ord``. Only children of kept nodes meet
    the queries.
    """
    scores = _Scores(nodes, hits, beam, most)
    own = hits.groupBy("query", "node_id").agg(F.sum("score").alias("local_score"))

    def kept(rows: DataFrame, step: int) -> DataFrame:
        return materialize(rows.withColumn("step", F.lit(step)).select("query", "text", "node_id", "parent_id", "kind", "rank", "step", "aggregate_score"), "reach")

    level = out = kept(scores.first(queries), 0)
    for step in range(1, most + 1):
        above = level.filter(~F.col("kind").isin(*LEAVES)).select("query", "text", F.col("node_id").alias("parent_id"))
        level = kept(scores.below(above), step)
        if level.isEmpty():
            found = out.drop("text").join(own, ["query", "node_id"], "left")
            return materialize(found.withColumn("local_score", F.coalesce("local_score", F.lit(0.0))), "reach")
        out = out.unionByName(level)
    raise ValueError(f"paths are longer than {most} levels, or there is a cycle")


#: Places of a heap whose children the first round fetches; twice as many in each round after it.
AHEAD = 8
STEPS = "array<struct<event:string,node_id:string,score:double>>"


def _advance(state: dict, found: list[dict], ahead: int, budget: int) -> list[str]:
    """Pops a search's heap as far as the children of what it pops are known; gives the nodes whose children it needs next.

    ``state``: steps [event, node, score] so far; the heap [-score, node, kind], of
    which no more places are kept than steps are left; the known children of nodes in it.
    """
    known, heap, steps = state["known"], [tuple(x) for x in state["heap"]], state["steps"]
    for p in state["asked"]:
        known[p] = []
    for r in found:
        known[r["parent_id"]].append((-r["score"], r["node_id"], r["kind"]))
    heapq.heapify(heap)
    while heap and len(steps) < budget:
        score, node, kind = heap[0]
        if kind not in LEAVES and node not in known:
            break
        heapq.heappop(heap)
        steps.append(("answer" if kind in LEAVES else "expand", node, -score))
        for child in known.pop(node, []):
            heapq.heappush(heap, tuple(child))
    state["heap"] = heap = heapq.nsmallest(budget - len(steps), heap)
    state["known"] = {n: known[n] for _, n, _ in heap if n in known}
    state["asked"] = [n for _, n, kind in heap if kind not in LEAVES and n not in known][:ahead]
    return state["asked"]


def best_first(nodes: DataFrame, hits: DataFrame, queries: DataFrame, *, budget: int = BUDGET, beam: int = BEAM, most: int = tree.MOST_LEVELS) -> DataFrame:
    """(query, step, event, node_id, score): what each query's search pops, best score first, ties by id; leaves are answers, others are expanded.

    A query's search is one row: its steps and a heap of no more places than steps
    are left. A round fetches and scores the children of the best places of every
    heap, and each search goes on until it pops a node whose children weren't
    fetched. So only nodes near the tops of heaps are joined, some twice ``budget``
    for a query in all, and a round is a few joins for all queries together.
    """
    scores = _Scores(nodes, hits, beam, most)
    start = F.to_json(F.struct(F.array().cast(STEPS).alias("steps"), F.array(F.array((-F.round("aggregate_score", 9)).cast("string"), "node_id", "kind")).alias("heap"), F.array("node_id").alias("asked")))
    state = materialize(scores.first(queries).select("query", "text", F.array(F.when(~F.col("kind").isin(*LEAVES), F.col("node_id"))).alias("ask"), start.alias("state")), "searches")
    kind = queries.schema["query"].dataType.simpleString()
    done, ahead = [], AHEAD
    while not state.isEmpty():
        asked = state.select("query", "text", F.explode("ask").alias("parent_id")).filter("parent_id is not null")
        found = scores.below(asked).groupBy("query").agg(F.collect_list(F.struct("parent_id", "node_id", "kind", F.round("aggregate_score", 9).alias("score"))).alias("x")).select("query", F.to_json("x").alias("found"))

        def run(batches: Iterable[pd.DataFrame], ahead: int = ahead) -> Iterator[pd.DataFrame]:
            for b in batches:
                asks = []
                for k, (text, found) in enumerate(zip(b["state"], b["found"], strict=True)):
                    state = json.loads(text)
                    if "known" not in state:
                        state |= {"known": {}, "heap": [[float(x), *rest] for x, *rest in state["heap"]]}
                    asks.append(_advance(state, json.loads(found) if found else [], ahead, budget))
                    b.iat[k, b.columns.get_loc("state")] = json.dumps(state)
                yield b.drop(columns="found").assign(ask=asks)

        rows = state.drop("ask").join(found, "query", "left").mapInPandas(run, f"query {kind}, text string, state string, ask array<string>")
        state = materialize(rows, "searches")
        done.append(state.filter(F.size("ask") == 0).select("query", "state"))
        state, ahead = state.filter(F.size("ask") > 0), min(2 * ahead, budget)
    told = F.posexplode(F.from_json("state", "steps array<array<string>>")["steps"])
    steps = reduce(DataFrame.unionByName, done) if done else state.select("query", "state")
    return steps.select("query", told.alias("step", "x")).select("query", "step", F.col("x")[0].alias("event"), F.col("x")[1].alias("node_id"), F.col("x")[2].cast("double").alias("score"))


def search(nodes: DataFrame, scored_docs: DataFrame, queries: DataFrame, *, top: int = TOP, budget: int = BUDGET, beam: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """Answers and trace of queries (query, text) on one tree, from BM25's (query, doc, score, rank).

    Answers: (query, rank, node_id, local_score, aggregate_score, hybrid_score).
    """
    hits = scored_docs.filter(F.col("rank") <= pre_limit(top)).select("query", F.col("doc").alias("node_id"), "score")
    hits = materialize(hits, "hits")
    trace = materialize(best_first(nodes, hits, queries, budget=budget, beam=beam), "trace")
    own = hits.groupBy("query", "node_id").agg(F.sum("score").alias("local_score"))
    found = trace.filter("event = 'answer'").select("query", "node_id", F.col("step").alias("visit"), F.col("score").alias("aggregate_score")).join(own, ["query", "node_id"], "left")
    found = found.withColumn("local_score", F.coalesce("local_score", F.lit(0.0))).withColumn("hybrid_score", hybrid(F.col("local_score"), F.col("aggregate_score")))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("hybrid_score", 9)), "visit")
    answers = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return answers.select("query", "rank", "node_id", "local_score", "aggregate_score", "hybrid_score"), trace


#: (query, node) to (relevant, confidence, reason, whether it answers the query).
Judge = Callable[[str, dict], tuple[bool, float, str, bool]]
#: (query, parent, children) to (index of a child, score, reason) of the children to explore.
Ranker = Callable[[str, dict, list[dict]], list[tuple[int, float, str]]]
EXPLORE, SHOWN, KEPT = 0.15, 20, 5


def word_overlap(query: str, node: dict) -> tuple[bool, float, str, bool]:
    """The judge without a model: the share of the query's words in the node's text; any is an answer."""
    words, text = set(query.lower().split()), " ".join(str(node.get(k) or "") for k in ("path", "symbol", "summary")).lower()
    share = sum(w in text for w in words) / max(1, len(words))
    return share > 0, share, f"{share:.2f} of the words", share > 0


def overlap_ranking(query: str, parent: dict, children: list[dict]) -> list[tuple[int, float, str]]:
    """The ranking without a model: children by word_overlap()."""
    return [(k, *word_overlap(query, c)[1:3]) for k, c in enumerate(children)]


def shown_reach(nodes: DataFrame, budget: int) -> DataFrame:
    """The nodes that a guided search may look at: from the first roots, each parent's first ``SHOWN`` children, level by level.

    A search takes one node of each level at least before it takes one below, so
    levels and roots beyond the budget are out of its reach.
    """
    order = Window.partitionBy("parent_id").orderBy(F.col("ord").asc_nulls_last(), "node_id")
    first = nodes.filter("parent_id is not null").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SHOWN).drop("_n")
    kids = materialize(first, "shown")
    out = level = materialize(nodes.filter("parent_id is null").orderBy(F.col("ord").asc_nulls_last(), "node_id").limit(budget), "reach")
    for _ in range(budget - 1):
        above = level.select(F.col("node_id").alias("parent_id")).distinct()
        level = materialize(kids.join(above, "parent_id", "left_semi").select(*nodes.columns), "reach")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def _next(state: dict, budget: int) -> str | None:
    """Takes the frontier's best place that wasn't judged yet, a step for each; gives its node."""
    while state["frontier"] and state["step"] < budget:
        state["step"] += 1
        k = max(range(len(state["frontier"])), key=lambda k: (state["frontier"][k][0], -k))
        _, node = state["frontier"].pop(k)
        if node not in state["seen"]:
            state["seen"].append(node)
            return node
    return None


def guided(nodes: DataFrame, queries: DataFrame, judge: Judge = word_overlap, rank: Ranker = overlap_ranking, *, budget: int = 50, by: str = "query", answers: str | None = None, tries: int = 1) -> DataFrame:
    """Search of nodes (node_id, parent_id, ord, kind, path, symbol, summary) by a judge of relevance, for each of the queries (query, text).

    Gives the trace (query, step, event, node_id, score, reason). A step takes the
    frontier's best and judges it (``evaluate``). A function, block, constant or
    class that the judge calls an answer is one (``answer``) and isn't gone into.
    Containers always are, others where the judge is sure by more than EXPLORE: of
    the first SHOWN children the ranking's best KEPT join the frontier (``expand``).
    A judge that fails counts as not relevant, a ranking that fails as empty. Equal
    places (``ord``) are told apart by id.

    A query's search is one row with its frontier. A round takes every query's next
    node together with its first children, judges all of them in tasks and goes on
    to the next: as many rounds as the longest search has steps. Each finished
    judgement and ranking is a row of the store ``answers`` (see models.Answers;
    without a path, one in the shared folder for this call), keyed by what was
    asked, so that a task that is run again asks for what is missing alone.
    """
    names = ["node_id", "kind", "path", "symbol", "summary"]
    reach = materialize(shown_reach(nodes.select("node_id", "parent_id", "ord", "kind", "path", "symbol", "summary"), budget), "reach")
    below = reach.filter("parent_id is not null").groupBy("parent_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("ord").isNull().alias("a"), "ord", *names)))).alias("children"))  # SHOWN at most
    shown = materialize(reach.select(*names).join(below.withColumnRenamed("parent_id", "node_id"), "node_id", "left"), "shown")
    roots = reach.filter("parent_id is null").orderBy(F.col("ord").asc_nulls_last(), "node_id").select("node_id").limit(budget)
    first = [r.node_id for r in roots.collect()]  # no more than the budget
    named = lambda f: getattr(f, "__qualname__", type(f).__name__)
    store = models.Answers(answers or new_path(nodes.sparkSession, "answers"), tries)
    kind = queries.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, text string, node_id string, state string"

    def begin(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            states = [{"frontier": [[1.0, r] for r in first], "seen": [], "step": 0, "out": []} for _ in range(len(b))]
            at = [_next(x, budget) for x in states]
            yield b.assign(node_id=at, state=[json.dumps(x) for x in states])

    def judged(text: str, node: dict, state: dict) -> None:
        plain = {k: node[k] for k in names}
        told = store.ask(["judge", named(judge), text, plain], lambda: judge(text, plain))
        _, sure, why, answers = (False, 0.0, told.error, False) if told.error else told.value
        node_id, step = node["node_id"], state["step"]
        state["out"].append((step, "evaluate", node_id, float(sure), why))
        if answers and node["kind"] in (*LEAVES, "class"):
            state["out"].append((step, "answer", node_id, float(sure), why))
        elif (node["kind"] in ("repo", "pkg", "file", "class") or sure > EXPLORE) and node["children"]:
            children = [{k: c.get(k) for k in names} for c in json.loads(node["children"])]
            told = store.ask(["rank", named(rank), text, plain, children], lambda: rank(text, plain, children))
            best = sorted((x for x in (told.value or ()) if 0 <= x[0] < len(children)), key=lambda x: -x[1])[:KEPT]
            for k, score, why in best:
                state["frontier"].append([float(score), children[k]["node_id"]])
                state["out"].append((step, "expand", children[k]["node_id"], float(score), why))

    def round_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(node: dict) -> tuple[str | None, str]:
            state = json.loads(node["state"])
            judged(node["text"], node, state)
            return _next(state, budget), json.dumps(state)

        with ThreadPoolExecutor(models.AT_ONCE) as pool:
            for b in batches:
                rows = b.astype(object).where(b.notna(), None).to_dict("records")
                told = list(pool.map(one, rows))
                yield pd.DataFrame({by: b[by], "text": b["text"], "node_id": [n for n, _ in told], "state": [x for _, x in told]})

    state = materialize(queries.select(by, "text").distinct().mapInPandas(begin, schema), "searches")
    done = []
    while True:
        done.append(state.filter("node_id is null").select(by, "state"))
        going = state.filter("node_id is not null")
        if going.isEmpty():
            break
        state = materialize(going.join(shown, "node_id").mapInPandas(round_of, schema), "searches")
    row = F.explode(F.from_json("state", "out array<array<string>>")["out"])
    steps = reduce(DataFrame.unionByName, done).select(by, row.alias("x"))
    return steps.select(by, F.col("x")[0].cast("int").alias("step"), F.col("x")[1].alias("event"), F.col("x")[2].alias("node_id"), F.col("x")[3].cast("double").alias("score"), F.col("x")[4].alias("reason"))


def statistics(trace: DataFrame, budget: int, by: str = "query") -> DataFrame:
    """(query, steps, nodes_visited, answers_found, budget) of a guided search's trace."""
    told = trace.groupBy(by).agg(F.max("step").alias("steps"), F.count_if(F.col("event") == "evaluate").alias("nodes_visited"), F.count_if(F.col("event") == "answer").alias("answers_found"))
    return told.withColumn("budget", F.lit(budget))


def sticky_last(trace: DataFrame, value: Column, when: Column, by: str, order: str) -> Column:
    """The last ``value`` before a row at which ``when`` held."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(when, value), ignorenulls=True).over(w)
