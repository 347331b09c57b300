"""Tree search against small sequential models on random trees."""

import heapq
import json
import os
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arbora.functions import models
from arbora.operators import bm25, search, tree


def random_tree(seed):
    """(node_id, parent_id, ord, kind, path, symbol) of one tree, BM25 hits (query, doc, score, rank), and queries with words of paths."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta"]
    kinds = ["repo"] + [rng.choice(["pkg", "file", "class", "func", "block", "const"]) for _ in range(119)]
    nodes = []
    for i in range(120):
        up = None if i == 0 else rng.choice([j for j in range(i) if kinds[j] not in search.LEAVES][-9:])
        nodes.append((f"n{i:03}", None if up is None else f"n{up:03}", i, kinds[i], "/".join(rng.sample(words, 2)), rng.choice([None, "", *words])))
    queries = [(q, " ".join(rng.choice([*words, "Alpha", "none"]) for _ in range(3))) for q in range(5)]
    hits = [(q, f"n{i:03}", rng.choice([0.5, 1.0, rng.random()]), k + 1) for q, _ in queries for k, i in enumerate(rng.sample(range(120), 40))]
    return nodes, hits, queries


def sequential(nodes, local, text, beam, budget, top):
    """What the surveyed search does for one query: answers (node, own BM25, node score, hybrid), and the nodes in the order of visits."""
    at, below = {n[0]: n for n in nodes}, {}
    for n in nodes:
        below.setdefault(n[1], []).append(n[0])

    def under(i):
        return local.get(i, 0.0) + sum(under(c) for c in below.get(i, []))

    def score(i):
        path, symbol = at[i][4], at[i][5]
        bonus = sum(0.1 for w in text.lower().split() if (symbol and w in symbol.lower()) or (path and w in path.lower()))
        return round(under(i) + bonus, 9)

    heap, visits, answers = [(-score("n000"), "n000")], [], []
    while heap and len(visits) < budget:
        s, i = heapq.heappop(heap)
        visits.append(i)
        if at[i][3] in search.LEAVES:
            answers.append((i, local.get(i, 0.0), -s, 2 * local.get(i, 0.0) - s))
            continue
        for c in sorted(below.get(i, []), key=lambda c: -score(c))[:beam]:
            heapq.heappush(heap, (-score(c), c))
    return sorted(answers, key=lambda x: -round(x[3], 9))[:top], visits


@pytest.mark.parametrize(("seed", "beam", "budget"), [(1, 3, 20), (2, 2, 1000), (3, 10, 60)])
def test_search_on_random_trees(spark, seed, beam, budget):
    nodes, hits, queries = random_tree(seed)
    df = spark.createDataFrame(nodes, "node_id string, parent_id string, ord int, kind string, path string, symbol string")
    answers, trace = search.search(df, spark.createDataFrame(hits, "query int, doc string, score double, rank int"), spark.createDataFrame(queries, "query int, text string"), budget=budget, beam=beam)
    got, visits = {q: [] for q, _ in queries}, {q: [] for q, _ in queries}
    for r in answers.orderBy("query", "rank").collect():
        got[r.query].append((r.node_id, *(round(x, 6) for x in (r.local_score, r.aggregate_score, r.hybrid_score))))
    for r in trace.orderBy("query", "step").collect():
        visits[r.query].append(r.node_id)
    for q, text in queries:
        want, order = sequential(nodes, {d: s for k, d, s, _ in hits if k == q}, text, beam, budget, search.TOP)
        assert visits[q] == order
        assert got[q] == [(i, *(round(x, 6) for x in rest)) for i, *rest in want]


def test_worked_scores(spark):
    docs = spark.createDataFrame([("d1", "src/db/orders.py writeOrder (order: Order) Writes an order row"), ("d2", "src/db/users.py readUser (user_id: int)"), ("d3", "src/api/orders.py getOrder")], "doc string, text string")
    asked = spark.createDataFrame([(1, "write order"), (2, "order order"), (3, "user")], "q int, text string")
    post = bm25.postings(docs, "doc", F.col("text"))
    got = bm25.scores(post, bm25.corpus(docs, post), bm25.query_terms(asked, "q", F.col("text")))
    want = {(1, "d1"): 1.652901, (1, "d3"): 0.552945, (2, "d1"): 1.600012, (2, "d3"): 1.105891, (3, "d2"): 1.401185}
    assert {(r.query, r.doc): round(r.score, 6) for r in got.collect()} == want


def test_tokens(spark):
    from arbora.functions.text import tokens

    cases = {"HTTPServer getUserID2": "h t t p server get user i d2", "__init__ snake_case_Name": "init snake case name", "a1B2c3": "a1 b2c3", "xÄb ÉcoleNormale": "x b cole normale", "fooBAR.baz(x: int = 5)": "foo b a r baz x int 5", "": "", "  ": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: " ".join(r.w) for r in df.select("t", tokens(F.col("t")).alias("w")).collect()} == cases


def test_innermost_keeps_repeated_points(spark):
    from arbora.operators import resolve

    points = spark.createDataFrame([("f", 5), ("f", 5), ("f", 9), (None, 5)], "k string, x int")
    spans = spark.createDataFrame([("f", 1, 10), ("f", 4, 6)], "k string, a int, b int")
    got = resolve.innermost(points, spans, ["k"], at=F.col("x"), start="a", end="b", tie="a")
    assert sorted(map(tuple, got.select("k", "x", "a").collect())) == [("f", 5, 4), ("f", 5, 4), ("f", 9, 1)]


def test_cycles_are_told(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("r", None, 1.0)], "node_id string, parent_id string, v double")
    with pytest.raises(ValueError, match="cycle"):
        tree.ancestors(df, most=5)


def test_json_repair(spark):
    from arbora.functions.text import repair_json

    cases = {r'{"a": "\d"}': r'{"a": "\\d"}', r'{"a": "\\d\n\""}': r'{"a": "\\d\n\""}', r'"\\\w"': r'"\\\\w"', "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", repair_json(F.col("t")).alias("x")).collect()} == cases


def wide_tree():
    """Parents of many children, most of which a search can't look at, and roots and chains beyond the budget."""
    rng = random.Random(8)
    rows, parents = [(f"root{i:02}", None, i, "repo", "") for i in range(4)], ["root00", "root01"]
    for depth in range(3):
        nxt = []
        for p in parents:
            for i in range(rng.choice([3, 25, 60])):
                kind = rng.choice(["pkg", "file", "func", "class"])
                node = f"{p}.{i:02}"
                rows.append((node, p, 100 - i if depth == 1 else i, kind, " ".join(rng.choice(["alpha", "beta", "gamma", "x", "y"]) for _ in range(2))))
                nxt.append(node)
        parents = rng.sample(nxt, min(12, len(nxt)))
    return rows


def sequential_guided(rows, text, budget):
    below = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        below.setdefault(r[1], []).append(r)
    tell = lambda r: search.word_overlap(text, {"path": r[4]})
    frontier, out, step = [(1.0, r) for r in below[None]], [], 0
    while frontier and step < budget:
        step += 1
        frontier.sort(key=lambda x: -x[0])
        r = frontier.pop(0)[1]
        _, sure, _, answers = tell(r)
        out.append((step, "evaluate", r[0], sure))
        if answers and r[3] in (*search.LEAVES, "class"):
            out.append((step, "answer", r[0], sure))
            continue
        if r[3] in ("repo", "pkg", "file", "class") or sure > search.EXPLORE:
            best = sorted(((tell(c)[1], c) for c in below.get(r[0], [])[: search.SHOWN]), key=lambda x: -x[0])[: search.KEPT]
            frontier += best
            out += [(step, "expand", c[0], score) for score, c in best]
    return out


@pytest.mark.parametrize("budget", [2, 50])
def test_guided_looks_only_at_nodes_in_reach(spark, budget):
    rows = wide_tree()
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, ord int, kind string, path string").withColumns({"symbol": F.lit(None).cast("string"), "summary": F.lit(None).cast("string")})
    asked = [(k, t) for k, t in enumerate(["alpha", "beta gamma", "x alpha y", "none", "gamma", "y y beta", "alpha beta gamma"])]
    got = {}
    trace = search.guided(nodes, spark.createDataFrame(asked, "query int, text string"), budget=budget).cache()
    for r in trace.collect():
        got.setdefault(r.query, []).append((r.step, r.event, r.node_id, r.score))
    want = {q: sequential_guided(rows, t, budget) for q, t in asked}
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    for r in search.statistics(trace, budget).collect():
        kinds = [x[1] for x in want[r.query]]
        assert (r.steps, r.nodes_visited, r.answers_found) == (want[r.query][-1][0], kinds.count("evaluate"), kinds.count("answer"))
    reach = search.shown_reach(nodes, budget)
    most = reach.filter("parent_id is not null").groupBy("parent_id").count().agg(F.max("count")).first()[0]
    assert most <= search.SHOWN and reach.count() < len(rows) / 2
    assert reach.filter("parent_id is null").count() == min(budget, 4)


def test_guided_asks_for_each_place_once(spark, tmp_path):
    """Calls leave a file each; a search that breaks off and is begun again asks only for what is missing."""
    rows = wide_tree()
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, ord int, kind string, path string").withColumns({"symbol": F.lit(None).cast("string"), "summary": F.lit(None).cast("string")})
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(["alpha", "beta gamma", "none"])], "query int, text string")
    calls, armed = tmp_path / "calls", tmp_path / "armed"
    calls.mkdir()
    armed.mkdir()

    def judge(text, node):
        if node["node_id"].count(".") == 2 and text == "beta gamma" and armed.exists():
            armed.rmdir()
            os._exit(1)  # the worker is lost with what it holds
        (calls / uuid.uuid4().hex).write_text(json.dumps([text, node["node_id"]]))
        return search.word_overlap(text, node)

    run = lambda: search.guided(nodes, asked, judge, budget=25, answers=str(tmp_path / "answers")).collect()
    with pytest.raises(Exception, match="crash|exit|EOF|fail"):
        run()
    before = len(list(calls.iterdir()))
    got = {}
    for r in run():
        got.setdefault(r.query, []).append((r.step, r.event, r.node_id, r.score))
    want = {q: sequential_guided(rows, t, 25) for q, t in [(0, "alpha"), (1, "beta gamma"), (2, "none")]}
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    made = Counter(f.read_text() for f in calls.iterdir())
    assert before and max(made.values()) == 1
    assert len(made) == sum(e == "evaluate" for x in want.values() for _, e, *_ in x)


def test_answers_are_kept_and_tried_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(text):
        (calls / uuid.uuid4().hex).write_text(text)
        if text.startswith("bad") or (text == "late" and sum(f.read_text() == "late" for f in calls.iterdir()) < 3):
            raise RuntimeError("busy")
        return text.upper()

    texts = ["a", "b", "a", "late", "bad", None, "b" * 9000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    ask = lambda: {r.k: r.summary for r in models.summarize(rows, "t", model, store=str(tmp_path / "store"), tries=3, wait=0.01).collect()}
    want = {k: None if t is None or t == "bad" else t[: models.MOST_CHARS].upper() for k, t in enumerate(texts)}
    assert ask() == want
    assert Counter(f.read_text()[:9] for f in calls.iterdir()) == {"a": 1, "b": 1, "late": 3, "bad": 3, "b" * 9: 1}
    assert ask() == want  # only what failed for good is asked again
    assert Counter(f.read_text()[:9] for f in calls.iterdir()) == {"a": 1, "b": 1, "late": 3, "bad": 6, "b" * 9: 1}


def test_calls_keep_to_a_rate(tmp_path):
    import time

    store, began = models.Answers(str(tmp_path), gap=0.05), time.monotonic()
    assert [store.ask(k, lambda k=k: k).value for k in range(5)] == list(range(5))
    assert time.monotonic() - began >= 0.2
    began = time.monotonic()
    assert [store.ask(k, None).value for k in range(5)] == list(range(5))
    assert time.monotonic() - began < 0.2
