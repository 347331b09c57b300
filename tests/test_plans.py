import json
import uuid

import pytest
from pyspark.sql import functions as F

from arbora.functions import models
from arbora.operators import search, trace, tree
from arbora.plans import build, cli, describe, find
from arbora.sources.sinks import IndexFiles, read_jsonl

FILES = {
    "src/orders/__init__.py": "",
    "src/orders/cli.py": "from users import store\n\n\ndef main():\n    store.write_user()\n    write_order()\n\n\ndef write_order():\n    '''Writes an order row.'''\n    return 1\n",
    "src/users/store.py": '"""Keeps users."""\n\n\nclass Store:\n    def write_user(self):\n        pass\n' + "\n" * 30,
    "src/users/web_routes.ts": "export function get(req: Request) {\n  return handle(req);\n}\n",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("repo"), tmp_path_factory.mktemp("out")
    for path, body in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    (root / "src/users/old.py").write_bytes(b"# \xe9")
    (root / "src/users/torn.py").write_text("def (")
    assert cli.main(["build", str(root), "--out", str(out), "--summarizer", "first-words"], spark) == 0
    return str(out)


def test_build(spark, index):
    nodes = tree.load_nodes(IndexFiles(spark, index).read("nodes"))
    rows = {(r.kind, r.path, r.symbol): r for r in nodes.collect()}
    file = rows["file", "src/users/store.py", "store.py"]
    pkg = next(r for (k, p, _), r in rows.items() if k == "pkg" and p == "src/users")
    repo = next(r for r in rows.values() if r.kind == "repo")
    assert file.parent_id == pkg.node_id and pkg.parent_id == repo.node_id and repo.parent_id is None
    assert file.summary == "Keeps users." and rows["file", "src/orders/__init__.py", "__init__.py"].loc == 0
    assert IndexFiles(spark, index).read("meta").first().files == 4
    assert {r.path: r.error == "not UTF-8" for r in IndexFiles(spark, index).read("errors").collect()} == {"src/users/old.py": True, "src/users/torn.py": False}
    ords = [r.ord for r in rows.values() if r.kind not in ("pkg", "repo")]
    assert len(set(ords)) == len(ords)


def test_search_and_trace(spark, index, capsys):
    assert cli.main(["trace", "--index", index], spark) == 1
    assert cli.main(["search", "write order", "--index", index, "--top", "3"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines[0]["symbol"] == "write_order" and len(lines) == 3
    assert cli.main(["trace", "--index", index], spark) == 0
    with open(f"{index}/trace.html") as f:
        assert "write_order" in f.read()
    answers, steps = find.find(spark, index, "write order", judge=search.word_overlap)
    assert answers.first().symbol == "write_order" and steps.count() > 3
    nodes = IndexFiles(spark, index).read("nodes")
    placed, areas = trace.impact_map(nodes)
    edges = trace.impact_edges(IndexFiles(spark, index).edges(), placed)
    assert placed.count() == 4 and edges.count() >= 1 and areas.count() == 3  # main -> write_order
    find.report(spark, index, "write <order>", answers, steps)
    with open(f"{index}/trace.html") as f:
        page = f.read().splitlines()
    assert "<h1>write &lt;order&gt;</h1>" in page and [x for x in page if "class=card" in x][0].startswith("<div class=card><b>func</b> write_order")
    rows = [x for x in page if x.startswith("<div class='n ")]
    walked = [int(x.split("data-d=")[1].split(" ")[0]) for x in rows]
    assert len(rows) == nodes.count() and walked[0] == 0 and all(b <= a + 1 for a, b in zip(walked, walked[1:], strict=False))
    reached = {r.node_id: r for r in trace.reached(steps, "query").collect()}
    assert sum("explored" in x for x in rows) == sum(r.explored for r in reached.values()) > 0 and sum("answer" in x for x in rows) == sum(r.answer for r in reached.values()) > 0
    assert sum(x.startswith("<circle") for x in page) == 4 and sum(x.startswith("<line") for x in page) == edges.count()
    told = [x for x in page if x.startswith("<div style='margin-left:")]
    assert len(told) == steps.filter("event in ('evaluate', 'expand')").count() and ". evaluate" in told[0] and ". expand" in told[1] and "30px" in told[1]


def test_arch(spark, index, tmp_path, capsys):
    assert cli.main(["arch", "--index", index, "--out", str(tmp_path)], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["components"] == 2
    assert "cli" in (tmp_path / "components/orders.md").read_text()
    text = (tmp_path / "index.md").read_text()
    assert "graph TD" in text and "components/users.md" in text
    assert "orders --> users" in (tmp_path / "diagrams/system.mmd").read_text()
    assert [r["path"] for r in json.loads((tmp_path / "structure.json").read_text())][1:] == ["src/orders", "src/users"]
    listed = [x for x in (tmp_path / "files.md").read_text().splitlines() if x.startswith("- ")]
    assert listed == ["- `src/orders/__init__.py`", "- `src/orders/cli.py`", "- `src/users/store.py` Keeps users.", "- `src/users/web_routes.ts`"]


def test_drafts(spark, index, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def draft(name, labels, ends, faults):
        (asked / uuid.uuid4().hex).write_text(json.dumps([name, faults]))
        ids = "\n".join(f'{x}["{x}"]' for x in labels)
        return "graph TD\n" + ids + ("\nusers --> nowhere" if not faults else "".join(f"\n{a} --> {b}" for a, b in ends))

    describe.describe(spark, index, str(tmp_path / "a"), describe.DescribeConfig(draft=draft, mode="hybrid", guides=(("Order flow", ("orders",), ("routes",)),)))
    told = (tmp_path / "a/guides/order-flow.md").read_text()
    assert "Depends on: users." in told and "src/orders/cli.py" in told and "web_routes" in told
    assert (tmp_path / "a/diagrams/structure.mmd").read_text().startswith("mindmap") and "roles" not in (tmp_path / "a/diagrams/roles.mmd").read_text().splitlines()[0]
    seen = [json.loads(x.read_text()) for x in asked.iterdir()]
    assert sorted(n for n, f in seen if f is None) == sorted(n for n, f in seen if f) == ["orders", "system", "users"]
    assert all(f == {"errors": [], "unknown_nodes": [], "unknown_edges": ["users->nowhere"], "missing": []} for _, f in seen if f)
    assert (tmp_path / "a/diagrams/system.mmd").read_text() == 'graph TD\norders["orders"]\nusers["users"]\norders --> users\n'
    with pytest.raises(RuntimeError):
        describe.describe(spark, index, str(tmp_path / "b"), describe.DescribeConfig(draft=lambda *a: "graph TD", mode="model"))
    with pytest.raises(ValueError):
        describe.DescribeConfig(mode="hybrid")


def test_export_and_models(spark, index):
    files = IndexFiles(spark, index)
    files.export()
    back = read_jsonl(spark, f"{index}/edges.jsonl", "src string, dst string, type string, detail string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.edges().collect()))
    rows = spark.createDataFrame([(1, "# Title here\nmore"), (2, "boom"), (3, None)], "k int, body string")

    def model(text):
        if text == "boom":
            raise ValueError
        return models.first_words(text)

    assert {r.k: r.summary for r in models.summarize(rows, "body", model).collect()} == {1: "Title here", 2: None, 3: None}
    with pytest.raises(ValueError):
        build.BuildConfig(scope="other")


def test_answers_are_packed_and_kept(spark, tmp_path):
    """Thousands of answers are a few files; a second run asks nothing, equal texts are asked once, and answers in files of their own still count."""
    store, log = str(tmp_path / "store"), tmp_path / "log"

    def model(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        return None if text.endswith("7") else text.upper()

    who = model.__qualname__
    models.Answers(store).ask(["summary", who, "text 5"], lambda: "kept before")
    rows = spark.range(6000).selectExpr("id", "concat('text ', id % 3000) as body", "'x' as summary").repartition(4)
    want = {k: None if k % 10 == 7 else f"TEXT {k}" for k in range(3000)} | {5: "kept before"}
    for _ in range(2):
        got = models.summarize(rows, "body", model, store=store).collect()
        assert len(got) == 6000 and all(r.summary == want[r.id % 3000] for r in got)
    assert sorted(log.read_text().split("\n")[:-1]) == sorted(f"text {k}" for k in range(3000) if k != 5)
    assert 0 < sum(1 for _ in (tmp_path / "store").rglob("*") if _.is_file()) < 100


def test_postings_move_texts_once(spark, tmp_path):
    """Counts, limit and lengths of postings take the one shuffle of texts; rows of equal ids are one document."""
    from arbora.operators import bm25

    spark.createDataFrame([(1, "a b a"), (2, "b c"), (1, "c c c"), (3, None)], "id long, t string").write.parquet(str(tmp_path / "d"))
    post = bm25.postings(spark.read.parquet(str(tmp_path / "d")), "id", F.col("t"), vocabulary=2)
    for df in (post, bm25.lengths(post)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, post.collect())) == [(1, "a", 2), (1, "c", 3), (2, "b", 1), (2, "c", 1)]
