import os
import random

import pytest
from pyspark.sql import functions as F

from arbora.operators import mermaid, tree
from arbora.plans.redraft import latest, plain_draft, redraft
from arbora.sources import documents


@pytest.mark.parametrize("seed", [1])
def test_preorder_equals_a_walk(spark, seed):
    """A hot parent, several roots, a parent that is no node, null and equal keys."""
    rng = random.Random(seed)
    rows = [("r0", None, "b"), ("r1", None, "a"), ("r2", "gone", None)]
    for k in range(600):
        up = "r1" if k % 3 == 0 else rng.choice(rows)[0]
        rows.append((f"n{k}", up, rng.choice([None, "a", "b", "ä", ""])))
    below: dict = {}
    ids = {r[0] for r in rows}
    for n, up, key in rows:
        below.setdefault(up if up in ids else None, []).append((key is not None, (key or "").encode(), n))
    want, todo = [], [(n, 0) for _, _, n in sorted(below[None], reverse=True)]
    while todo:
        n, depth = todo.pop()
        want.append((n, depth, len(want)))
        todo += [(x, depth + 1) for _, _, x in sorted(below.get(n, []), reverse=True)]
    got = tree.preorder(spark.createDataFrame(rows, "node_id string, parent_id string, k string"), F.col("k")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_preorder_of_nothing(spark):
    assert tree.preorder(spark.createDataFrame([], "node_id string, parent_id string"), F.lit("")).count() == 0


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("old\n")
    rows = [(f"f{k % 7}/t.gz" if k % 2 else "a.md", 0, "", k, f"line {k} ä") for k in range(5000)] + [("a.md", 1, "", 0, None), ("a.md", 0, "x", 0, "last")]
    random.Random(0).shuffle(rows)
    each = spark.createDataFrame(rows, documents.LINE_SCHEMA).repartition(9)
    documents.write_documents(each, str(tmp_path))
    want: dict = {}
    for file, *_, text in sorted(rows, key=lambda r: r[:4]):
        want.setdefault(file, []).append((text or "") + "\n")
    got = {os.path.relpath(os.path.join(at, x), tmp_path): open(os.path.join(at, x), encoding="utf-8").read() for at, _, names in os.walk(tmp_path) for x in names}
    assert got == {f: "".join(x) for f, x in want.items()} and not [x for x in os.listdir(tmp_path) if x.startswith(".")]


@pytest.mark.parametrize("name", [None, "", "../up.md", "/etc/x", "a//b"])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, name):
    (tmp_path / "a.md").write_text("old\n")
    each = spark.createDataFrame([("a.md", 0, "", 0, "new"), (name, 0, "", 0, "bad")], documents.LINE_SCHEMA)
    with pytest.raises(Exception, match="no name of a document"):
        documents.write_documents(each, str(tmp_path))
    assert os.listdir(tmp_path) == ["a.md"] and (tmp_path / "a.md").read_text() == "old\n"


def test_redraft(spark, tmp_path):
    """A diagram that lacks a label is told so only if it should show it; failed calls are empty diagrams; a second run asks nothing."""
    wanted = spark.createDataFrame([("one", ["a", "b"], [("a", "b")]), ("two", ["c"], None), ("three", None, None)], "name string, labels array<string>, ends array<struct<src:string,dst:string>>")
    allowed = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "label string")
    calls = tmp_path / "calls"
    calls.mkdir()

    def draft(name, labels, ends, faults):
        (calls / f"{name}-{len(os.listdir(calls))}").write_text(repr(faults))
        if name == "one" and faults is None:
            return 'graph TD\nx["a"]'
        return plain_draft(name, labels, ends, faults)

    for _ in range(2):
        drafts, passes = redraft(wanted, allowed, draft, coverage=1.0, most=3, store=str(tmp_path / "store"))
        assert passes and sorted((r["name"], r["round"]) for r in drafts.collect()) == [("one", 1), ("one", 2), ("three", 1), ("two", 1)]
        assert len(os.listdir(calls)) == 4
    told = [x.read_text() for x in calls.iterdir() if x.name.startswith("one")]
    assert sorted(told) == sorted(["None", repr({"errors": [], "unknown_nodes": [], "unknown_edges": [], "missing": ["b"]})])
    assert {r["name"]: r["text"] for r in latest(drafts).collect()}["one"].endswith("n0 --> n1")
    drafts, passes = redraft(wanted, allowed, lambda *a: None, most=2)
    assert not passes and drafts.count() == 6 and {r.errors[0] for r in mermaid.faults(latest(drafts), allowed).collect()} == {"empty diagram"}
    drafts, passes = redraft(wanted.limit(0), allowed, draft, most=2)
    assert drafts.count() == 0 and not passes
