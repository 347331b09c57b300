from arbora.operators import mermaid

TEXTS = {
    "fine": 'graph TD\n  %% a comment\n  subgraph one [Two]\n  a["Alpha"]\n  b-1((Beta))\n  a --> b-1\n  end',
    "chain": "graph lr\n a --> b-1 --> c; c -.-> a\n a --|why|> c\n a -->|why| d\n a --> b-1",
    "bare": "\nflowchart TD\na[]\n a{'Alpha'}\nx( )\nx --> a",
    "none": "",
}


def frames(spark):
    return spark.createDataFrame(list(TEXTS.items()), "name string, text string"), spark.createDataFrame([("Alpha",), ("Beta",), ("b-1",), ("a",)], "label string")


def test_edges_and_nodes(spark):
    diagrams, _ = frames(spark)
    each = mermaid.lines(diagrams)
    got = {(r.name, r.src, r.dst, r.times) for r in mermaid.labelled_edges(mermaid.nodes(each), mermaid.edges(each)).collect()}
    assert got == {("fine", "Alpha", "Beta", 1), ("chain", "a", "b-1", 1), ("chain", "c", "a", 1), ("chain", "a", "b-1", 2), ("chain", "a", "c", 1), ("bare", "x", "Alpha", 1)}
    assert {(r.name, r.id, r.label) for r in mermaid.nodes(each).collect()} == {("fine", "a", "Alpha"), ("fine", "b-1", "Beta"), ("bare", "a", "Alpha"), ("bare", "x", "x")}


def test_validation_of_one_and_of_all(spark):
    diagrams, allowed = frames(spark)
    got = {r.name: (r.errors, r.covered, r.unknown_nodes, r.unknown_edges, r.repeated_edges, r.valid) for r in mermaid.validate(diagrams, allowed).collect()}
    assert got == {
        "fine": ([], 2, 0, 0, 0, True),
        "chain": ([], 0, 0, 2, 1, False),
        "bare": (["missing header", "missing label: a", "missing label: x"], 1, 1, 1, 0, False),
        "none": (["empty diagram"], 0, 0, 0, 0, False),
    }
    s = mermaid.summary(diagrams, allowed).first()
    assert (s.allowed, s.covered, s.unknown, s.with_errors, s.coverage, s.passes) == (4, 2, 2, 2, 0.5, False)
    good = mermaid.summary(diagrams.filter("name = 'fine'"), allowed.filter("label in ('Alpha', 'Beta')")).first()
    assert good.coverage == 1.0 and good.passes
    repeated = diagrams.sparkSession.createDataFrame([("r", "graph TD\na[Alpha]\nb[Beta]\na --> b\na --> b")], "name string, text string")
    r = mermaid.validate(repeated, allowed).first()
    assert r.repeated_edges == 1 and r.valid
