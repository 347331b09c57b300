"""Diagrams drafted by a model and redrafted, all at a time, until the set of them passes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.models import AT_ONCE, Answers
from arbora.operators import mermaid
from arbora.sources.shared import materialize, new_path

#: Drafts one diagram: (name, labels, edges, faults of its last draft or None) -> text. It runs in tasks.
Draft = Callable[[str, list[str], list[tuple[str, str]], dict | None], str]

DRAFT_SCHEMA = "name string, round int, text string"


def plain_draft(name: str, labels: list[str], ends: list[tuple[str, str]], faults: dict | None) -> str:
    """A drafter without a model: labels as nodes, then the edges."""
    node = {label: f"n{k}" for k, label in enumerate(labels)}
    return "\n".join(["graph TD", *[f'    {node[x]}["{x}"]' for x in labels], *[f"    {node[a]} --> {node[b]}" for a, b in ends if a in node and b in node]])


def latest(drafts: DataFrame) -> DataFrame:
    """(name, text): the last draft of each diagram."""
    return drafts.groupBy("name").agg(F.max_by("text", "round").alias("text"))


def _draw(todo: DataFrame, draft: Draft, turn: int, store: str) -> DataFrame:
    """Drafts of (name, labels, ends, told); finished calls are in the store, so that a task that is run again repeats none."""
    kept, who = Answers(store), getattr(draft, "__qualname__", type(draft).__name__)

    def one(name: str, asked: str) -> str:
        labels, ends, told = json.loads(asked)
        got = kept.ask(["draft", who, name, asked], lambda: draft(name, labels, [tuple(e) for e in ends], told))
        return got.value if isinstance(got.value, str) else ""  # a call that failed for good is an empty diagram, which is a fault

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                yield pd.DataFrame({"name": batch["name"], "round": turn, "text": list(pool.map(one, batch["name"], batch["asked"]))})

    ends = F.transform("ends", lambda e: F.array(e["src"], e["dst"]))
    asked = F.concat(F.lit("["), F.to_json("labels"), F.lit(","), F.to_json(ends), F.lit(","), F.coalesce("told", F.lit("null")), F.lit("]"))
    return todo.select("name", asked.alias("asked")).repartition("name").mapInPandas(run, DRAFT_SCHEMA)


def redraft(wanted: DataFrame, allowed: DataFrame, draft: Draft, *, coverage: float = 0.95, most: int = 2, store: str | None = None) -> tuple[DataFrame, bool]:
    """All drafts (name, round, text), and whether the set of the last ones passes.

    ``wanted``: (name, labels, ends) with names not null and not repeated; labels and
    ends may be null or empty. A round drafts at once all that failed in the round
    before, each told its own errors, unknown nodes and unknown edges; where the set
    covers too few of the ``allowed`` labels, also those diagrams that should show
    a label that none does, told which. It ends when the set passes, when nothing
    has anything to mend, or after ``most`` rounds. Without wanted diagrams there
    are no drafts. An edge's end counts as unknown even where no node states it.
    """
    spark = wanted.sparkSession
    store = store or new_path(spark, "drafts")
    none = F.array().cast("array<string>")
    wanted = materialize(wanted.select("name", F.coalesce("labels", none).alias("labels"), F.coalesce("ends", F.array().cast(wanted.schema["ends"].dataType)).alias("ends")), "wanted")
    allowed = materialize(allowed.select("label").distinct(), "allowed")
    total = allowed.count()
    todo, drafts, passes = wanted.withColumn("told", F.lit(None).cast("string")), None, False
    for turn in range(1, max(1, most) + 1):
        drawn = materialize(_draw(todo, draft, turn, store), "drafts")
        drafts = drawn if drafts is None else drafts.unionByName(drawn)
        now = materialize(latest(drafts), "latest")
        shown = materialize(mermaid.nodes(mermaid.lines(now)).select("label").distinct(), "shown")
        covers = not total or allowed.join(shown, "label", "left_semi").count() >= coverage * total
        found = materialize(mermaid.faults(now, allowed), "faults")
        passes = covers and found.isEmpty()
        if passes or turn == most:
            break
        found = found.withColumn("missing", none)
        if not covers:
            lacking = allowed.join(shown, "label", "left_anti")
            should = wanted.select("name", F.explode("labels").alias("label")).join(lacking, "label", "left_semi").groupBy("name").agg(F.array_sort(F.collect_set("label")).alias("missing"))
            found = found.drop("missing").join(should, "name", "full")
        fields = ("errors", "unknown_nodes", "unknown_edges", "missing")
        told = found.select("name", F.to_json(F.struct(*[F.coalesce(c, none).alias(c) for c in fields])).alias("told"))
        todo = materialize(wanted.join(told, "name"), "todo")
        if todo.isEmpty():
            break
    return drafts, passes
