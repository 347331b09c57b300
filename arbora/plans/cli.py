"""``python -m arbora.plans.cli build|search|trace|arch``."""

from __future__ import annotations

import argparse
import json
from importlib import import_module

from pyspark.sql import SparkSession

from arbora.functions import models
from arbora.operators import search
from arbora.plans import build, describe, find
from arbora.sources.sinks import exists


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arbora")
    verbs = p.add_subparsers(dest="verb", required=True)
    b = verbs.add_parser("build", help="index a source tree")
    b.add_argument("repo")
    b.add_argument("--out", default="index")
    b.add_argument("--summarizer", choices=("off", "first-words"), default="off")
    b.add_argument("--min-loc", type=int, default=20)
    b.add_argument("--summary-scope", choices=("files", "structured"), default="structured")
    s = verbs.add_parser("search", help="search an index")
    s.add_argument("query")
    s.add_argument("--index", default="index")
    s.add_argument("--top", type=int, default=search.TOP)
    s.add_argument("--budget", type=int, default=search.BUDGET)
    s.add_argument("--mode", choices=("bm25", "guided"), default="bm25")
    t = verbs.add_parser("trace", help="where the last search's report is")
    t.add_argument("--index", default="index")
    a = verbs.add_parser("arch", help="describe an index's architecture")
    a.add_argument("--index", default="index")
    a.add_argument("--out", default="architecture")
    a.add_argument("--diagram-mode", choices=describe.MODES, default="deterministic")
    a.add_argument("--drafter", default="arbora.plans.redraft:plain_draft", help="module:function that drafts a diagram")
    a.add_argument("--diagram-coverage", type=float, default=0.95)
    a.add_argument("--diagram-redrafts", type=int, default=2)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("arbora").getOrCreate()
    if args.verb == "build":
        config = build.BuildConfig(models.first_words if args.summarizer == "first-words" else None, args.min_loc, args.summary_scope)
        print(json.dumps(build.build(spark, args.repo, args.out, config).first().asDict()))
    elif args.verb == "search":
        answers, steps = find.find(spark, args.index, args.query, top=args.top, budget=args.budget, judge=search.word_overlap if args.mode == "guided" else None)
        find.report(spark, args.index, args.query, answers, steps)
        print("\n".join(answers.toJSON().collect()))
    elif args.verb == "trace":
        page = f"{args.index}/trace.html"
        print(page if exists(spark, page) else "no search has been made")
        return 0 if exists(spark, page) else 1
    else:
        module, _, name = args.drafter.partition(":")
        draft = None if args.diagram_mode == "deterministic" else getattr(import_module(module), name)
        config = describe.DescribeConfig(draft=draft, mode=args.diagram_mode, coverage=args.diagram_coverage, redrafts=args.diagram_redrafts)
        print(json.dumps(describe.describe(spark, args.index, args.out, config), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
