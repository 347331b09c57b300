"""Path, component and role functions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed top folders that don't name a component.
TOP_FOLDERS = ("src", "apps", "packages")

# The rules of roles, categories and entry points. Each is
# (result, subject, test, words); tests are contains, starts, ends and is.

#: Roles of a component by its files' paths and its name.
COMPONENT_ROLES = (
    ("api", "path", "contains", ("/routes/", "router", "api/")),
    ("frontend", "path", "ends", (".tsx", ".jsx")),
    ("frontend", "path", "contains", ("components/",)),
    ("worker", "path", "contains", ("worker", "workflow", "temporal")),
    ("lambda", "path", "contains", ("lambda",)),
    ("tests", "path", "contains", ("test", "spec", "fixtures")),
    ("infrastructure", "path", "contains", ("infra", "terraform")),
    ("frontend", "name", "contains", ("app", "ui", "web")),
    ("api", "name", "contains", ("api", "backend", "server")),
    ("worker", "name", "contains", ("worker", "temporal")),
    ("lambda", "name", "contains", ("lambda",)),
    ("tests", "name", "contains", ("test", "e2e")),
    ("infrastructure", "name", "contains", ("infra",)),
)
#: Roles of a component as its documents tell them.
DOCUMENT_ROLES = (
    ("frontend", "name", "contains", ("app", "web", "ui", "vendor")),
    ("backend", "name", "contains", ("backend", "api", "server")),
    ("worker", "name", "contains", ("worker", "temporal")),
    ("lambda", "name", "contains", ("lambda",)),
    ("infrastructure", "name", "contains", ("infra", "terraform")),
    ("tests", "name", "contains", ("test", "e2e", "integration")),
    ("api", "path", "contains", ("routes", "router", "api/")),
    ("frontend", "path", "ends", (".tsx", ".jsx")),
    ("frontend", "path", "contains", ("components/",)),
    ("worker", "path", "contains", ("/worker", "/workflow")),
    ("infrastructure", "path", "contains", ("infra", "terraform")),
    ("tests", "path", "contains", ("tests", "spec")),
)
#: Roles of a package by its path and its files' names.
PACKAGE_ROLES = (
    ("tests", "path", "starts", ("tests",)),
    ("tests", "file", "starts", ("test",)),
    ("cli", "file", "is", ("cli.py",)),
    ("indexer", "file", "contains", ("indexer",)),
    ("search", "file", "is", ("searcher.py", "bm25.py", "llm_search.py")),
    ("search", "file", "ends", ("_search.py",)),
    ("web", "file", "ends", ("_routes.py", "_api.py")),
)
#: Categories of a flow; the first that fits counts, else ``function``.
FLOW_CATEGORIES = (
    ("workflow", "path", "contains", ("temporal", "workflow", "worker")),
    ("http-route", "path", "contains", ("routes",)),
    ("http-route", "symbol", "is", ("get", "post", "put", "delete")),
    ("cli", "path", "contains", ("cli",)),
    ("cli", "symbol", "is", ("main", "cli", "entrypoint")),
    ("task", "path", "contains", ("task", "job")),
    ("task", "symbol", "is", ("task", "job")),
)
CATEGORY_ORDER = ("cli", "workflow", "http-route", "task", "route-module", "function")
#: What looks like an entry point.
ENTRY_POINTS = (
    ("entry", "symbol", "is", ("main", "handler", "run", "start", "workflow", "worker", "execute", "process", "task")),
    ("entry", "path", "contains", ("workflow", "worker", "routes", "cli")),
    ("entry", "symbol", "starts", ("handle_",)),
    ("entry", "symbol", "ends", ("_handler",)),
)
#: Files that matter most in a package, in this order.
PREFERRED_FILES = ("cli.py", "indexer.py", "searcher.py", "bm25.py", "llm_search.py")


def component_name(path: Column) -> Column:
    """The first folder, or the second below ``src``, ``apps`` or ``packages``; ``root`` for an empty path."""
    parts = F.split(path, "/")
    return F.when(path == "", "root").when(parts[0].isin(*TOP_FOLDERS) & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(parts[0])


def segments(target: Column) -> Column:
    """An import's text as a list of names: quotes dropped, ``/`` and ``.`` separate."""
    return F.array_remove(F.split(F.translate(F.regexp_replace(target, "^['\"]+|['\"]+$", ""), "/", "."), "[.]"), "")


def under(path: Column, folder: Column) -> Column:
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def _fits(rule: tuple, subjects: dict[str, Column]) -> Column:
    _, subject, test, words = rule
    low = F.coalesce(F.lower(subjects[subject]), F.lit(""))
    if test == "is":
        return low.isin(*words)
    each = [{"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[test](low, F.lit(w)) for w in words]
    return reduce(or_, each)


def tags(rules: tuple, **subjects: Column) -> Column:
    """All results of the rules that fit, once each, in order of name."""
    known = [r for r in rules if r[1] in subjects]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(_fits(r, subjects), F.lit(r[0])) for r in known]))))


def category(path: Column, symbol: Column) -> Column:
    """A flow's category."""
    out = F.when(F.lit(False), "")
    for rule in FLOW_CATEGORIES:
        out = out.when(_fits(rule, {"path": path, "symbol": symbol}), rule[0])
    return out.otherwise("function")


def category_rank(name: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, known in enumerate(CATEGORY_ORDER):
        out = out.when(name == known, k)
    return out.otherwise(9)


def looks_like_entry(path: Column, symbol: Column) -> Column:
    return reduce(or_, [_fits(rule, {"path": path, "symbol": symbol}) for rule in ENTRY_POINTS])


def file_rank(name: Column) -> Column:
    """Preferred files first; all others share a rank after them."""
    out = F.when(F.lit(False), 0)
    for k, known in enumerate(PREFERRED_FILES):
        out = out.when(name == known, k)
    return out.otherwise(len(PREFERRED_FILES) + 1)


#: Fixed names of folders that a source scan leaves out, and the endings of others; so are those that begin with a dot.
EXCLUDED_FOLDERS = ("venv", "env", "__pycache__", "dist", "build", "node_modules", "htmlcov", "coverage", "target", "tmp", "temp")
EXCLUDED_ENDINGS = ("-info", ".egg-info")
SOURCE_ENDINGS = (".py", ".js", ".jsx", ".ts", ".tsx")


def excluded_folder(name: str) -> bool:
    return name in EXCLUDED_FOLDERS or name.startswith(".") or name.endswith(EXCLUDED_ENDINGS)


def source_file(name: str) -> bool:
    return not name.startswith(".") and name.lower().endswith(SOURCE_ENDINGS)
