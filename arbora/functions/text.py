"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case identifier parts: runs of ASCII letters and digits, with each capital starting a part."""
    parted = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " "), "([A-Z])", " $1")
    return F.array_remove(F.split(F.lower(parted), " +"), "")


def stable_id(kind: Column, path: Column, symbol: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """A node's identity: SHA-1 of its kind, path, symbol and line span."""
    text = lambda c: F.lit("") if c is None else F.coalesce(c, F.lit(""))
    line = lambda c: F.lit("0") if c is None else F.coalesce(c.cast("string"), F.lit("0"))
    return F.sha1(F.concat_ws("\t", kind, path, text(symbol), line(start), line(end)))


def node_text(path: Column, symbol: Column, signature: Column, summary: Column) -> Column:
    """What the search index holds of a node."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (path, symbol, signature, summary)])


def first_line(text: Column, most: int = 400) -> Column:
    """The first line that isn't blank, without surrounding blanks; null if there is none."""
    line = F.rtrim(F.regexp_extract(text, r"(\S[^\n]*)", 1))
    return F.when(line != "", F.substring(line, 1, most))


def compress(text: Column, most: int = 6000) -> Column:
    """A long text's head (70 % of ``most``) and tail (25 %)."""
    head, tail = int(most * 0.7), int(most * 0.25)
    cut = F.concat(F.rtrim(F.substring(text, 1, head)), F.lit("\n...\n"), F.ltrim(F.right(text, F.lit(tail))))
    return F.when(F.length(text) > most, cut).otherwise(text)


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), start, end - start + 1), "\n")


def line_count(text: Column) -> Column:
    lines = F.size(F.split(text, "\n"))
    return F.when(text == "", F.lit(0)).otherwise(lines - F.when(F.endswith(text, F.lit("\n")), F.lit(1)).otherwise(F.lit(0)))


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def is_constant_name(name: Column) -> Column:
    """All cased letters are capitals, and there is one; two characters at least."""
    return (name == F.upper(name)) & (name != F.lower(name)) & (F.length(name) >= 2)


def visibility(name: Column) -> Column:
    """``__x`` is private; ``_x`` and ``__x__`` are protected; others public."""
    dunder = F.startswith(name, F.lit("__"))
    return F.when(dunder & ~F.endswith(name, F.lit("__")), "private").when(F.startswith(name, F.lit("_")), "protected").otherwise("public")


def stats_text(**counts: Column) -> Column:
    """``3 files, 2 classes``: the counts above zero, or ``empty``."""
    told = F.concat_ws(", ", *[F.when(c > 0, F.concat_ws(" ", c.cast("string"), F.lit(name))) for name, c in counts.items()])
    return F.when(told == "", "empty").otherwise(told)


def score_text(score: Column) -> Column:
    return F.format_string("%.3f", score)


def repair_json(text: Column) -> Column:
    """Backslashes that start no JSON escape are doubled; escaped backslashes stay."""
    return F.regexp_replace(text, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrtu])', r"$1\\\\")


def diagram_id(label: Column) -> Column:
    """An identifier for a label: other characters become ``_``, a leading digit gets a prefix."""
    flat = F.regexp_replace(label, "[^0-9a-zA-Z_]", "_")
    return F.when(flat.rlike("^[0-9]"), F.concat(F.lit("pkg_"), flat)).otherwise(flat)
