"""Chat formatting: roles of a raw transcript by a hidden Markov model.

A transcript comes in parts (numbered texts of one or more lines). The model has
six states, each role at a turn's first line and inside it. Its transitions and
emissions are smoothed counts of labelled turns: a line emits its speaker marker,
if any, its length class, whether it asks, and whether it follows a blank line.
Viterbi's best path gives each line its role; lines are then rendered so that
their concatenation is the canonical transcript, without markers.

A conversation of any length is decoded in blocks of PARTS parts. A block is
summed up by the best score from each state before it to each of its last
states; up to PARTS blocks combine to a block of the next level, until one is
left, whose best path then fixes the states at its blocks' ends, downwards. No
task sees more than PARTS part numbers or sums.

Defined results: a row without a conversation or part number is a conversation
of its own; rows with equal conversation, part and text are one; different texts
of one part follow each other in the order of their text; a null text is empty;
an empty text is one blank line; a conversation's first line counts as following a
blank one; part numbers may be negative or lie far apart; of equally good paths
one is taken, which may depend on the blocks; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROLES = ("system", "user", "assistant")
#: Fixed words that mark a speaker, by role.
MARKERS = (("system", "instructions", "context"), ("user", "human", "q", "customer", "me"), ("assistant", "ai", "a", "bot", "model", "agent"))
MARKER = re.compile(r"\s*[\[*#>-]*\s*(?:" + "|".join(f"({'|'.join(m)})" for m in MARKERS) + r")\s*[\]*]*\s*:\s?", re.I)
STATES = 2 * len(ROLES)  # role r: 2 r at a turn's first line, 2 r + 1 inside
FEATURES = 4 * 5 * 2 * 2
PARTS = 64


def split_line(line: str) -> tuple[int, str]:
    """The marker's role number, or 3, and the line without its marker."""
    m = MARKER.match(line)
    if not m:
        return 3, line
    return next(k for k in range(3) if m[k + 1]), line[m.end() :]


#: What Python's strip() takes for blank.
BLANK_LINE = r"^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\z"


def features(lines: list[str], after_blank: int = 1) -> tuple[np.ndarray, list[str]]:
    """The feature number of each line, and the lines without markers; ``after_blank``: whether the line before them is blank."""
    out, bare = np.zeros(len(lines), np.int64), []
    for i, line in enumerate(lines):
        marker, rest = split_line(line)
        size = 0 if not line.strip() else 1 + min(3, len(rest) // 60)
        out[i] = ((marker * 5 + size) * 2 + rest.rstrip().endswith("?")) * 2 + after_blank
        bare.append(rest)
        after_blank = int(size == 0)
    return out, bare


@dataclass
class Model:
    start: np.ndarray  # log chances of the first line's state
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # state, feature


def train(turns: DataFrame) -> Model:
    """From labelled turns (conv, part, role, text): a text's first line begins a turn, its others are inside. Only counts reach the driver."""
    known = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    t = turns.withColumn("r", known).filter("r >= 0 and conv is not null and part is not null").select("conv", "part", "r", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("n", F.size(F.split("text", "\n")))
    first, inside = F.col("r") * 2, F.col("r") * 2 + 1
    steps = t.groupBy("r").agg(F.count_if(F.col("n") > 1).alias("in"), F.sum(F.greatest(F.lit(0), F.col("n") - 2)).alias("on"))
    ends = t.select("conv", (F.col("part") + 1).alias("part"), F.when(F.col("n") > 1, inside).otherwise(first).alias("a"))
    nexts = t.select("conv", "part", first.alias("b"))
    follow = nexts.join(ends, ["conv", "part"], "left").groupBy("a", "b").count()

    def emitted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n = np.zeros((STATES, FEATURES), np.int64)
            for r, text in zip(rows["r"], rows["text"], strict=True):
                f, _ = features(text.split("\n"))
                n[2 * r, f[0]] += 1
                np.add.at(n[2 * r + 1], f[1:], 1)
            s, f = np.nonzero(n)
            yield pd.DataFrame({"s": s, "f": f, "n": n[s, f]})

    emits = t.select("r", "text").mapInPandas(emitted, "s long, f long, n long").groupBy("s", "f").agg(F.sum("n").alias("n"))
    start, move, emit = np.ones(STATES) * 1e-3, np.ones((STATES, STATES)) * 0.1, np.ones((STATES, FEATURES)) * 0.1
    start[::2] = move[:, 1::2] = 0.1
    for x in range(STATES):  # a turn goes on in its own role only
        move[x, [y for y in range(1, STATES, 2) if y // 2 != x // 2]] = 1e-6
    for x in steps.collect():
        move[2 * x["r"], 2 * x["r"] + 1] += x["in"]
        move[2 * x["r"] + 1, 2 * x["r"] + 1] += x["on"]
    for x in follow.collect():
        if x["a"] is None:
            start[x["b"]] += x["count"]
        else:
            move[x["a"], x["b"]] += x["count"]
    for x in emits.collect():
        emit[x["s"], x["f"]] += x["n"]
    log = lambda m: np.log(m / m.sum(-1, keepdims=True))
    return Model(log(start), log(move), log(emit))


def _step(model: Model, f: int, first: bool) -> np.ndarray:
    """Scores from the state before a line to the state at it; before the first line every state means the start."""
    return (np.broadcast_to(model.start, (STATES, STATES)) if first else model.move) + model.emit[:, f]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(1)


def best_path(steps: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """Best states after each step, from ``entry``, to ``leave`` if that is fixed."""
    score, back = steps[0][entry], []
    for m in steps[1:]:
        each = score[:, None] + m
        back.append(each.argmax(0))
        score = each.max(0)
    path = [int(score.argmax()) if leave is None else leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _lines(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """The lines of a block's parts in order, and the row of each."""
    texts = [t.split("\n") for t in rows["text"]]
    return [x for t in texts for x in t], np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def decode(parts: DataFrame, model: Model) -> DataFrame:
    """(conv, part, roles, starts, rendered) of parts (conv, part, text): for each line its role and whether it begins a turn."""
    shared = parts.sparkSession.sparkContext.broadcast(model)
    lost = F.col("conv").isNull() | F.col("part").isNull()
    rows = parts.select(F.col("conv").cast("long").alias("conv"), F.col("part").cast("long").alias("part"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("key", F.when(lost, F.concat_ws("/", F.lit("row"), "conv", "part", F.sha2("text", 256))).otherwise(F.concat_ws("/", F.lit("conv"), "conv")))
    rows = rows.withColumn("at", F.when(lost, F.lit(0)).otherwise(F.col("part")))
    # blocks are numbered from a conversation's first part, so that every series of levels ends in block 0
    reach = materialize(rows.groupBy("key").agg(F.min("at").alias("_low"), F.max("at").alias("_high")), "conversations")
    block = lambda x: F.floor((F.col(x) - F.col("_low")) / PARTS)
    rows = rows.join(reach, "key").withColumns({"block": block("at"), "first": F.lit(0).cast("long"), "last": block("_high")}).drop("_low", "_high")
    # a block's first line follows the last one of the block before it
    ends = rows.filter("first < last").groupBy("key", "block").agg(F.max_by(F.substring_index("text", "\n", -1), F.struct("at", "text")).alias("_end"))
    before = ends.select("key", "block", F.lag(F.rlike("_end", F.lit(BLANK_LINE))).over(Window.partitionBy("key").orderBy("block")).cast("int").alias("after"))
    rows = materialize(rows.join(before, ["key", "block"], "left").withColumn("after", F.coalesce("after", F.lit(1))), "transcripts")
    # only conversations of several blocks need sums; the others' one block is decoded as it is
    several = rows.filter("first < last")
    levels: list[DataFrame] = []
    if not several.isEmpty():

        def sum_up(part: pd.DataFrame) -> pd.DataFrame:
            m, part = shared.value, part.sort_values(["at", "text"])
            f, _ = features(_lines(part)[0], int(part["after"].iloc[0]))
            total = None
            for i, x in enumerate(f):
                one = _step(m, x, i == 0 and part["block"].iloc[0] == part["first"].iloc[0])
                total = one if total is None else _times(total, one)
            return pd.DataFrame({"key": [part["key"].iloc[0]], "block": [part["block"].iloc[0]], "score": [total.ravel()]})

        schema = "key string, block long, score array<double>"
        level = materialize(several.groupBy("key", "block").applyInPandas(sum_up, schema), "hmm-sums")

        def combine(part: pd.DataFrame) -> pd.DataFrame:
            total = None
            for s in part.sort_values("block")["score"]:
                one = np.array(s).reshape(STATES, STATES)
                total = one if total is None else _times(total, one)
            return pd.DataFrame({"key": [part["key"].iloc[0]], "block": [part["up"].iloc[0]], "score": [total.ravel()]})

        while True:
            levels.append(level)
            low, high = level.agg(F.min("block"), F.max("block")).first()
            if low == high:
                break
            level = materialize(level.withColumn("up", F.floor(F.col("block") / PARTS)).groupBy("key", "up").applyInPandas(combine, schema), "hmm-sums")
    fixed = None
    for level in reversed(levels[:-1]):

        def ends(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("block")
            entry, leave = part["entry"].iloc[0], part["leave"].iloc[0]
            path = best_path([np.array(s).reshape(STATES, STATES) for s in part["score"]], int(entry), None if leave < 0 else int(leave))
            return pd.DataFrame({"key": part["key"], "block": part["block"], "entry": [int(entry), *path[:-1]], "leave": path})

        given = level.withColumn("up", F.floor(F.col("block") / PARTS))
        if fixed is None:
            given = given.withColumns({"entry": F.lit(0), "leave": F.lit(-1)})
        else:
            given = given.join(fixed.withColumnRenamed("block", "up"), ["key", "up"])
        fixed = materialize(given.groupBy("key", "up").applyInPandas(ends, "key string, block long, entry int, leave int"), "hmm-ends")

    def states(part: pd.DataFrame) -> pd.DataFrame:
        m, part = shared.value, part.sort_values(["at", "text"])
        lines, row = _lines(part)
        f, bare = features(lines, int(part["after"].iloc[0]))
        first = bool(part["is_first"].iloc[0])
        leave = int(part["leave"].iloc[0])
        path = best_path([_step(m, x, first and i == 0) for i, x in enumerate(f)], int(part["entry"].iloc[0]), None if leave < 0 else leave)
        out: list[tuple[list, list, list]] = [([], [], []) for _ in range(len(part))]
        for i, s in enumerate(path):
            roles, begins, shown = out[row[i]]
            opens = s % 2 == 0
            roles.append(ROLES[s // 2])
            begins.append(opens)
            shown.append((("" if first and i == 0 else "<|end|>\n") + f"<|{ROLES[s // 2]}|>\n" if opens else "") + bare[i])
        roles, begins, shown = zip(*out, strict=True)
        return pd.DataFrame({"conv": part["conv"].astype("Int64"), "part": part["part"].astype("Int64"), "text": part["text"], "roles": roles, "starts": begins, "rendered": ["\n".join(x) for x in shown]})

    given = rows.filter("first = last").withColumns({"entry": F.lit(0), "leave": F.lit(-1)})
    if fixed is not None:
        given = given.unionByName(several.join(fixed, ["key", "block"]))
    given = given.withColumn("is_first", F.col("block") == F.col("first")).drop("first", "last")
    return given.groupBy("key", "block").applyInPandas(states, "conv long, part long, text string, roles array<string>, starts array<boolean>, rendered string")


#: Fixed spellings of speaker markers in raw transcripts, by style, for system, user and assistant.
STYLES = (("System: ", "User: ", "Assistant: "), ("[system]: ", "Human: ", "AI: "), ("Context: ", "Q: ", "A: "), ("**System**: ", "**Customer**: ", "**Agent**: "))


def raw_parts(turns: DataFrame) -> DataFrame:
    """(conv, part, role, text): turns as a raw transcript has them. The conversation sets the markers' style, about every fourth turn has none, and a blank line ends each."""
    pick = F.pmod(F.xxhash64("conv"), F.lit(len(STYLES)))
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    table = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    marker = F.when((role > 0) & (F.pmod(F.xxhash64("conv", "part"), F.lit(4)) != 0), F.get(F.get(table, pick.cast("int")), (role - 1).cast("int"))).otherwise("")
    return turns.select("conv", "part", "role", F.concat(marker, F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))


def learning(turns: DataFrame) -> DataFrame:
    """The conversations to learn from; every fifth, by hash, is held out."""
    return turns.filter(F.pmod(F.xxhash64("conv"), F.lit(5)) != 0)
