"""Conversation structure repair by depth-first branch-and-bound.

A conversation's turns are to have role initials ``(s?(ua)+)?``. Each turn is
kept (K, cost 0), given the role user or assistant (R, 1) or deleted (D, 2);
empty turns may be inserted anywhere (I, 5). Blank turns and repeats are deleted
in any case, and a truncated turn that isn't deleted costs 5 more. The cheapest
edits are wanted, and of these the audit (their letters in order) that is least.

``search`` walks prefixes of edits depth first from an explicit stack. A suffix
bound, the least cost of the turns that are left if they are judged in pairs and
alone, cuts prefixes that can't beat the incumbent (cost, audit); a table for each
node, a turn and the state of the roles, cuts those that a better prefix reached.
It ends when no prefix is left, which proves the incumbent.

Conversations are sorted in ranges, and those that lie within one range and have
up to BLOCK turns are searched whole. Longer ones, and those at a range's ends,
are searched in blocks, from each state of the roles to each. Equally cheap audits
of a block are never prefixes of each other, so that blocks can be joined by
(cost, audit): one pass over the blocks of a conversation carries the best way to
each state, settles what all of them share, and each block is then repaired from
the state that it was entered in. A task never holds a conversation's texts.

Defined results: rows of one turn go by role, then text; equal rows count one by
one but travel as one row with their number; an empty role is one space, which
is legal nowhere; nulls of roles and texts are one space, a null turn goes first,
null conversations are one; an empty table gives no rows; other columns are
ignored. A conversation without turns has cost 0 and no edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns (equal rows are one) of a block.
BLOCK = 32
#: States of the roles: nothing yet, a system turn, a user's turn last, an assistant's turn last.
START, SYSTEM, USER, REPLY = range(4)
NEXT = ((("s", SYSTEM), ("u", USER)), (("u", USER),), (("a", REPLY),), (("u", USER),))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
FAULTS = ("blank", "duplicate", "truncated")

#: A turn as the search sees it: how many must be deleted, whether one is free, its role's initial, whether it is truncated.
Turn = tuple[int, bool, str, bool]


def _moves(turn: Turn, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a turn: (letters, cost, next state), cheapest first, then by letters."""
    forced, free, initial, truncated = turn
    gone, cost = "D" * forced, DELETE * forced
    if not free:
        return [(gone, cost, state)]
    out = [(gone + "D", cost + DELETE, state)]
    for c, to in NEXT[state]:
        if c == initial:
            out.append(("K" + gone, cost + TRUNCATED * truncated, to))
        if c in ROLES:
            out.append(("R" + gone, cost + REROLE + TRUNCATED * truncated, to))
    return sorted(out, key=lambda x: (x[1], x[0]))


@lru_cache(1 << 14)
def _least(turns: tuple[Turn, ...]) -> int:
    """Least cost of one or two neighbouring turns, whatever stands around them."""
    reach = dict.fromkeys(range(4), 0)
    for t in turns:
        then: dict[int, int] = {}
        for state, cost in _with_inserts(reach).items():
            for _, more, to in _moves(t, state):
                then[to] = min(then.get(to, cost + more), cost + more)
        reach = then
    return min(reach.values())


def _with_inserts(reach: dict[int, int]) -> dict[int, int]:
    out = dict(reach)
    for _ in range(2):
        for state, cost in list(out.items()):
            for c, to in NEXT[state]:
                if c in ROLES:
                    out[to] = min(out.get(to, cost + INSERT), cost + INSERT)
    return out


def bounds(turns: list[Turn]) -> list[int]:
    """For each turn, a lower bound of the cost of it and all after it."""
    out = [0] * (len(turns) + 2)
    for i in range(len(turns) - 1, -1, -1):
        out[i] = max(_least((turns[i],)) + out[i + 1], _least((turns[i], turns[i + 1])) + out[i + 2] if i + 1 < len(turns) else 0)
    return out[:-1]


def search(turns: list[Turn], state: int = START, ends: tuple[int, ...] = (START, REPLY)) -> tuple[int, str, int] | None:
    """The cheapest (cost, audit, prefixes looked at) from a state to one of the ends; None if there is no way."""
    left, n = bounds(turns), len(turns)
    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack, looked = [(0, "", 0, state)], 0
    while stack:
        cost, audit, i, state = stack.pop()
        looked += 1
        if best and (cost + left[i], audit) > (best[0], best[1][: len(audit)]):
            continue
        held = table.get((i, state))
        if held and held <= (cost, audit):
            continue
        table[i, state] = (cost, audit)
        if i == n and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        found = [] if i == n else [(cost + more, audit + letters, i + 1, to) for letters, more, to in _moves(turns[i], state)]
        found += [(cost + INSERT, audit + "I", i, to) for c, to in NEXT[state] if c in ROLES]
        found.sort(key=lambda x: (x[0] + left[x[2]], x[1]), reverse=True)  # the most promising is on top
        stack += [x for x in found if not best or x[0] + left[x[2]] <= best[0]]
    return best and (*best, looked)


def replay(turns: list[tuple[int, bool, str, str, bool]], audit: str, state: int) -> list[str]:
    """The repaired turns ``role:text`` of (forced, free, role, text, truncated) after an audit."""
    out, k = [], 0

    def said(role: str, text: str, to: int) -> int:
        out.append(f"{role}:{text}")
        return to

    for forced, free, role, text, _ in [*turns, (0, False, "", "", False)]:
        while audit[k : k + 1] == "I":
            c, state = NEXT[state][-1]
            said(ROLES[c], "", state)
            k += 1
        if free:
            # of equal rows the first may stay, so its letter comes before those of its repeats; if all go, the letters are alike
            if audit[k] == "K":
                state = said(role, text, dict(NEXT[state])[role[0]])
            elif audit[k] == "R":
                c, state = NEXT[state][-1]
                said(ROLES[c], text, state)
        k += forced + free
    return out


# --- pieces of conversations ------------------------------------------------

WAYS = [(a, b) for a in range(4) for b in range(4)]
STATS = "blank long, duplicate long, truncated long, illegal long, n_turns long"
ENDS = "low long, high long, first_initial string, last_initial string"
PIECE = f"conv_id long, seq long, whole boolean, {STATS}, {ENDS}, cost long, audit string, repaired_sha256 string, costs array<long>, audits array<string>, forced array<long>, free array<boolean>, roles array<string>, texts array<string>, cut array<boolean>"
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def _arrow(schema: str) -> pa.Schema:
    kind = lambda k: pa.list_(ARROW[k[6:-1]]) if k.startswith("array") else ARROW[k]
    return pa.schema([(n, kind(k)) for n, k in (x.split() for x in schema.split(", "))])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _stats(rows: list[dict]) -> dict:
    """Counts of a piece's turns, and what its neighbours need to know of its ends."""
    out = dict.fromkeys((*FAULTS, "illegal", "n_turns"), 0)
    before, turn = None, object()
    for r in rows:
        initial, n = r["role"][:1], r["n"]
        own = {"blank": n if r["blank"] else 0, "duplicate": 0 if r["blank"] else n - r["fresh"], "truncated": r["fresh"] if r["cut"] and not r["blank"] else 0}
        for k, v in own.items():
            out[k] += v
        out["illegal"] += (n - 1) + (before is not None and before + initial not in LEGAL)
        out["n_turns"] += r["turn"] is not None and r["turn"] != turn
        before, turn = initial, r["turn"]
    known = [r["turn"] for r in rows if r["turn"] is not None]
    return out | {"low": known[0] if known else None, "high": known[-1] if known else None, "first_initial": rows[0]["role"][:1], "last_initial": before}


def _turns(rows: list[dict]) -> list[tuple[int, bool, str, str, bool]]:
    return [(r["n"] - (free := r["fresh"] and not r["blank"]), bool(free), r["role"], r["text"], r["cut"]) for r in rows]


def _seen(turns: list[tuple[int, bool, str, str, bool]]) -> list[Turn]:
    return [(n, free, role[:1], cut) for n, free, role, _, cut in turns]


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, seq, out = _arrow(PIECE), TaskContext.get().partitionId() << 32, []

    def piece(rows: list[dict], whole: bool) -> dict:
        nonlocal seq
        seq += 1
        turns = _turns(rows)
        row = {"conv_id": rows[0]["conv_id"], "seq": seq, "whole": whole} | _stats(rows)
        if whole:
            cost, audit, _ = search(_seen(turns))
            return row | {"cost": cost, "audit": audit, "repaired_sha256": _digest(replay(turns, audit, START))}
        ways = [search(_seen(turns), a, (b,)) for a, b in WAYS]
        row |= {"costs": [w and w[0] for w in ways], "audits": [w and w[1] for w in ways]}
        return row | dict(zip(("forced", "free", "roles", "texts", "cut"), map(list, zip(*turns, strict=True)), strict=True))

    held: list[dict] = []
    within = long = False  # whether the conversation's start was seen, and whether it has gone beyond a block
    begun = False
    for b in batches:
        for r in b.to_pylist():
            if held and r["conv_id"] != held[0]["conv_id"]:
                out.append(piece(held, within and not long))
                held, within, long = [], True, False
            elif len(held) == BLOCK:
                out.append(piece(held, False))
                held, long = [], True
            begun = True
            held.append(r)
            if len(out) >= 1024:
                yield _batch(out, schema)
                out = []
    if begun:
        yield _batch([*out, piece(held, False)], schema)


class _Way:
    """The best way to a state so far: its cost, and a chain of the pieces not yet settled."""

    __slots__ = ("back", "cost", "step")

    def __init__(self, cost: int, back: _Way | None, step: tuple | None) -> None:
        self.cost, self.back, self.step = cost, back, step

    def chain(self) -> list[_Way]:
        out, w = [], self
        while w is not None and w.step is not None:
            out.append(w)
            w = w.back
        return out[::-1]


def _compare(a: str, b: str) -> int | str:
    """-1 or 1 by the first difference; else what the longer one has beyond the other, signed by which it is."""
    if a == b:
        return ""
    if b.startswith(a):
        return "<" + b[len(a) :]
    if a.startswith(b):
        return ">" + a[len(b) :]
    return -1 if a < b else 1


def _after(rel: int | str, a: str, b: str) -> int | str:
    """How two audits compare once each goes on."""
    if isinstance(rel, int):
        return rel
    return _compare(a, rel[1:] + b) if rel[:1] == "<" else _compare(rel[1:] + a, b)


WALKED = "conv_id long, seq long, entry long, audit string, add long"


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece of sorted conversations: the state in which the best way enters it, its edits, and their cost."""
    schema, out = _arrow(WALKED), []
    conv: object = object()
    ways: dict[int, _Way] = {}
    rel: dict[tuple[int, int], int | str] = {}
    since = length = 0

    def emit(steps: Iterable[_Way]) -> None:
        out.extend(dict(zip(("seq", "entry", "audit", "add"), w.step, strict=True)) | {"conv_id": conv} for w in steps)

    def settle() -> None:
        """Hands on the pieces on which all ways agree."""
        nonlocal length
        chains = {s: w.chain() for s, w in ways.items()}
        shared = 0
        for each in zip(*chains.values()):  # noqa: B905
            if any(w is not each[0] for w in each):
                break
            shared += 1
        if shared:
            first = next(iter(chains.values()))
            emit(first[:shared])
            first[shared - 1].step = None
            first[shared - 1].back = None
        length = max(len(c) for c in chains.values()) - shared

    def close() -> None:
        done = [s for s in (START, REPLY) if s in ways]
        if done:
            best = done[0]
            for s in done[1:]:
                less = ways[s].cost - ways[best].cost
                if less < 0 or (less == 0 and _first(rel[best, s]) > 0):
                    best = s
            emit(ways[best].chain())

    for b in batches:
        for r in b.to_pylist():
            if r["conv_id"] != conv:
                close()
                conv, ways, rel, since, length = r["conv_id"], {START: _Way(0, None, None)}, {(START, START): ""}, 0, 0
            then, picked = {}, {}
            for (a, z), cost, audit in zip(WAYS, r["costs"], r["audits"], strict=True):
                if a not in ways or cost is None:
                    continue
                total = ways[a].cost + cost
                if z in picked:
                    old, text = picked[z]
                    less = total - then[z].cost
                    if less > 0 or (less == 0 and _first(_after(rel[old, a], text, audit)) <= 0):
                        continue
                picked[z] = (a, audit)
                then[z] = _Way(total, ways[a], (r["seq"], a, audit, cost))
            rel = {(x, y): _after(rel[picked[x][0], picked[y][0]], picked[x][1], picked[y][1]) for x in picked for y in picked}
            ways, since = then, since + 1
            if since > max(64, length):
                settle()
                since = 0
            if len(out) >= 1024:
                yield _batch(out, schema)
                out.clear()
    close()
    if out:
        yield _batch(out, schema)


def _first(rel: int | str) -> int:
    """Which of two whole audits is less: -1, 0 or 1."""
    return rel if isinstance(rel, int) else {"": 0, "<": -1, ">": 1}[rel[:1]]


REPAIRED = f"conv_id long, seq long, {STATS}, {ENDS}, add long, audit string, body string"
SEALED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(REPAIRED)
    for b in batches:
        out = []
        for r in b.to_pylist():
            turns = list(zip(r["forced"], r["free"], r["roles"], r["texts"], r["cut"], strict=True))
            lines = replay(turns, r["edits"], r["entry"])
            out.append(r | {"audit": r["edits"], "body": "\n".join(lines) if lines else None})
        yield _batch(out, schema)


def _gaps(low: int | None, high: int | None, n: int) -> int:
    return 0 if low is None else high - low + 1 - n


def _seal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each of the sorted conversations; texts pass through a running hash."""
    schema, conv, out, now, digest, edits = _arrow(SEALED), object(), [], None, None, []

    def close() -> None:
        if now:
            out.append(now | {"gaps": _gaps(now["low"], now["high"], now["n_turns"]), "audit": "".join(edits), "repaired_sha256": digest.hexdigest()})

    for b in batches:
        for r in b.to_pylist():
            if now is None or r["conv_id"] != conv:
                close()
                conv, digest, edits, any_line = r["conv_id"], hashlib.sha256(), [], False
                now = r | {"cost": 0, "illegal": r["illegal"]}
            else:
                for k in (*FAULTS, "illegal", "n_turns"):
                    now[k] += r[k]
                now["illegal"] += now["last_initial"] + r["first_initial"] not in LEGAL
                now["n_turns"] -= r["low"] is not None and r["low"] == now["high"]
                now["low"] = r["low"] if now["low"] is None else now["low"]
                now["high"] = now["high"] if r["high"] is None else r["high"]
                now["last_initial"] = r["last_initial"]
            now["cost"] += r["add"]
            edits.append(r["audit"])
            if r["body"] is not None:
                digest.update((b"\n" if any_line else b"") + r["body"].encode())
                any_line = True
    close()
    if out:
        yield _batch(out, schema)


def damage(turns: DataFrame) -> DataFrame:
    """Given conversations (conv_id, turn, role, text) with faults: by a checksum of its key a turn goes (no copies), loses its text or its stops, is said twice (two copies), or becomes the user's."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def repair(turns: DataFrame, copies: Column | int = 1) -> DataFrame:
    """The cheapest repair of each conversation of turns (conv_id, turn, role, text): its faults, cost, audit and the hash of its repaired turns. ``copies``: how often each row stands there; without any, a conversation's id alone counts."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(" "))
    role = F.when(plain("role") == "", " ").otherwise(plain("role"))
    valid = lambda c: F.call_function("make_valid_utf8", c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), valid(role).alias("role"), valid(plain("text")).alias("text"), (copies if isinstance(copies, Column) else F.lit(copies)).cast("long").alias("n"))
    rows = rows.filter("n > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("said", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    first = rows.groupBy("conv_id", "said").agg(F.bool_or(F.isnull("turn")).alias("untimed"), F.min("turn").alias("least")).withColumnsRenamed({"conv_id": "c", "said": "s"})
    fresh = F.when(F.col("untimed"), F.isnull("turn")).otherwise(F.col("turn") == F.col("least"))
    end = F.rtrim("text", F.lit(BLANKS))
    marked = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s"))).select(
        "conv_id", "turn", "role", "text", "n", fresh.cast("long").alias("fresh"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    pieces = materialize(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, PIECE), "pieces")
    gaps = F.when(F.isnull("low"), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("n_turns"))
    whole = pieces.filter("whole").select("conv_id", gaps.alias("gaps"), *FAULTS, "illegal", "cost", "audit", "repaired_sha256")
    parts = pieces.filter("not whole")
    ways = parts.select("conv_id", "seq", "costs", "audits").repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_walk, WALKED)
    each = parts.drop("audit", "cost").join(ways.select("seq", "entry", F.col("audit").alias("edits"), "add"), "seq").mapInArrow(_repair, REPAIRED)
    sealed = each.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_seal, SEALED)
    found = whole.unionByName(sealed).withColumnRenamed("conv_id", "c")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = {c: 0 for c in ("gaps", *FAULTS, "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    both = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return both.select("conv_id", *[F.coalesce(c, F.lit(v).cast("long" if v == 0 else "string")).alias(c) for c, v in nothing.items()])
