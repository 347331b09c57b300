import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from arbora.llm import queries, turn_repair

from .conftest import SMALL

STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
BLANKS = " \t\n\v\f\r"


def cheapest(rows):
    """Least (cost, audit, lines) of rows (role, text, fault), by the best way to each state after each row."""
    says = {"u": "user:", "a": "assistant:"}

    def offer(into, state, entry):
        if state not in into or entry[:2] < into[state][:2]:
            into[state] = entry
            return True
        return False

    def inserted(ways):
        todo = list(ways)
        while todo:
            s = todo.pop()
            cost, audit, lines = ways[s]
            todo += [t for c, t in STEP[s].items() if c in says and offer(ways, t, (cost + 5, audit + "I", (*lines, says[c])))]
        return ways

    ways = inserted({0: (0, "", ())})
    for role, text, fault in rows:
        then, more = {}, 5 * (fault == "truncated")
        for s, (cost, audit, lines) in ways.items():
            offer(then, s, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            for c, t in STEP[s].items():
                if role[:1] == c:
                    offer(then, t, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                if c in says:
                    offer(then, t, (cost + 1 + more, audit + "R", (*lines, says[c] + text)))
        ways = inserted(then)
    return min(ways[s] for s in (0, 3) if s in ways)


def expect(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role or " ", " " if text is None else text))
    out = Counter()
    for conv, each in groups.items():
        after = []
        for turn, role, text in sorted(each, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(k, text)
            after += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in after:
            end = text.rstrip(BLANKS)
            judged.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None))
            seen.add((role, text))
        turns = [t for t, _, _ in after if t is not None]
        faults = Counter(f for *_, f in judged)
        illegal = sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))  # noqa: B905
        cost, audit, lines = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect())


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_query_against_best_ways(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = got(queries.op11_turn_repair(spark, folder))
    assert found == expect(rows)
    assert sum(x[6] for x in found) > 0


def test_cases(spark, tmp_path):
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = ["Yes.", "No!", "cut", "", " \n", None, "What?  ", "x" * 100_000 + ".", "é."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    rows += [(100, t, rng.choice(roles), f"{rng.random()}{rng.choice('.!x')}") for t in range(700)]  # several blocks, several ranges
    rows += [(101, 5, "user", "again.")] * 300 + [(101, 6, "assistant", "Yes.")]
    rows += [(102, t, "user", "  ") for t in range(200)] + [(102, 300, "user", "Hi."), (102, 301, "assistant", "Yes.")]
    rows += [(103, 5, rng.choice("uas"), f"{k}.") for k in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df.selectExpr("*", "1 as n", "'x' as audit").write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(queries.op11_turn_repair(spark, str(tmp_path))) == expect(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op11_turn_repair(spark, f"{tmp_path}/none").count() == 0


def judged(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool"]), f"{k}", rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 3, 8, 32])
def test_search_is_optimal(n):
    rng = random.Random(n)
    for _ in range(150):
        rows = judged(rng, n)
        turns = [(int(f in ("blank", "duplicate")), f not in ("blank", "duplicate"), r[:1], f == "truncated") for r, _, f in rows]
        cost, audit, looked = turn_repair.search(turns)
        want = cheapest(rows)
        assert (cost, audit) == want[:2]
        lines = turn_repair.replay([(t[0], t[1], r[0], r[1], t[3]) for t, r in zip(turns, rows, strict=True)], audit, turn_repair.START)
        assert tuple(lines) == want[2]
        assert turn_repair.bounds(turns)[0] <= cost
        assert looked < 400 * (n + 1)
