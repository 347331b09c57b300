import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import chat_hmm, queries

from .conftest import SMALL


@pytest.fixture(scope="module")
def turns(spark):
    t = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/conversations.parquet")
    return t.select(F.col("conv_id").alias("conv"), F.col("turn").alias("part"), "role", "text")


@pytest.fixture(scope="module")
def model(turns):
    return chat_hmm.train(chat_hmm.raw_parts(chat_hmm.learning(turns)))


def viterbi(model, lines):
    """Best score and states of whole transcripts."""
    f, _ = chat_hmm.features(lines)
    score, back = model.start + model.emit[:, f[0]], []
    for x in f[1:]:
        each = score[:, None] + model.move + model.emit[:, x]
        back.append(each.argmax(0))
        score = each.max(0)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return float(score.max()), path[::-1]


def path_score(model, lines, states):
    f, _ = chat_hmm.features(lines)
    s = model.start[states[0]] + model.emit[states[0], f[0]]
    return s + sum(model.move[a, b] + model.emit[b, x] for a, b, x in zip(states, states[1:], f[1:], strict=False))


def got_states(rows):
    out = []
    for r in sorted(rows, key=lambda r: (r.part, r.text)):
        out += [2 * chat_hmm.ROLES.index(x) + (not s) for x, s in zip(r.roles, r.starts, strict=True)]
    return out


def test_held_out_accuracy(spark, turns, model):
    held = turns.subtract(chat_hmm.learning(turns))
    raw = chat_hmm.raw_parts(held)
    told = chat_hmm.decode(raw, model).join(raw.select("conv", "part", "role"), ["conv", "part"]).collect()
    right = sum(r.roles[0] == r.role for r in told)
    assert len(told) > 50 and right / len(told) > 0.95
    starts = [(k == 0) == s for r in told for k, s in enumerate(r.starts)]
    assert sum(starts) / len(starts) > 0.95


@pytest.mark.parametrize("parts", [1, 2, 3, 64])
def test_blocks_give_a_best_path(spark, turns, model, monkeypatch, parts):
    monkeypatch.setattr(chat_hmm, "PARTS", max(parts, 2))
    raw = chat_hmm.raw_parts(turns.filter("conv < 12")).filter("text <> '\n'")
    by = {}
    for r in raw.collect():
        by.setdefault(r.conv, []).append((r.part, r.text))
    got = {}
    for r in chat_hmm.decode(raw.repartition(3), model).collect():
        got.setdefault(r.conv, []).append(r)
    assert set(got) == set(by)
    for c, rows in by.items():
        lines = [x for _, t in sorted(rows) for x in t.split("\n")]
        best, _ = viterbi(model, lines)
        assert path_score(model, lines, got_states(got[c])) == pytest.approx(best, abs=1e-6)


def test_query_renders_every_turn(spark, turns):
    rows = queries.op5_transcript_hmm(spark, SMALL.replace("0.001", "0.01")).collect()
    want = turns.count()
    assert len(rows) == want
    assert np.mean([r.right for r in rows]) > 0.95
    assert all(r.rendered.startswith(("<|", "\n", "")) for r in rows)


def test_cases(spark, model, tmp_path):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "b"), (1, None, "user", None), (2, 0, "user", ""), (2, 0, "user", ""), (2, 1, "other", "x\ny"), (2, 200, "assistant", "z " * 50_000), (2, 1, None, "w"), (3, 5, "user", "Hi?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("block", F.lit("x"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op5_transcript_hmm(spark, str(tmp_path)).count() == 8
    parts = df.select(F.col("conv_id").alias("conv"), F.col("turn").alias("part"), "text")
    assert chat_hmm.decode(parts, model).count() == 8
    assert chat_hmm.decode(parts.limit(0), model).count() == 0
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op5_transcript_hmm(spark, f"{tmp_path}/none").count() == 0


def test_negative_and_distant_parts(spark, model):
    rows = [(1, -1, "user: a?"), (1, 0, "assistant: b"), (2, -900, "user: a?"), (2, 70_000, "x"), (3, -130, "me: q"), (3, -2, "bot: r")]
    df = spark.createDataFrame(rows, "conv long, part long, text string")
    got = {(r.conv, r.part): r for r in chat_hmm.decode(df, model).collect()}
    assert set(got) == {r[:2] for r in rows}
    for c in (1, 2, 3):
        mine = sorted((p, t) for k, p, t in rows if k == c)
        best, _ = viterbi(model, [t for _, t in mine])
        assert path_score(model, [t for _, t in mine], got_states([got[c, p] for p, _ in mine])) == pytest.approx(best, abs=1e-6)


def test_blocks_leave_the_result_alone(spark, model, monkeypatch):
    """Parts that don't end in a blank line, some of them blank, in blocks of any size."""
    rng = np.random.default_rng(2)
    said = ["user: what now?", "and then", "bot: so be it", "", " \u2003", "me: x\n", "plain text that goes on for a while " * 3, "why?"]
    rows = [(c, int(p), str(rng.choice(said))) for c in range(12) for p in rng.choice(400, 200, replace=False)]
    df = spark.createDataFrame(rows, "conv long, part long, text string").repartition(3)
    best = {}
    for c in range(12):
        mine = sorted((p, t) for k, p, t in rows if k == c)
        best[c] = [x for _, t in mine for x in t.split("\n")]
    for parts in (2, 64, 100_000):
        monkeypatch.setattr(chat_hmm, "PARTS", parts)
        told = {}
        for r in chat_hmm.decode(df, model).collect():
            told.setdefault(r.conv, []).append(r)
        for c, lines in best.items():  # equally good paths may differ
            assert path_score(model, lines, got_states(told[c])) == pytest.approx(viterbi(model, lines)[0], abs=1e-6)
