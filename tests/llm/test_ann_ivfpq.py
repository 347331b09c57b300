from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import ann_ivfpq, queries

from .conftest import SMALL


def exact(rows, every=20, k=20):
    """query -> [(vec_id, score)], over usable (vec_id, vector) rows."""
    rows = sorted({i: v for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}.items())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64).reshape(len(rows), -1)
    out = {}
    for n, (i, _) in enumerate(rows):
        if i % every == 0:
            s = (x * x[n]).sum(1)
            out[i] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def check(got, want, recall, vectors):
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    assert set(by) == {q for q, a in want.items() if a}
    hits = total = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        assert q not in {r.vec_id for r in rows} and len({r.vec_id for r in rows}) == len(rows)
        for r in rows:
            assert r.score == pytest.approx(np.dot(np.array(vectors[q], np.float64), np.array(vectors[r.vec_id], np.float64)), abs=1e-12)
        hits += len({r.vec_id for r in rows} & {i for i, _ in want[q]})
        total += len(want[q])
    assert hits / max(total, 1) >= recall, hits / total


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_of_query(spark, sf):
    folder = SMALL.replace("0.001", sf)
    vectors = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    check(queries.op6_ivf_pq(spark, folder).collect(), exact(vectors.items()), 0.92, vectors)


def test_copies_splits_and_bad_vectors(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ann_ivfpq, "BLOCK_ROWS", 150)
    monkeypatch.setattr(ann_ivfpq, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(2400)]
    rows += [(i, rows[0][1]) for i in range(3000, 3900)]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 8), (5060, [1.0] * 7 + [float("nan")]), (5080, [1.0] * 7 + [float("inf")]), (5100, [1.0] * 7 + [None]), (None, rows[1][1]), rows[0], (5120, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("x")).withColumn("score", F.lit(0)).repartition(5)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [(i, v) for i, v in rows if i != 5120]
    check(queries.op6_ivf_pq(spark, str(tmp_path)).collect(), exact(good), 0.95, dict(good))


def test_small_tables_have_cells_and_probe_some_of_them(spark):
    for sf in ("0.001", "0.01"):
        vectors = [r.embedding for r in spark.read.parquet(f"{SMALL.replace('0.001', sf)}/embeddings.parquet").collect()]
        model = ann_ivfpq.fit(np.unique(np.array(vectors, np.float32), axis=0), len(vectors))
        assert len(model.centres) > 20 and model.probes < len(model.centres)


def hard_rows(kind, n=3000):
    rng = np.random.default_rng(5)
    if kind == "wide":
        return rng.normal(size=(n, 384))
    x = rng.normal(size=(n, 32))
    if kind == "queries elsewhere":
        x[::20] = 0.1 * x[::20] + 3
    elif kind == "huge":
        x *= 1e22
    elif kind == "tiny":
        x *= 1e-25
    elif kind == "tight clusters":
        x = x[rng.integers(0, 200, n)] + 0.05 * rng.normal(size=(n, 32))
    elif kind == "scales":
        x *= 10.0 ** rng.uniform(-3, 3, (n, 1))
    elif kind == "ties":
        x = np.round(x[:, :8])
    elif kind == "doubles":
        x = 1 + 1e-9 * x
    return x


@pytest.mark.parametrize("kind", ["wide", "queries elsewhere", "huge", "tiny", "tight clusters", "scales", "ties", "doubles"])
def test_no_answer_is_lost_whatever_the_rows(spark, kind):
    x = hard_rows(kind)
    x = x if kind == "doubles" else x.astype(np.float32).astype(np.float64)
    element = "double" if kind == "doubles" else "float"
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"vec_id long, embedding array<{element}>").repartition(4)
    got = defaultdict(dict)
    for r in ann_ivfpq.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    for q, answers in exact(list(enumerate(x.tolist()))).items():
        assert sorted(got[q]) == list(range(1, 21))
        last, found = answers[-1][1], {i for i, _ in got[q].values()}
        slack = 1e-13 * np.linalg.norm(x[q]) * np.linalg.norm(x, axis=1).max()  # sums of other orders
        assert all(i in found for i, s in answers if s > last + slack or kind == "ties"), (q, len(found & {i for i, _ in answers}))
        for rank, (i, s) in enumerate(answers, 1):
            assert abs(got[q][rank][1] - s) <= slack


def test_rows_of_one_id(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)] + [(20, [9.0, 0.0, 0.0, 0.0]), (20, [0.0, 9.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann_ivfpq.search(df, F.col("vec_id") == 20).collect():
        got[r.query_key].append(r)
    assert len(got) == 3
    for answers in got.values():
        assert sorted(r.rank for r in answers) == list(range(1, 21)) and all(r.vec_id != 20 for r in answers)


def test_few_rows(spark):
    rows = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (40, [0.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann_ivfpq.search(df, F.col("vec_id") % 20 == 0)
    check(got.collect(), exact(rows), 1.0, dict(rows))
    assert ann_ivfpq.search(df.limit(0), F.lit(True)).count() == 0
    assert ann_ivfpq.search(df.limit(1), F.lit(True)).count() == 0
