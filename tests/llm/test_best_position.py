import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from arbora.llm import best_position, queries

from .conftest import SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expect(docs, items):
    """Every document scored for every item."""
    each = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_all = len(each), sum(sum(c.values()) for _, c in each)
    df = Counter(w for _, c in each for w in c)
    out = Counter()
    for item, text in items:
        query, scores = Counter(terms(text)), []
        for i, c in each:
            m = 75 + 25 * sum(c.values()) * n_docs // n_all
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, k in query.items() if w in c)
            if s > 0:
                scores.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:20], 1):
            out[item, rank, i, -s] += 1
    return out


def rows(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_query_against_all_scores(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert rows(queries.op12_best_position(spark, SMALL)) == expect(docs, items)


def test_cases(spark, make_docs, tmp_path, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "naïve", "a1", "中文"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", "...", "W1, w1; W1!", "x" * 200_000, "w2 " * 50_000] + ["w3 w4 w5"] * 60
    ids = [rng.randint(0, 400) for _ in texts]
    ids[5] = ids[300] = None
    monkeypatch.setattr(best_position, "PORTION", 200)  # many portions for each task
    monkeypatch.setattr(best_position, "BLOCK_ITEMS", 3)
    items = [(1, "w1 w2 w2 É"), (2, None), (3, ""), (4, "nowhere"), (None, "w3 w4"), (5, " ".join(vocabulary)), (5, "W7-w8_w9"), (6, "naïve 中文 a1 a1")]
    make_docs(texts, ids).withColumnsRenamed({"lang": "score", "source": "term"}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as doc_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(queries.op12_best_position(spark, str(tmp_path))) == expect(list(zip(ids, texts, strict=True)), items)
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert queries.op12_best_position(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("depth", [1, 4, 64])
def test_best_positions_stop_before_the_lists_end(depth):
    """One document of large impacts everywhere: the answer of a portion is exact, and the lists aren't read to their ends."""
    rng = np.random.default_rng(1)
    n, t = 4000, 12
    impact = rng.integers(1, 500, (n, t))
    impact[rng.choice(n, 30, replace=False)] += 10_000
    sizes = np.full(n, t)
    portion = best_position.Portion(t, list(range(n)), sizes, np.tile(np.arange(t), n), impact.reshape(-1))
    query, best = {k: k + 1 for k in range(t)}, []
    read = portion.search(query, best, depth)
    scores = impact @ (np.arange(t) + 1)
    want = sorted(zip((-scores).tolist(), range(n), strict=True))[:20]
    assert sorted((-s, i) for s, _, _, i in best) == want
    assert read < n * t / 10
