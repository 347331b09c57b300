import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from arbora.llm import queries, substring_dedup

from .conftest import SMALL


def expect(rows, window=35):
    """Rows of the query from (doc_id, text) rows, by counting every window."""
    each = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in each for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in each:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_query_against_all_windows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = expect(rows)
    assert sum(n for _, _, n, _ in want) > 0
    assert got(queries.op7_substring_dedup(spark, SMALL)) == want


def made(seed):
    rng = random.Random(seed)
    word = lambda k: f"{rng.choice('abcdéß')}{rng.randrange(k)}"
    text = lambda n, k=5000: [word(k) for _ in range(n)]
    common, short = text(120), text(36)
    texts = [None, "", " \n", "a b c", " ".join(["la"] * 300), " ".join(["x", "y", "z"] * 40), " ".join(text(34)), " ".join(common)]
    for _ in range(30):
        a, b = sorted(rng.sample(range(121), 2))
        texts.append(" \t".join(text(rng.randrange(60)) + common[a:b] + text(rng.randrange(60))))
        texts.append("\n".join(text(rng.randrange(20)) + short[rng.randrange(3) :] + text(rng.randrange(20)) + short[: rng.randrange(33, 37)]))
    whole = " ".join(text(900))
    return [*texts, whole, whole, whole + " tail", " ".join(text(3, 2) * 60), " ".join(text(400, 2))]


def test_made_texts(spark, make_docs, monkeypatch):
    texts = made(3)
    docs = make_docs(texts)
    assert got(substring_dedup.strip(docs, digest=True)) == expect(list(enumerate(texts)))


def test_repeated_rows_null_ids_and_clashing_columns(spark, make_docs, tmp_path):
    texts = [" ".join(f"q{i}" for i in range(50)), None, "", " ".join(f"r{i}" for i in range(80)), "one"]
    docs = make_docs(texts, ids=[1, 2, None, None, 4])
    docs = docs.unionByName(docs.filter("doc_id = 1"))
    docs.withColumn("runs", F.lit(1)).withColumn("text_key", F.lit("x")).withColumn("p", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    want = expect([(1, texts[0]), (2, None), (None, ""), (None, texts[3]), (4, "one"), (1, texts[0])])
    assert got(queries.op7_substring_dedup(spark, str(tmp_path))) == want
    out = substring_dedup.strip(docs)
    assert out.columns == docs.columns
    assert Counter(r.text for r in out.collect()) == Counter([None, "", texts[3], "one", "", ""])
    assert substring_dedup.strip(docs.limit(0), digest=True).count() == 0


def test_small_portions_change_nothing(monkeypatch):
    import numpy as np
    import pyarrow as pa

    v = np.random.default_rng(1).integers(0, 1 << 40, 3000)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([1, 2], pa.int32()), pa.array([v.tolist(), v[:50].tolist()], pa.list_(pa.int64()))], ["doc_id", "text_key", "hashes"])
    count = lambda: sum(sum(b.column("n").to_pylist()) for b in substring_dedup._level(9, 35, False, False)([batch]))
    whole = count()
    monkeypatch.setattr(substring_dedup, "CHUNK", 100)
    assert count() == whole == 3000 - 34 + 50 - 34


def test_tasks_take_texts_and_hold_words_of_some_at_once(spark, make_docs, monkeypatch):
    import pyarrow as pa

    from arbora.llm.common import table

    texts = [" ".join(f"w{i}_{k % 90}" for k in range(400)) for i in range(200)] + [None, "", "  \n", " lead " * 40, "é\u00a0x " * 36, "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    whole = list(substring_dedup._portions([batch], 35))
    monkeypatch.setattr(substring_dedup, "PORTION", 10_000)
    parts = list(substring_dedup._portions([batch], 35))
    assert len(parts) > 50 and max(len(p.column("hashes").flatten()) for p in parts) < 10_000
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(whole).to_pylist()
    assert [len(x) for x in pa.Table.from_batches(whole).column("hashes").to_pylist()] == [400] * 200 + [40, 36]
    seen = []
    real = substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, label: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label))
    substring_dedup.repeated_windows(table(spark, SMALL, "documents"))
    assert not any("split(" in plan for plan in seen)  # no arrays of words in the executor's heap


def test_equal_ids_with_different_texts_of_one_short_hash(spark, make_docs):
    text = lambda k, n=40: " ".join(f"w{k}_{i}" for i in range(n))
    texts = [text(60599), text(60599), text(114291), text(8151), text(253507), "one " * 3 + text(8151, 38), text(18968), text(295572)]
    ids = [None, 1, None, 5, 5, 2, 6, 6]
    docs = make_docs(texts, ids)
    assert docs.select(F.hash("text")).distinct().count() == 4  # pairs of texts share 32 bits
    assert got(substring_dedup.strip(docs, digest=True)) == expect(list(zip(ids, texts, strict=True)))
    kept = Counter((r.doc_id, r.text) for r in substring_dedup.strip(docs).collect())
    assert kept[None, texts[2]] == kept[5, texts[4]] == 1


def test_a_task_on_much_text_takes_little_memory_and_few_tables_are_written(spark, make_docs, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from arbora.llm import common

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(600)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(range(1500)), pa.array(texts)], ["doc_id", "text_key", "text"])
    substring_dedup._powers.clear()
    tracemalloc.start()  # numpy tells it of its arrays
    n = sum(sum(b.column("n").to_pylist()) for b in substring_dedup._of_texts(substring_dedup._level(9, 35, False, True), 35)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1500 * (600 - 34) and peak < 30e6
    labels = []
    real = common.new_path
    monkeypatch.setattr(common, "new_path", lambda session, label: labels.append(label) or real(session, label))
    assert got(substring_dedup.strip(make_docs(made(5)), digest=True)) == expect(list(enumerate(made(5))))
    assert len(labels) == 11
