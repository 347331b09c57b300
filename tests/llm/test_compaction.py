from collections import Counter

import pytest
from pyspark.sql import functions as F

from arbora.llm import compaction, queries

from .conftest import SMALL


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_query_keeps_every_row_in_full_shards(spark, monkeypatch):
    monkeypatch.setattr(queries, "SHARD_BYTES", 100_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = rows_of(docs.select("doc_id", F.xxhash64("doc_id", "text", "lang", "source", "n_chars")))
    got = queries.op3_compaction(spark, SMALL)
    assert rows_of(got.select("doc_id", "row_key")) == want
    assert got.select("version").distinct().count() == 1


def test_versions_merges_and_conflicts(spark, tmp_path):
    store = compaction.Store(spark, f"file://{tmp_path}/data/store")
    whole = Counter()
    for k in range(6):
        arrival = spark.range(k * 100, k * 100 + 100).selectExpr("id", "if(id % 7 = 0, null, concat('t', id % 5)) as text", f"{k} as run").repartition(3)
        whole += rows_of(arrival)
        assert store.append(arrival) == k + 1
    before = store.manifest()
    assert before.count() == 18 and before.agg(F.sum("rows")).first()[0] == 600
    third = rows_of(store.read(3))
    size = before.agg(F.sum("bytes")).first()[0]
    last = store.compact(target=size // 3)
    assert last > 6
    assert rows_of(store.read()) == whole and rows_of(store.read(3)) == third
    assert store.plan(target=size // 3).count() == 0
    assert store.manifest().count() < 9
    assert store.manifest().agg(F.sum("rows")).first()[0] == 600
    assert store.manifest().agg(F.max("bytes")).first()[0] <= 2 * (size // 3)
    other = compaction.Store(spark, store.path)
    with pytest.raises(compaction.Conflict):
        other._commit(last, before, other.schema())
    assert store.vacuum() >= 18
    assert rows_of(store.read()) == whole


def test_arrivals_of_other_columns(spark, tmp_path):
    store = compaction.Store(spark, f"file://{tmp_path}/store")
    store.append(spark.range(5).selectExpr("id", "'a' as lang"))
    for _ in range(4):
        store.append(spark.range(5).selectExpr("id", "2 as _metadata", "'x' as `odd name`"))
    with pytest.raises(ValueError, match="lang"):
        store.append(spark.range(5).selectExpr("id", "1 as lang"))
    want = Counter({**{(i, "a", None, None): 1 for i in range(5)}, **{(i, None, 2, "x"): 4 for i in range(5)}})
    assert store.read().columns == ["id", "lang", "_metadata", "odd name"]
    assert rows_of(store.read()) == want
    store.compact()
    store.vacuum()
    assert store.manifest().count() < 5 and rows_of(store.read()) == want


def test_a_writer_that_died(spark, tmp_path):
    store = compaction.Store(spark, f"file://{tmp_path}/store")
    store.append(spark.range(5))
    (tmp_path / "store/versions/00000002").touch()
    assert store.version() == 1 and store.read().count() == 5
    assert store.append(spark.range(3)) == 2 and store.read().count() == 8


def plain_plan(shards, target, fan_in, factor):
    """Which shards one round merges: tiers by size, filled up to the target in the order of size and name."""
    groups, out = {}, set()
    for name, size in sorted(shards, key=lambda x: (x[1], x[0])):
        if size < target * compaction.FULL:
            tier = 0
            while factor ** (tier + 1) <= size + 1:
                tier += 1
            filled = sum(b for g, b in groups.get(tier, []))
            groups.setdefault(tier, []).append((filled // target, size))
            out.add((tier, filled // target, name, size))
    merged = {}
    for tier, part, name, size in out:
        merged.setdefault((tier, part), []).append((name, size))
    return {frozenset(n for n, _ in g) for g in merged.values() if len(g) >= fan_in or (len(g) > 1 and sum(b for _, b in g) >= target)}


def test_plan_against_a_plain_model(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(6)
    store = compaction.Store(spark, f"file://{tmp_path}/store")
    for _ in range(5):
        shards = [(f"s{k:03}", rng.choice([10, 15, 16, 60, 64, 300, 900, 4000])) for k in range(60)]
        monkeypatch.setattr(store, "manifest", lambda version=None, x=shards: spark.createDataFrame([(n, 1, b) for n, b in x], compaction.MANIFEST))
        got = {}
        for r in store.plan(target=1000, fan_in=4, factor=4).collect():
            got.setdefault(r.grp, set()).add(r.shard)
        assert set(map(frozenset, got.values())) == plain_plan(shards, 1000, 4, 4)


def test_empty_arrivals_and_repeated_rows(spark, make_docs, tmp_path):
    store = compaction.Store(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.read() is None and store.compact() == 0
    docs = make_docs([None, "", "x" * 300_000, "same", "same"], ids=[None, 1, 2, 3, 3]).withColumn("shard", F.lit(1)).withColumn("run", F.lit("r")).withColumn("rows", F.lit(2))
    store.append(docs.limit(0))
    assert store.version() == 1 and store.read() is None
    for _ in range(5):
        store.append(docs)
    store.compact()
    assert rows_of(store.read()) == rows_of(docs.union(docs).union(docs).union(docs).union(docs))
    docs.drop("shard", "run", "rows").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op3_compaction(spark, f"{tmp_path}/none").count() == 0


def test_unreadable_shards_are_told(spark, tmp_path, make_docs):
    store = compaction.Store(spark, f"file://{tmp_path}/store")
    store.append(make_docs(["a", "b"]))
    folder = tmp_path / "store" / "data" / "broken"
    folder.mkdir()
    assert store._written("broken").count() == 0
    (folder / "part-0.zstd.parquet").write_bytes(b"not a shard")
    with pytest.raises(Exception, match="(?i)footer|schema|read|corrupt"):
        store._written("broken").count()
    assert store.read(store.version()).count() == 2
