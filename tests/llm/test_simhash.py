import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from arbora.llm import queries, simhash

from .conftest import SMALL


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values):
    values = sorted(set(values))
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    x = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ np.uint64(v)) <= 3):
            a, b = find(v), find(values[j])
            if a != b:
                up[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def expect(rows):
    """component_id of (doc_id, text) rows."""
    prints = [brute_print(t) for _, t in rows]
    roots = brute_roots(prints)
    low = defaultdict(list)
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            low[roots[p]].append(i)
    return Counter((i, f"{p:016x}", min(low[roots[p]], default=None)) for (i, _), p in zip(rows, prints, strict=True))


def test_links_have_the_components_of_all_close_pairs(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    values = set(centres)
    for c in centres:
        for _ in range(60):
            v = c
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                v ^= 1 << b
            values.add(v)
    for at, bits in simhash.THIRDS:  # three bits within one third, and nothing else near
        v = rng.getrandbits(64)
        values |= {v, v ^ sum(1 << b for b in rng.sample(range(at, at + bits), 3))}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    each = spark.createDataFrame([(signed(v), i) for i, v in enumerate(sorted(values))], "fp long, doc_id long")
    got = defaultdict(set)
    for r in simhash.groups(each).collect():
        got[r.root].add(r.fp % (1 << 64))
    want = defaultdict(set)
    for v, r in brute_roots(values).items():
        want[r].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SMALL).collect())
    assert got == expect(rows)


def test_cases(spark, make_docs, tmp_path):
    long = " ".join(f"w{i % 977}" for i in range(40000))
    texts = [None, "", "\n\t ", "One", "one two", "ONE two", "É é", "é É", "a b c d", "a  b\nc d", long, long + " more", "x" * 200_000]
    ids = [5, 4, 3, 6, 7, 8, 9, None, 10, 10, 11, 12, 13]
    docs = make_docs(texts, ids)
    docs.unionByName(docs.filter("doc_id = 8")).withColumn("fp", F.lit(0)).withColumn("root", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, str(tmp_path)).collect())
    assert got == expect([*zip(ids, texts, strict=True), (8, "ONE two")])
    kept = simhash.keep_one(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.count() == len({c for _, _, c in got if c is not None} | {None for x in got if x[2] is None})
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op10_simhash(spark, f"{tmp_path}/none").count() == 0
