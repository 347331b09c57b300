import random
from collections import defaultdict

import pytest

import corpus_pipeline
from arbora.llm import simhash

from .conftest import SMALL


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def expect(rows):
    """Least ids of the groups of (doc_id, text) rows, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s or ["none"]:
            holders[x].append(k)
    for j, s in enumerate(sets):
        for k in {k for x in s or ["none"] for k in holders[x] if k < j}:
            both = len(s & sets[k])
            if both >= 0.8 * (len(s) + len(sets[k]) - both):
                a, b = find(j), find(k)
                up[max(a, b)] = min(a, b)
    first = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        first[find(k)].append(i)
    return {min(x) for x in first.values()}


def edited(rng, words, similar):
    """A copy whose shingles have about the given similarity: single words far apart are changed."""
    n = len(words) - 4
    hits = int(n * (1 - similar) / (1 + similar) / 5)
    out = list(words)
    for k in range(hits):
        out[4 + k * (n // max(hits, 1)) % n] = f"new{rng.random()}"
    return out


def test_stage_takes_edited_copies(spark, make_docs):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for similar in (0.81, 0.85, 0.9, 0.95, 0.7, 0.5):
        for _ in range(8):
            base = text(rng.randrange(150, 500))
            texts += [" ".join(base), " ".join(edited(rng, base, similar))]
    want = expect(list(enumerate(texts)))
    assert len(want) == 32 + 2 * 16  # those at 0.81 and above lose a copy
    kept = corpus_pipeline.near_dedup(spark, make_docs(texts), SMALL)
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_stage_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = expect([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()} == want


def test_dense_group_and_odd_rows(spark, make_docs):
    rng = random.Random(4)
    base = [f"d{k}" for k in range(400)]
    dense = [" ".join(edited(rng, base[: 395 + k % 5], 0.9)) for k in range(60)]
    texts = [*dense, None, "", " \n", "one two", "One  TWO", "a b c d e f", "a b c d e g"]
    docs = make_docs(texts)
    kept = [r.doc_id for r in simhash.keep_similar(docs.unionByName(docs.filter("doc_id = 63"))).collect()]
    assert sorted(kept) == sorted(expect(list(enumerate(texts)))) == [0, 60, 63, 65, 66]
    ids = [None, None, *range(2, len(texts))]
    assert sorted(r.doc_id for r in simhash.keep_similar(make_docs(texts, ids)).collect()) == [2, 60, 63, 65, 66]
    assert simhash.keep_similar(docs.limit(0)).count() == 0


@pytest.mark.parametrize("own", [30, 60])
def test_texts_over_one_boilerplate_make_candidates_in_proportion(spark, make_docs, monkeypatch, own):
    """Texts that share most words, too few to be alike, and some pairs among them that are."""
    made, real = {}, simhash.materialize

    def counted(df, label):
        out = real(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    counts = []
    for n in (500, 1000, 2000):
        rng = random.Random(n)
        shared = [f"b{k}" for k in range(170)]
        texts = [shared[:85] + [f"o{rng.random()}" for _ in range(own)] + shared[85:] for _ in range(n)]
        texts += [edited(rng, t, 0.9) for t in texts[::10]]
        texts = [" ".join(t) for t in texts]
        made.clear()
        kept = {r.doc_id for r in simhash.keep_similar(make_docs(texts)).collect()}
        assert kept == set(range(n))
        counts.append(made["candidates"])
    assert counts[2] < 2.5 * counts[1] < 6.25 * counts[0], counts
