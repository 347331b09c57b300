import hashlib
import os
import random

import pytest

from arbora.llm import prefix_hash, queries

from .conftest import SMALL


def expect(rows):
    """The chain of (doc_id, text) rows in the order given."""
    out = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        shared = len(os.path.commonprefix([text, edited])), len(os.path.commonprefix([text, after]))
        out.setdefault((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *shared), 0)
        out[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *shared] += 1
    return out


def got(df):
    out = {}
    for r in df.collect():
        k = (r.doc_id, r.n_chars, r.edited_sha256, r.common_edited, r.common_next)
        out[k] = out.get(k, 0) + 1
    return out


def test_query_against_plain_python(spark):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()), reverse=True)
    found = queries.op13_prefix_hash(spark, SMALL).collect()
    assert got(queries.op13_prefix_hash(spark, SMALL)) == expect(rows)
    by_text, texts = {}, dict(rows)
    for r in found:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert r.near_edited >= 0.5 or r.n_chars < 3
    assert all(len(x) == 1 for x in by_text.values()) and len({min(x) for x in by_text.values()}) == len(by_text)
    order = [i for i, _ in rows]
    for r in found:  # likeness is 1 for equal texts alone
        after = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        assert (r.near_next == 1) == (after == texts[r.doc_id])
        assert r.near_next <= (r.common_next + len(os.path.commonprefix([texts[r.doc_id][::-1], after[::-1]]))) / max(1, r.n_chars, len(after)) + 1e-9


def test_cases(spark, make_docs, tmp_path):
    long = "".join(random.Random(1).choices("ab é\U0001f600", k=300_000))
    texts = [None, "", "a", "ab", "abc", "é\U0001f600x", long, long[:200_000] + "!" + long[200_000:], "abc", "zz"]
    ids = [9, 8, 7, 6, 5, 4, 3, 2, 1, None]
    make_docs(texts, ids).withColumnsRenamed({"lang": "pid", "source": "edge"}).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_prefix_hash(spark, str(tmp_path))
    assert got(found) == expect(list(zip(ids, texts, strict=True)))
    marks = {r.doc_id: r for r in found.collect()}
    assert marks[5].fingerprint == marks[1].fingerprint and marks[9].fingerprint == marks[8].fingerprint and marks[9].near_next == 1
    assert 0.9 < marks[3].near_next < 1
    one = make_docs(["abcdef"], [1])
    assert got(prefix_hash.chain(one)) == expect([(1, "abcdef")])
    copies = make_docs(["abcdef"] * 50, [1] * 50)
    assert got(prefix_hash.chain(copies)) == expect([(1, "abcdef")] * 50)
    assert prefix_hash.chain(one.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_spans_and_extensions(monkeypatch, chunk):
    monkeypatch.setattr(prefix_hash, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(200):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 90))) for _ in range(2))
        x, y = prefix_hash.PrefixHashes(a), prefix_hash.PrefixHashes(b)
        i, k = rng.randint(0, len(a)), rng.randint(0, len(b))
        assert x.extension(i, y, k) == len(os.path.commonprefix([a[i:], b[k:]]))
        n = rng.randint(0, min(len(a) - i, len(b) - k))
        assert x.equal(i, y, k, n) == (a[i : i + n] == b[k : k + n]) == (x.span(i, i + n) == y.span(k, k + n))
        assert (x.fingerprint() == y.fingerprint()) == (a == b)
