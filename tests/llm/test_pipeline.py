import re
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from arbora.llm import quality_rules

from . import test_quality_rules, test_secret_scan, test_similar_sets
from .conftest import SMALL

BLANKS = r"[\x20\x09-\x0D]+"


def split(text):
    return [w for w in re.split(BLANKS, text or "") if w]


def brute(rows, labels):
    """Texts after the first four stages, by id, from (doc_id, text, lang, source)."""
    judged = test_quality_rules.expect([r[:3] for r in rows], labels, quality_rules.RISK, quality_rules.DOUBT)[0]
    kept = {x[0] for x in judged if x[-1]}
    rows = [r for r in rows if r[0] in kept]
    first = test_similar_sets.expect([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if r[0] in first]
    each = {r[0]: split(r[1]) for r in rows}
    seen = Counter(tuple(w[k : k + 35]) for w in each.values() for k in range(len(w) - 34))
    texts = {}
    for r in rows:
        w, gone = each[r[0]], set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        texts[r[0]] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r[1]
    bare, owners = {}, defaultdict(set)
    for r in rows:
        t = texts[r[0]]
        base = test_secret_scan.base(t)
        for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", t):
            v = m[0]
            if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 10 and not any(a < m.end() and m.start() < b for a, _, _, b in base):
                bare.setdefault(r[0], []).append((m.start(), m.end(), v))
                owners[v].add(r[3])
        for a, k, _, b in base:
            v = t[a:b] if k else test_secret_scan.ASSIGN.match(t, a)[2]
            owners[v].add(r[3])
    out = {}
    for r in rows:
        t = texts[r[0]]
        spans = sorted([(a, b) for a, _, _, b in test_secret_scan.base(t)] + [(a, b) for a, b, v in bare.get(r[0], []) if len(owners[v]) == 1])
        done, at = "", 0
        for a, b in spans:
            if b <= at:
                continue
            done, at = done if a < at else done + t[at:a] + "[SECRET]", b
        out[r[0]] = done + t[at:]
    return out


def test_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    want = brute(rows, labels)
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SMALL)
        assert stage.dtypes == docs.dtypes
    assert {r.doc_id: r.text for r in stage.collect()} == want
    placed = defaultdict(int)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        placed[r.doc_id] += r.length
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert dict(placed) == {i: n for i, t in want.items() if (n := len(library.encode(t or "", add_special_tokens=False).ids))}
