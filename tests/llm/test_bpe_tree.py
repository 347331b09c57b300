import hashlib
import os
import random
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbora.llm import bpe_tree, queries

from .conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expect(library, rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def odd_texts():
    rng = random.Random(2)
    kinds = ["ab", "theingation", "aéÉßΣσ", "x!?.'sñ", "01239", "日本語のテキスト", "áëo", "<|endoftext|>a.", "  \x85\x1fa", "😀👍🏽é"]
    texts = [None, "", " \n\t ", "It's <|startoftext|>HERE<|endoftext|> İ ſ K", "á ́b", "don't'll 'RE x'"]
    for k in kinds:
        for n in (1, 40, 700, 5000):
            texts.append("".join(rng.choice(k) for _ in range(n)))
    texts += ["One, two. THREE... four.,five ,. .x 3.14, a.b. It's. don't, É, T\u0308. T\u0308x, Ä.", "T\u0308est t\u0308. <|ENDOFTEXT|>, <|endoftext|>. A<b.", "end.", "1,", "\u1e97. \u212a, K."]
    texts += ["a" * 9000, "ab" * 5000, "the" * 4000 + " end", "word " * 3000, "é" * 4097, "".join(kinds) * 60]
    return texts


def test_query_against_library(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(queries.op2_bpe_tree(spark, SMALL)) == expect(library, rows)


@pytest.mark.parametrize("leaf", [3, 16, 257, 2048])
def test_joins_at_every_leaf_length(library, leaf):
    enc = bpe_tree.TreeEncoder(PATH, leaf)
    for t in odd_texts():
        if t and not t.isspace():
            got = [i for w in t.encode().split() for i in map(int, enc.runs([w])[w][0].split())]
            assert got == library.encode(t, add_special_tokens=False).ids, (leaf, t[:60])


@pytest.mark.parametrize("leaf", [1, 8, 100])
def test_whole_texts_at_every_leaf_length(library, leaf):
    rng = random.Random(leaf)
    signs = [*"aab c'.,ts  éÉΣσ😀中<|>/1٣\u3000\n\t\u0308", "<|startoftext|>", "<|endoftext|>", "'re", "ll"]
    enc = bpe_tree.TreeEncoder(PATH, leaf)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(150))) for _ in range(300)] + [t or "" for t in odd_texts()]
    joins = 0
    for k in range(0, len(texts), 50):
        for t, (ids, back, n) in zip(texts[k : k + 50], enc.texts([t.encode() for t in texts[k : k + 50]]), strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids.decode() == " ".join(map(str, want)), (leaf, t[:60])
            assert back.decode() == library.decode(want, skip_special_tokens=False)
            joins += n
    assert joins > 500


def test_windows_grow_where_sides_disagree(library):
    """A wrong neighbour is found out: the window grows until it is inside."""
    enc = bpe_tree.TreeEncoder(PATH)
    left, right = b"one two three four five".split(), b"six seven eight nine ten".split()
    table = dict(zip(left + right, enc.encoded(left + right), strict=True))
    table[b"four"] = (b"1", b"wrong")
    once = {}
    joined = enc.concatenate([(left, right, False)], table, once)[0]
    table |= once
    assert b" ".join(table[w][0] for w in joined).decode() == " ".join(map(str, library.encode("one two three four five six seven eight nine ten", add_special_tokens=False).ids))
    assert len(joined[1 if joined[0] == b"one" else 0].split()) > 2 * bpe_tree.RUNS


def test_query_rows_go_through_joins(spark):
    rows = {r.doc_id: r.n_joins for r in queries.op2_bpe_tree(spark, SMALL).collect()}
    sizes = {r.doc_id: len((r.text or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(rows[i] > 0 for i, n in sizes.items() if n > 2 * bpe_tree.LEAF)
    assert sum(n > 0 for n in rows.values()) > len(rows) / 3


def test_cases(spark, library, make_docs, tmp_path):
    texts = odd_texts()
    docs = make_docs(texts)
    docs.unionByName(docs.filter("doc_id = 3")).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op2_bpe_tree(spark, str(tmp_path))) == expect(library, [*enumerate(texts), (3, texts[3])])
    back = {r.doc_id: (list(r.ids), r.decoded) for r in bpe_tree.encode(docs, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert back[i] == (ids, library.decode(ids, skip_special_tokens=False))
    assert bpe_tree.digests(docs.limit(0), PATH).count() == 0


def test_forgetting(library, monkeypatch):
    monkeypatch.setattr(bpe_tree, "REMEMBERED", 5)
    enc = bpe_tree.TreeEncoder(PATH)
    for t in ("one two three four", "two five six seven", "x" * 100 + " one", "one two"):
        ids = library.encode(t, add_special_tokens=False).ids
        assert next(enc.texts([t.encode()]))[0].decode() == " ".join(map(str, ids))


def test_a_portion_of_known_runs_forgets_none(monkeypatch):
    monkeypatch.setattr(bpe_tree, "REMEMBERED", 8)
    enc = bpe_tree.TreeEncoder(PATH)
    for t in (b"one two three four five six", b"one two three four five"):
        list(enc.texts([t]))
    assert b"six" in enc.known


def test_a_task_encodes_on_its_own_thread():
    code = f"""
import os
from arbora.llm import bpe_tree
enc = bpe_tree.TreeEncoder({PATH!r})
before = len(os.listdir("/proc/self/task"))
list(enc.texts([" ".join(f"word{{i}}" for i in range(5000)).encode()] * 4))
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    assert subprocess.run([sys.executable, "-c", code], env=env, cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout.strip() == "0"
