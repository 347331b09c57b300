import hashlib
import re

from pyspark.sql import functions as F

from arbora.llm import queries, secret_scan

from .conftest import SMALL

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def told(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def check(rows, texts):
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(told(want).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("bare")] == [s for s in told(want).split(",") if s]
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_query_against_regular_expressions(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op1_secret_scan(spark, folder).collect()
    assert len(rows) == len(texts)
    assert sum(r["n_assign"] for r in rows) > 0
    check(rows, texts)


LIVE, COPIED = "Zx81-qLm0_PoVb7T3ne5", "Example0_Key-For9Docs7"


def test_cases(spark, make_docs, tmp_path):
    texts = [
        None,
        "",
        "é😀 PassWord: 'abcdef' secret=token:abcdefgh token = abc API_KEY=\"zz/yy.xx==\"",
        "AKIA" + "B" * 16 + " AKIAB AKIAAKIA" + "C" * 20 + "\nAKIA",
        "x" * 5 + "0123456789abcdef01234567" * 3 + "g" + "deadbeef" * 2,
        f"use {LIVE} now, or {COPIED}",
        f"{COPIED} again",
        f"and {COPIED}",
        "token=" + "f0" * 13,
    ]
    path = str(tmp_path)
    docs = make_docs(texts)
    docs.unionByName(docs.filter("doc_id = 2")).withColumn("hash", F.lit(1)).withColumn("span", F.lit("x")).write.parquet(f"{path}/documents.parquet")
    rows = queries.op1_secret_scan(spark, path).collect()
    assert len(rows) == len(texts) + 1
    check(rows, dict(enumerate(texts)))
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["spans"].startswith("bare:4:24") and by[5]["spans"].count("bare") == 1
    assert "bare" not in by[6]["spans"]


def test_one_owner_in_many_repositories_is_copied_and_live_must_look_random(spark):
    many, few, plain = "Qx81-qLm0_PoVb7T3ne5", "Rx92-qLm1_PoVb7T3ne6", "password=changeme"
    rows = [(k, f"{many} {plain if k == 0 else ''} token={few}" if k < 2 else many, "one", f"repo{k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    by = {r.doc_id: r for r in secret_scan.findings(docs, repo=F.col("repo"), owner=F.col("source")).collect()}
    assert not any(r.added for r in by.values())  # in five repositories of one owner
    assert (by[0].n_live, by[1].n_live, by[2].n_live) == (1, 1, 0)  # the token, not the placeholder password
    assert all(r.n_copied == 0 for r in by.values())


def test_many_hits_in_a_very_long_text(spark, make_docs):
    text = " ".join(f"token=Abc{k:07d}def é {k:024x}" for k in range(3000))
    docs = make_docs([text, "plain " * 100_000, f"{'0' * 24}token=secret99 password: AKIA{'A' * 20}"])
    found = {r.doc_id: r for r in secret_scan.findings(docs).collect()}
    for k, t in ((0, text), (2, docs.filter("doc_id = 2").first().text)):
        assert [(s.start, s.rank, s.kind, s.stop) for s in found[k].base] == base(t)
    assert len(found[0].base) == 6000 and not found[1].base
    out = {r.doc_id: r.text for r in secret_scan.redact(docs, secret_scan.findings(docs)).collect()}
    assert out[0] == " ".join(["[SECRET] é [SECRET]"] * 3000)


def test_empty_table_and_redaction(spark, make_docs):
    docs = make_docs(["a token=abcdef0123 b", None, "plain", "ok AKIA" + "Z" * 16])
    out = secret_scan.redact(docs, secret_scan.findings(docs))
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: "a [SECRET] b", 1: None, 2: "plain", 3: "ok [SECRET]"}
    assert secret_scan.findings(docs.limit(0)).count() == 0
