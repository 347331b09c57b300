from pyspark.sql import functions as F
import re

from arbora.llm import queries, url_filter

from .conftest import SMALL


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_query_against_plain_python(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    rows = queries.op8_url_filter(spark, SMALL).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r["host"], r["path"]) == parts(urls[r["page_id"]])
        want, verdict = rule(r["host"], r["path"])
        assert r["rule"] == want
        assert r["verdict"] == (verdict or ("block" if r["listed"] else "allow"))


def test_cases(spark):
    urls = [None, "", "no scheme", "http://Example.ORG", "http://a.EXAMPLE.org/es/x?y#z", "http://example.org/en/12", "http://org/", "ftp://x.com/de/", "http://x.net/a/", "https://www.x.net/a.html?utm_source=f#t", "http://É.net?q://", "://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("x.net/a",), (None,), ("x.net/a",)], "canon string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, listed, queries.URL_RULES).collect()}
    assert len(rows) == len(urls)
    for k, r in rows.items():
        assert (r["host"], r["path"]) == parts(urls[k])
        assert r["rule"] == rule(r["host"], r["path"])[0]
    assert [k for k, r in rows.items() if r["listed"]] == [8, 9] or {k for k, r in rows.items() if r["listed"]} == {8, 9}
    assert rows[8]["verdict"] == "block" and rows[10]["verdict"] == "allow"
    empty = url_filter.judge(pages, listed.limit(0), []).collect()
    assert {r["verdict"] for r in empty} == {"allow"}
    assert url_filter.judge(pages.limit(0), listed, []).count() == 0


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    rows = spark.range(2000).selectExpr("id", "concat('u', id) as k")
    listed = spark.range(0, 4000, 3).selectExpr("concat('u', id) as k")
    got = url_filter.flag_listed(rows, "k", listed, "hit").collect()
    assert {r.id for r in got if r.hit} == set(range(0, 2000, 3)) and len(got) == 2000


def test_long_urls_repeated_rows_and_clashing_columns(spark):
    long = "http://x.net/" + "a/" * 50_000 + "?ref=1&" + "q" * 50_000
    rows = [(1, long), (1, long), (2, "http://y.net/b")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as block", "'w' as w0", "true as listed", "2 as r", "'c' as canon")
    listed = pages.select(url_filter.canonical(F.col("url")).alias("canon")).filter("length(canon) > 100")
    got = url_filter.judge(pages, listed, [("net", "/", "allow"), ("net", "/", "block")]).collect()
    assert sorted((r.page_id, r.listed, r.verdict, r.rule) for r in got) == [(1, True, "block", "net/"), (1, True, "block", "net/"), (2, False, "block", "net/")]
    odd = spark.range(3).selectExpr("cast(id as string) as k", "1 as block", "2 as w0", "3 as _may")
    flagged = url_filter.flag_listed(odd, "k", odd.filter("k = '1'"), "hit")
    assert flagged.columns == [*odd.columns, "hit"] and [r.k for r in flagged.collect() if r.hit] == ["1"]
