import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from arbora.llm import quality_rules, queries

from .conftest import SMALL

BLANKS = r"[\x20\x09-\x0D]+"


def measures(text):
    text = text or ""
    w = [x for x in re.split(BLANKS, text) if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.sub(BLANKS, "", x)]
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
    return out, len(w) < 10 or 100 * len(hit) > 20 * len(w)


def tail(n, k, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def expect(rows, labels, risk, doubt):
    """kept by (doc_id, text, lang)."""
    good = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            good[i].append(q)
    held = defaultdict(list)
    for i, t, lang in rows:
        m, failed = measures(t)
        if not failed and good.get(i) and min(good[i]) == 1:
            held[lang or ""].append(m)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def rejected(m, steps):
        return any(scale * m[names.index(what)] > c * m[0] for what, scale, c in quality_rules.STEPS[:steps])

    taken = {}
    for lang, ms in held.items():
        taken[lang] = 0
        for n in range(1, len(quality_rules.STEPS) + 1):
            bad = sum(rejected(m, n) for m in ms)
            if bad >= len(ms) * risk or tail(len(ms), bad, risk) > doubt / len(held):
                break
            taken[lang] = n
    out = []
    for i, t, lang in rows:
        m, failed = measures(t)
        out.append((i, *m, failed, not failed and not rejected(m, taken.get(lang or "", 0))))
    return Counter(out), taken


def got(df):
    return Counter(tuple(r[c] for c in ("doc_id", *quality_rules.MEASURES, "base_failed", "kept")) for r in df.collect())


def test_query_against_plain_python(spark):
    folder = SMALL.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    assert got(queries.op4_quality_rules(spark, folder)) == expect(rows, labels, quality_rules.RISK, quality_rules.DOUBT)[0]


def test_accepted_cutoffs_reject(spark):
    folder = SMALL.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    want, taken = expect(rows, labels, quality_rules.RISK, quality_rules.DOUBT)
    assert taken["en"] > 0
    assert any(not x[-2] and not x[-1] for x in want)
    docs, told = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for risk, doubt in ((quality_rules.RISK, quality_rules.DOUBT), (0.2, 0.3)):
        want = expect(rows, labels, risk, doubt)[0]
        assert got(quality_rules.judge(docs, told, risk=risk, doubt=doubt)) == want
        kept = quality_rules.keep_good(docs, told, risk=risk, doubt=doubt)
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(x[0] for x in want.elements() if x[-1])


def test_false_rejections_stay_below_the_risk(spark):
    """At sf0.1 every language takes steps, and what they reject of its good documents is below the risk."""
    folder = SMALL.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    told = quality_rules.judge(docs, labels).filter("not base_failed").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    shares = told.groupBy("lang", "quality").agg(F.avg(F.when(F.col("kept"), 0).otherwise(1)).alias("gone")).collect()
    assert all(r.gone <= quality_rules.RISK for r in shares if r.quality == 1)
    assert all(r.gone > 0.9 for r in shares if r.quality == 0)


def test_exact_tail(spark):
    cases = [(10, 0, 0.3), (50, 4, 0.3), (1000, 30, 0.05), (20000, 80, 0.005), (200000, 900, 0.005)]
    for n, k, p in cases:
        r = spark.range(1).select(quality_rules.log_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("x")).first()
        assert math.isclose(math.exp(r.x), tail(n, k, p), rel_tol=1e-6, abs_tol=1e-300)


def test_cases(spark, make_docs, tmp_path):
    texts = [None, "", " \n\x0b", "a b c d e a b c d e", "x " * 30, "one\n\none\n \n one\none", "## $$ <a|b> é 😀 " * 3, "w" * 100_000, " ".join(str(i) for i in range(30_000)), "a b c d e f g h i j k l m n o p", "p q r s t u v w x y\np q r s"]
    docs = make_docs(texts)
    docs.unionByName(docs.filter("doc_id = 9")).withColumn("kept", F.lit(1)).withColumn("_w", F.lit(2)).withColumn("stratum", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(9, 1), (9, 0), (None, 1), (10, None), (77, 1), (8, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    want = expect(rows, [(r.doc_id, r.quality) for r in labels.collect()], quality_rules.RISK, quality_rules.DOUBT)[0]
    assert got(queries.op4_quality_rules(spark, str(tmp_path))) == want
    assert quality_rules.judge(docs.limit(0), labels.limit(0)).count() == 0
    assert got(quality_rules.judge(docs, labels.limit(0))).total() == len(texts)
