"""Quality rules with risk-controlled thresholds.

Each rule has a score and a fixed list of cutoffs. A fixed sequence of steps, the
most trusted rules and highest cutoffs first, lowers one cutoff at a time, so that
what the steps so far reject only grows. For each stratum (language) the labelled
good documents that they would reject are counted, and the exact binomial tail
says whether the share of all good ones that they reject is below the risk. A
stratum takes steps as long as it is: testing in a fixed order needs no correction
within a stratum, and a Bonferroni correction over the strata makes the bounds of
all hold at once with the stated confidence. A stratum with too few labels for the
first step rejects nothing.

Defined results: a null or empty text has no words, so it fails the base rule;
a null stratum is a stratum of its own; a score equal to a cutoff is not above it; a document with several labels is good
if all are 1; labels without a document, or null, count for nothing; repeated
rows are judged alike; without labels or documents only the base rule acts; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, words

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Rule, measure, scale and cutoffs, in the order of the steps: a document scores scale * measure / n_words.
RULES = (
    ("symbols", "n_symbols", 100, (50, 20, 10, 5, 2)),
    ("length", "word_chars", 10, (150, 120, 100, 80)),
    ("lines", "n_dup_lines", 1000, (80, 40, 20, 10, 5)),
    ("repeats", "n_repeat_words", 100, (15, 10, 5)),
)
STEPS = tuple((what, scale, cutoff) for _, what, scale, cutoffs in RULES for cutoff in cutoffs)
#: Share of a stratum's good documents that all its rules together may reject, and the chance that any stratum's bound is wrong.
#: With four strata the first step needs 174 good labels.
RISK, DOUBT = 0.025, 0.05
#: Rows of thresholds that may be broadcast; each is about 100 bytes.
BROADCAST_STRATA = 10_000


def _repeated(w: Column) -> Column:
    """Words in windows that occur twice or more in the array ``w``, compared as text."""
    grams = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("g"), i.alias("i"))))

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda j: ((j > 0) & (F.get(s, j - 1)["g"] == F.get(s, j)["g"])) | ((j < last) & (F.get(s, j + 1)["g"] == F.get(s, j)["g"]))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda j: F.get(s, j)["i"]))

    covered = lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, k: acc + F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - F.get(p, k)), F.lit(WINDOW)))
    )
    return let(let(grams, places), covered)


def _repeat_words(w: Column) -> Column:
    """As _repeated(), where hashes alone show that most texts have none."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(_repeated(w)))


def measure(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    told = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    out = docs.withColumns(
        {
            "_w": told,
            "word_chars": F.length(F.translate(t, BLANK, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": F.when(F.instr(t, "\n") == 0, F.lit(0)).otherwise(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).cast("long"),
        }
    )
    out = out.withColumns({"n_words": F.col("_w.n_words"), "n_repeat_words": F.col("_w.n_repeat_words")}).drop("_w")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def first_step() -> Column:
    """The first step that rejects a measured row; len(STEPS) if none does."""
    found = F.lit(len(STEPS))
    for i, (what, scale, cutoff) in reversed(list(enumerate(STEPS))):
        found = F.when(scale * F.col(what) > cutoff * F.col("n_words"), F.lit(i)).otherwise(found)
    return found


def log_tail(n: Column, k: Column, p: float) -> Column:
    """Logarithm of P(X <= k) for X binomial (n, p), summed exactly term by term; for k < n * p."""
    odds = F.lit(p / (1 - p))
    none = n * F.log1p(F.lit(-p))
    start = F.struct(none.alias("term"), none.alias("top"), F.lit(1.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(acc["top"], term)
        return F.struct(term.alias("term"), top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(term - top)).alias("sum"))

    end = lambda acc: acc["top"] + F.log(acc["sum"])
    return F.when(k == 0, none).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, add, end))


def thresholds(measured: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(stratum, n, steps): the good documents held out and the number of steps that the stratum takes."""
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("_id")
    held = (
        measured.filter("not base_failed")
        .select(F.col(doc_id).alias("_doc"), F.coalesce(stratum, F.lit("")).alias("stratum"), first_step().alias("first"))
        .join(good, F.col("_doc") == F.col("_id"))
        .groupBy("stratum")
        .agg(F.count("*").alias("n"), *[F.count_if(F.col("first") <= i).alias(f"k{i}") for i in range(len(STEPS))])
    )
    held = materialize(held, "holdout-counts")
    level = math.log(doubt / max(1, held.count()))
    each = held.select("stratum", "n", F.explode(F.array(*[f"k{i}" for i in range(len(STEPS))])).alias("k"))
    # short of the expected count the tail is small; at or above it no bound can hold. The counts only grow, so the steps that hold come first
    holds = F.when(F.col("k") < F.col("n") * risk, log_tail(F.col("n"), F.col("k"), risk) <= level).otherwise(F.lit(False))
    return each.groupBy("stratum", "n").agg(F.count_if(holds).alias("steps"))


def verdicts(measured: DataFrame, cutoffs: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """Adds ``kept`` to measured rows."""
    cuts = materialize(cutoffs.select(F.col("stratum").alias("_stratum"), F.col("steps").alias("_steps")), "thresholds")
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    joined = measured.join(cuts, F.coalesce(F.col(stratum), F.lit("")) == F.col("_stratum"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (first_step() >= F.coalesce("_steps", F.lit(0)))).drop("_stratum", "_steps")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """doc_id, the five measures, base_failed and kept, for every row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).cast("string").alias("lang"), F.col(text).alias("text"))
    measured = materialize(measure(rows).drop("text"), "measures")
    return verdicts(measured, thresholds(measured, labels, risk=risk, doubt=doubt)).select("doc_id", *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """``docs`` without the rows that the rules reject. Rows are measured once and written with their measures, which costs less than to measure again."""
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("doc_id"), F.col(stratum).cast("string").alias("lang"), F.col(text).alias("text"))
    measured = materialize(measure(held).drop("text"), "measures")
    cuts = thresholds(measured, labels, risk=risk, doubt=doubt)
    return verdicts(measured, cuts).filter("kept").select("_row.*")
