"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for credential-shaped spans. The values' hashes are then
counted over the corpus by distinct repositories and owners: a value that many
owners hold, or that lies in many repositories, is a widely copied example; one
that a single owner holds in few repositories and that looks random is a live
credential. Shape matches (kinds ``assign``, ``access``, ``hex``) are always
reported; bare random-looking tokens (kind ``bare``) only when ownership shows
them to be one owner's.

Defined results: a null text is empty; an empty text or table gives no spans;
a null repository or owner counts as a value of its own, the empty string; rows
with equal id and text get equal results; spans that start at one place are
ordered by kind, as KINDS lists them; texts of any length are scanned whole, and
a text's work grows with its hits times RUN at most; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

#: Fixed patterns of the span kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "bare")

SPAN = "struct<start:int,rank:int,kind:string,stop:int,hash:string,live:boolean>"
#: Owners or repositories that make a value a widely copied one.
COPIED_OWNERS, COPIED_REPOS = 3, 4
#: Hits that are placed in one array, so that appending to it stays cheap.
RUN = 512


def _spans(text: Column, rank: int, pattern: str, hits: Column, value, keep) -> Column:
    """Spans of all matches, placed by the lengths of matches and of the text between them."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["g"])
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), (start + F.length(x["h"])).alias("stop"), F.sha2(value(x["h"]), 256).alias("hash"), _live_looking(value(x["h"])).alias("live")).cast(SPAN)

    def add(acc: Column, x: Column) -> Column:
        out = F.when(keep(x["h"]), F.concat(acc["out"], F.array(span(acc["at"], x)))).otherwise(acc["out"])
        return F.when(x["h"].isNull(), acc).otherwise(F.struct((acc["at"] + F.length(x["g"]) + F.length(x["h"])).alias("at"), out.alias("out")))

    def add_run(acc: Column, run: Column) -> Column:
        told = F.aggregate(run, F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return let(told, lambda t: F.struct(t["at"].alias("at"), F.concat(acc["out"], F.array(t["out"])).alias("out")))

    def place(gaps: Column) -> Column:
        each = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
        runs = let(each, lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / RUN).cast("int")), lambda k: F.slice(e, k * RUN + 1, RUN)))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("out"))
        return F.aggregate(runs, start, add_run, lambda acc: F.flatten(acc["out"]))

    return F.when(F.size(hits) == 0, none).otherwise(let(F.split(text, pattern, -1), place))


def _live_looking(value: Column) -> Column:
    """Random-looking: letters and digits, and many different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``bare``, arrays of spans ordered by start, then kind. Positions are code points, ends exclusive."""
    t = F.coalesce(F.col(text), F.lit(""))
    hits = docs.withColumns({f"_h{i}": F.regexp_extract_all(t, F.lit(p), 0) for i, p in enumerate((ASSIGN, ACCESS, HEX, BARE))})
    whole = lambda h: h
    anything = lambda h: F.lit(True)
    secret = lambda h: F.regexp_extract(h, ASSIGN, 2)
    found = hits.withColumns(
        {
            "_s0": _spans(t, 0, ASSIGN, F.col("_h0"), secret, lambda h: F.length(secret(h)) >= 6),
            "_s1": _spans(t, 1, ACCESS, F.col("_h1"), whole, anything),
            "_s2": _spans(t, 2, HEX, F.col("_h2"), whole, anything),
            "_s3": _spans(t, 3, BARE, F.col("_h3"), whole, _live_looking),
        }
    )
    base = F.array_sort(F.concat("_s0", "_s1", "_s2"))
    return (
        found.withColumn("base", base)
        .withColumn("bare", F.when(F.size("_s3") == 0, F.col("_s3")).otherwise(F.filter("_s3", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))))
        .drop(*[f"_{k}{i}" for k in "hs" for i in range(4)])
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of rows (hash, repo, owner). Counts before the shuffle bound a hot value to a row for each repository and task."""
    each = candidates.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    return each.groupBy("hash").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"), F.sum("n").alias("n_found"))


def findings(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    repo: Column | None = None,
    owner: Column | None = None,
    copied_owners: int = COPIED_OWNERS,
    copied_repos: int = COPIED_REPOS,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, base, added, n_live, n_copied.

    A value is copied if at least ``copied_owners`` owners hold it or it lies in
    ``copied_repos`` repositories. ``added`` holds the bare tokens that one owner
    alone has and that aren't copied; ``n_copied`` counts base spans of copied
    values, ``n_live`` the reported spans that look random, have one owner and
    aren't copied. (doc_id, text_key) tells a row's text.
    """
    blank = F.lit("")
    scanned = materialize(
        scan(
            docs.select(
                F.col(doc_id).alias("doc_id"),
                F.xxhash64(text).alias("text_key"),
                F.coalesce(repo if repo is not None else F.col("source"), blank).cast("string").alias("repo"),
                F.coalesce(owner if owner is not None else F.col("source"), blank).cast("string").alias("owner"),
                F.col(text).alias("text"),
            )
        ).drop("text"),
        "secret-spans",
    )
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    own = (F.col("n_owners") == 1) & ~copied
    any_span = (F.size("base") > 0) | (F.size("bare") > 0)
    each = scanned.filter(any_span).select("doc_id", "text_key", "repo", "owner", F.explode(F.concat("base", "bare")).alias("span")).withColumn("hash", F.col("span.hash"))
    known = materialize(ownership(each), "ownership")  # as a table, so that Spark can split a hot value's join
    judged = (
        each.select("doc_id", "text_key", "hash", "span")
        .distinct()
        .join(known, "hash")
        .groupBy("doc_id", "text_key")
        .agg(
            F.array_sort(F.collect_list(F.when((F.col("span.kind") == "bare") & own, F.col("span")))).alias("added"),
            F.count_if(own & F.col("span.live")).alias("n_live"),
            F.count_if(copied & (F.col("span.kind") != "bare")).alias("n_copied"),
        )
    )
    plain = scanned.filter(~any_span).select("doc_id", "text_key", "base", F.expr(f"cast(array() as array<{SPAN}>)").alias("added"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    left, right = scanned.filter(any_span).alias("l"), judged.alias("r")
    told = left.join(right, F.expr("l.doc_id <=> r.doc_id and l.text_key = r.text_key")).select("l.doc_id", "l.text_key", "l.base", "r.added", "r.n_live", "r.n_copied")
    return plain.unionByName(told)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans give one mark."""
    spans = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.array_sort(F.concat("base", "added")).alias("_spans")).filter(F.size("_spans") > 0).dropDuplicates(["_id", "_key"])
    joined = docs.join(spans, docs[doc_id].eqNullSafe(spans["_id"]) & (F.xxhash64(docs[text]) == spans["_key"]), "left")

    def cut(t: Column) -> Column:
        told = F.aggregate(
            "_spans",
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
            lambda acc, s: F.when(s["stop"] <= acc["at"], acc)
            .when(s["start"] < acc["at"], F.struct(s["stop"].alias("at"), acc["out"].alias("out")))
            .otherwise(F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]))).alias("out"))),
        )
        return let(told, lambda x: F.concat(F.array_join(x["out"], mark), F.lit(mark), F.substring(t, x["at"] + 1, F.length(t))))

    new = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(let(F.col(text), cut))
    return joined.withColumn(text, new).select(*docs.columns)
