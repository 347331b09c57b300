"""URL filters: host and path rules, then a blocked Bloom filter with an exact join behind it.

The listed canonical URLs set bits in blocks of 512 bits, one bit in each of the
block's eight words, so a probe reads one row of the filter table. URLs that
pass may still be absent from the list; only these go on to a hash join with the
list itself, which removes false positives. Neither step leaves the JVM.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no canonical form, so no rule and no list entry fits it; an empty list
blocks nothing; repeated rows are judged alike; of rules of equal length the later
one wins; URLs of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

WORDS, BITS_PER_KEY = 8, 16
#: Rows of the filter that may be broadcast: at about 100 bytes each, 6 MB.
BROADCAST_BLOCKS = 1 << 16
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a closing slash or ``.html``, query without tracking fields; null without a host.

    Scheme and fragment are dropped.
    """
    bare = F.regexp_replace(host(url), r"^(www|m)\.", "")
    trail = F.regexp_replace(path(url), r"(/|\.html)$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, PARTS, 3), r"(?<=[?&])(utm_[a-z]+|ref)=[^&]*(&|$)", ""), r"[?&]$", "")
    return F.when(host(url) != "", F.concat(bare, trail, query))


def matching_rule(url_host: Column, url_path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host, path, verdict) that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for at, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((url_host == at) | url_host.endswith("." + at)) & url_path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bit(key: Column, i: int) -> Column:
    """Place of the key's bit in word i: six bits of a second hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * i).bitwiseAND(F.lit(63)).cast("int")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter as a table, built with partial aggregation."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(key), i)).alias(f"b{i}") for i in range(WORDS)]
    return listed.select(_block(F.col(key), blocks).alias("block"), *bits).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def flag_listed(rows: DataFrame, key: str, listed: DataFrame, flag: str) -> DataFrame:
    """``rows`` and whether their ``key`` is in ``listed`` (one column, same name), as column ``flag``.

    The filter is broadcast up to BROADCAST_BLOCKS rows and joined by its block
    number beyond. Probed rows are written once; only those that pass are shuffled
    for the exact join.
    """
    listed = materialize(listed.select(F.col(key).alias("_url_listed")).filter("_url_listed is not null").distinct(), "listed-urls")
    blocks = max(1, math.ceil(listed.count() * BITS_PER_KEY / (64 * WORDS)))
    table = bloom(listed, "_url_listed", blocks)
    table = table.withColumnsRenamed({c: f"_url_{c}" for c in table.columns})
    table = F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table
    probe = rows.withColumn("_url_block", _block(F.coalesce(F.col(key), F.lit("")), blocks)).join(table, "_url_block", "left")
    possible = F.col(key).isNotNull() & F.col("_url_w0").isNotNull()
    for i in range(WORDS):
        possible &= F.call_function("shiftrightunsigned", F.col(f"_url_w{i}"), _bit(F.col(key), i)).bitwiseAND(F.lit(1)) == 1
    probe = materialize(probe.withColumn("_url_may", F.coalesce(possible, F.lit(False))).select(*rows.columns, "_url_may"), "probed-urls")
    passed = probe.filter("_url_may").join(listed.hint("merge"), F.col(key) == F.col("_url_listed"), "left").withColumn(flag, F.col("_url_listed").isNotNull())
    return probe.filter("not _url_may").withColumn(flag, F.lit(False)).select(*rows.columns, flag).unionByName(passed.select(*rows.columns, flag))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed. ``listed`` has one column of canonical URLs, ``canon``."""
    rows = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), canonical(F.col(url)).alias("canon"))
    rows = rows.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    told = flag_listed(rows, "canon", listed, "listed")
    return told.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
