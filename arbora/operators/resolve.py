"""Symbol resolution: last definition, as-of, and innermost enclosing span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_defined(calls: DataFrame, symbols: DataFrame, keys: list[str], *, value: str, order: str) -> DataFrame:
    """``calls`` with ``value`` of the last symbol of equal keys; null if there is none."""
    return calls.join(symbols.groupBy(*keys).agg(F.max_by(value, order).alias(value)), keys, "left")


def as_of(rows: DataFrame, facts: DataFrame, keys: list[str], *, at: str, value: str, strictly: bool = True) -> DataFrame:
    """``rows`` with the ``value`` of the latest fact of equal keys before ``at`` (or at it, unless ``strictly``).

    Both sides are one stream in order of time, and the last fact is carried
    along: one shuffle on the keys, no pairs.
    """
    names = rows.columns
    left = rows.withColumns({"_v": F.lit(None).cast(facts.schema[value].dataType), "_fact": F.lit(False)})
    right = facts.select(*keys, at, F.col(value).alias("_v"), F.lit(True).alias("_fact"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_fact") if strictly else ~F.col("_fact")).rowsBetween(Window.unboundedPreceding, -1)
    told = F.last(F.when(F.col("_fact"), F.col("_v")), ignorenulls=True).over(w)
    return both.withColumn("_told", told).filter(~F.col("_fact")).select(*names, F.col("_told").alias(value))


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], *, at: Column, start: str, end: str, tie: str, width: int = 64) -> DataFrame:
    """``points`` with the span of equal keys that encloses ``at`` most closely, ties by ``tie``; points outside all spans go.

    A range join as an equi-join: spans are listed under every stretch of
    ``width`` that they touch, points under their own.
    """
    listed = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    each = points.groupBy(*points.columns).agg(F.count("*").alias("_copies"))  # equal points are looked up once
    asked = each.withColumns({"_at": at, "_bin": F.floor(at / width)})
    met = asked.join(listed, [*keys, "_bin"]).filter((F.col(start) <= F.col("_at")) & (F.col("_at") <= F.col(end)))
    order = Window.partitionBy(*points.columns).orderBy(F.col(end) - F.col(start), tie)
    best = met.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return best.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_n", "_bin", "_at", "_copies")


def capped(rows: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group, and ``cap_hit``: whether it has more."""
    w = Window.partitionBy(*by)
    out = rows.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "cap_hit": F.count("*").over(w) > cap})
    return out.filter(F.col("_n") <= cap).withColumnRenamed("_n", "place")
