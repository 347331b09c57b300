"""Best-fit packing into bins of several permitted capacities.

Pieces are dealt by a hash into groups of bounded size, which are packed
independently, longest first. A piece goes to the open bin that it leaves
fullest; where none can take it, the bin size of least cost is opened, and at
the end every bin shrinks to the smallest capacity that holds its contents.

Defined results: a null or empty text has no tokens and gives no piece; a text
longer than the largest capacity is cut into pieces of that capacity and a rest;
repeated rows are packed each on its own; a null id is an id, and comes last
among equal lengths, which are taken by id, then by piece; of bins that a piece
leaves equally full the one opened first takes it; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Pieces a group has on average: what bounds a task's memory.
GROUP_PIECES = 20_000
SCHEMA = "doc_id long, piece int, start long, length int, bin string, bin_size int, at int"


def bin_cost(capacity: int, overhead: int = 64) -> float:
    """Cost of a sequence: its slots, attention that grows with its square, and a constant share."""
    return overhead + capacity + capacity * capacity / 16384


def open_size(length: int, left: int, capacities: tuple[int, ...]) -> int:
    """The capacity of least cost for each token it is expected to hold.

    ``left`` is how many tokens are still to be placed, this piece included: a
    larger bin pays only as far as they can fill it.
    """
    return min((c for c in capacities if c >= length), key=lambda c: (bin_cost(c) / min(c, left), c))


def best_fit(lengths: Iterable[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of each length; lengths come longest first."""
    capacities = tuple(sorted(capacities))
    lengths = list(lengths)
    left = sum(lengths)
    room: list[tuple[int, int]] = []  # (space, bin) of the open bins, least space first
    fill: list[int] = []
    size: list[int] = []
    placed = []
    for n in lengths:
        k = bisect_left(room, (n, -1))
        if k < len(room):
            space, b = room.pop(k)
        else:
            b = len(fill)
            fill.append(0)
            size.append(open_size(n, left, capacities))
            space = size[b]
        placed.append((b, fill[b]))
        fill[b] += n
        left -= n
        if space > n:
            insort(room, (space - n, b))
    final = [next(c for c in capacities if c >= f) for f in fill]
    return [(b, final[b], at) for b, at in placed]


def pieces(docs: DataFrame, tokens: Column, *, doc_id: str = "doc_id", largest: int = CAPACITIES[-1]) -> DataFrame:
    """(doc_id, piece, start, length): texts cut at the largest capacity."""
    n = docs.select(F.col(doc_id).cast("long").alias("doc_id"), tokens.cast("long").alias("n")).filter("n > 0")
    cut = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))).alias("piece"))
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).cast("int").alias("length"))


def pack(parts: DataFrame, *, capacities: tuple[int, ...] = CAPACITIES, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs the rows of ``pieces()``: each with its bin, the bin's size and its offset there."""
    parts = materialize(parts.select("doc_id", "piece", "start", "length"), "pieces")  # the texts are read once
    groups = max(1, math.ceil(parts.count() / group_pieces))
    # rows that are equal throughout are numbered, so that no id, null or not, brings its rows to one group
    copies = parts.groupBy("doc_id", "piece", "start", "length").agg(F.count("*").alias("n"))
    each = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    dealt = each.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "length", "copy"), F.lit(groups)).cast("long")).drop("n", "copy")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        rows[["bin", "bin_size", "at"]] = pd.DataFrame(best_fit(rows["length"].tolist(), capacities), index=rows.index, columns=["bin", "bin_size", "at"])
        rows["bin"] = f"{key[0]}-" + rows["bin"].astype(str)
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        return rows[["doc_id", "piece", "start", "length", "bin", "bin_size", "at"]]

    return dealt.groupBy("grp").applyInPandas(run, SCHEMA)
