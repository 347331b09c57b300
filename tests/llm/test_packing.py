import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.llm import packing, queries

from .conftest import SMALL


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_keeps_every_length_in_a_bin_that_fits(lengths):
    lengths.sort(reverse=True)
    caps = (16, 32, 64)
    bins = defaultdict(list)
    for n, (b, size, at) in zip(lengths, packing.best_fit(lengths, caps), strict=True):
        bins[b].append((at, n, size))
    for rows in bins.values():
        rows.sort()
        assert len({size for *_, size in rows}) == 1
        end = 0
        for at, n, _ in rows:
            assert at == end
            end = at + n
        assert end <= rows[0][2] and rows[0][2] == min(c for c in caps if c >= end)


def plain_best_fit(lengths, caps):
    """Variable-capacity best fit by looking at every bin and every capacity."""
    bins, placed = [], []
    for k, n in enumerate(lengths):
        open_ = [(size - fill - n, b) for b, (size, fill) in enumerate(bins) if size - fill >= n]
        if open_:
            b = min(open_)[1]
        else:
            left = sum(lengths[k:])
            costs = {c: (64 + c + c * c / 16384) / min(c, left) for c in caps if c >= n}
            size = min(c for c in costs if costs[c] == min(costs.values()))
            b = len(bins)
            bins.append((size, 0))
        placed.append((b, bins[b][1]))
        bins[b] = (bins[b][0], bins[b][1] + n)
    return [(b, min(c for c in caps if c >= bins[b][1]), at) for b, at in placed]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.sampled_from([(16, 32, 64), (64,), (64, 65, 128)]))
def test_best_fit_bin_by_bin(lengths, caps):
    lengths.sort(reverse=True)
    assert packing.best_fit(lengths, caps) == plain_best_fit(lengths, caps)


def test_query_bin_by_bin(spark):
    rows = [(r.doc_id, r.piece, r.length, int(r.bin.split("-")[1]), r.bin_size, r["at"]) for r in queries.op9_best_fit(spark, SMALL).collect()]
    rows.sort(key=lambda r: (-r[2], r[0], r[1]))  # one group at this size
    assert [r[3:] for r in rows] == plain_best_fit([r[2] for r in rows], packing.CAPACITIES)


def test_query_covers_every_token_once(spark):
    want = {r.doc_id: len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    spans, fill = defaultdict(list), defaultdict(list)
    for r in queries.op9_best_fit(spark, SMALL).collect():
        spans[r.doc_id].append((r.start, r.start + r.length))
        fill[r.bin, r.bin_size].append((r["at"], r["at"] + r.length))
    for k, n in want.items():
        at = 0
        for a, b in sorted(spans[k]):
            assert a == at
            at = b
        assert at == n
    for (_, size), x in fill.items():
        x.sort()
        assert all(p[1] == q[0] for p, q in zip(x, x[1:])) and x[0][0] == 0 and x[-1][1] <= size
    used, room = sum(want.values()), sum(size for _, size in fill)
    assert used / room > 0.9


def test_null_empty_and_repeated(spark, make_docs):
    from pyspark.sql import functions as F

    from arbora.llm.common import words

    docs = make_docs([None, "", " \n", "a b", "a b", "w " * 20000], ids=[0, 1, 2, 3, 3, None])
    rows = packing.pack(packing.pieces(docs.withColumn("grp", F.lit(1)), F.size(words(F.col("text"))))).collect()
    assert sorted(r.length for r in rows) == [2, 2, 20000 - 2 * 8192, 8192, 8192]
    assert packing.pack(packing.pieces(docs.limit(0), F.lit(1))).count() == 0


def test_rows_of_one_id_are_dealt_to_groups_of_bounded_size(spark):
    from pyspark.sql import functions as F

    lengths = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 500 + 1)  # half of them are equal throughout
    parts = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), lengths.cast("int").alias("length"))
    packed = packing.pack(parts, group_pieces=500)
    assert sorted(r.length for r in packed.collect()) == sorted(r.length for r in parts.collect())
    groups = [r["count"] for r in packed.groupBy(F.split("bin", "-")[0].alias("grp")).count().collect()]
    assert len(groups) == 12 and max(groups) < 650
