"""Approximate nearest neighbours by largest inner product: an inverted file of product-quantised residuals.

The index is fitted on a bounded sample (FIT_ROWS rows, those of least hash):
coarse centroids, a codebook for each slice of the residuals, and how many cells
to probe first, the least number whose recall for TUNE_QUERIES of the queries
reaches TUNED_RECALL on the sample. Every distinct vector is then put into its
cell and encoded, with the error of its code. Cells are gathered or split into
blocks of about BLOCK_ROWS vectors; a query goes to the blocks of its nearest
cells and is scored there by asymmetric distance tables. The best RERANK of a
block get exact inner products in double precision, and so does every other
vector that could reach the best of them by its score and the error of its code.
A second round visits the cells left out that could hold a better answer by
their centre and the distance of their farthest vector. Both bounds are those of
Cauchy and Schwarz, so no answer is lost, whatever the rows; where vectors have
no structure, they leave out little. Blocks with many queries are copied for
every BLOCK_QUERIES of them, so a task holds one block and one set of queries.

The index holds vectors divided by their largest component, and compares
directions of queries, so that single precision is enough for it at any
magnitude; each code's error includes the rounding.

Copies of a vector count once: with the least ids of each kept, as many as an
answer can need, copies add no work and lose no answer.

Defined results: vectors that are null, empty, zero, of another length than
most of the sample, or that hold null or non-finite components take no part,
neither as queries nor as answers; rows with equal id and vector count once; rows
of one id with different vectors are queries of their own, told apart by query_key,
a hash of the vector, and none of them is an answer to another; a
null id takes no part; ties go to the smaller id; a query with fewer candidates
gets all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FIT_ROWS, TUNE_QUERIES, TUNED_RECALL = 20_000, 256, 0.97
MOST_CELLS, SLICES, CODES = 1024, 16, 256
BLOCK_ROWS, BLOCK_QUERIES, RERANK = 4096, 1024, 96
#: Distinct vectors that a query's cells must hold between them, so that no answer comes out short.
LEAST_FOUND = 64


@dataclass
class Model:
    """What is fitted: broadcast to tasks, 4 * (MOST_CELLS + CODES) numbers for each component at most."""

    centres: np.ndarray
    books: np.ndarray  # slices x codes x components of a slice
    probes: int


def _k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def fit(sample: np.ndarray, rows: int, k: int = 20, asked: np.ndarray | None = None) -> Model:
    """Fits to a sample of ``rows`` distinct vectors. asked: some of the queries; without them, rows of the sample stand in."""
    cells = min(MOST_CELLS, len(sample) // 8, int(2 * rows**0.5))
    centres = _k_means(sample, max(1, cells))
    own = _nearest(sample, centres)
    left, d = sample - centres[own], sample.shape[1]
    width = -(-d // SLICES)
    left = np.pad(left, ((0, 0), (0, SLICES * width - d)))
    books = np.zeros((SLICES, CODES, width), np.float32)
    for s in range(SLICES):
        book = _k_means(left[:, s * width : (s + 1) * width], CODES, rounds=8)
        books[s, : len(book)], books[s, len(book) :] = book, book[-1]
    if asked is None or not len(asked):
        asked = sample[np.random.default_rng(3).choice(len(sample), min(TUNE_QUERIES, len(sample)), replace=False)]
    scores = asked @ sample.T
    at = {x.tobytes(): i for i, x in enumerate(sample)}
    for i, x in enumerate(asked):  # a query is no answer to itself
        if x.tobytes() in at:
            scores[i, at[x.tobytes()]] = -np.inf
    top = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    met = np.sort(np.take_along_axis(rank, own[top], axis=1).ravel()) if top.size else np.zeros(1, np.int64)
    probes = int(met[min(len(met) - 1, int(np.ceil(TUNED_RECALL * len(met))))]) + 1
    return Model(centres.astype(np.float32), books, min(probes, len(centres)))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _directions(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries divided by their largest component, and those."""
    size = np.abs(q).max(axis=1).astype(np.float64)
    return q / size[:, None], size


def _encode(x: np.ndarray, m: Model) -> tuple[np.ndarray, ...]:
    """Cell, code, and error of the score by them for a query of length 1, of vectors as the index holds them; their distance from the centre."""
    d, width = x.shape[1], m.books.shape[2]
    near = x.astype(np.float32)
    cell = _nearest(near, m.centres)
    left = np.pad(near - m.centres[cell], ((0, 0), (0, SLICES * width - d)))
    code = np.stack([_nearest(left[:, s * width : (s + 1) * width], m.books[s]) for s in range(SLICES)], axis=1).astype(np.uint8)
    told = np.concatenate([m.books[s][code[:, s]] for s in range(SLICES)], axis=1)[:, :d].astype(np.float64)
    off = x - m.centres[cell].astype(np.float64)
    length = lambda v: np.sqrt((v * v).sum(axis=1))
    # what rounding to 24 bits adds: a share of the lengths that are summed up
    rounding = (d + 64) * 2.0**-23 * (length(m.centres[cell].astype(np.float64)) + 4 * length(told))
    return cell, code, (length(off - told) + rounding) * (1 + 1e-6), length(off) * (1 + 1e-6)


def _probed(q: np.ndarray, model: Model, sizes: np.ndarray) -> list[np.ndarray]:
    """Cells of each query: the nearest, and on until they hold enough vectors."""
    order = np.argsort(-(q @ model.centres.T), axis=1, kind="stable")
    enough = (np.cumsum(sizes[order], axis=1) < LEAST_FOUND).sum(axis=1) + 1
    return [row[: max(model.probes, n)] for row, n in zip(order, enough, strict=True)]


def _could(q: np.ndarray, floor: np.ndarray, model: Model, reach: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether a cell could hold a vector that reaches ``floor``, by query and cell. reach, most: of each cell, the largest distance from the centre and the largest length."""
    length = np.sqrt((q * q).sum(axis=1))[:, None]
    bound = np.minimum(q @ model.centres.T.astype(np.float64) + length * reach, length * most)
    return bound + 1e-9 * length * most >= floor[:, None]


def _exact(x: np.ndarray, q: np.ndarray, row: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, some at once."""
    step = max(1, (1 << 22) // x.shape[1])
    parts = [np.einsum("pd,pd->p", x[row[i : i + step]], q[of[i : i + step]]) for i in range(0, len(row), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _best_of(x: np.ndarray, q: np.ndarray, score: np.ndarray, error: np.ndarray, unit: np.ndarray, floor: np.ndarray, rep: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(query, row, inner product) of the ``depth`` best rows for each query, all that are in question by ``score`` and ``error``.

    score: by query and row, of codes, minus infinity where a row is not asked; error: how far it may be off.
    unit: what a score times it is as an inner product. floor: inner products below it are no answers.
    """
    n = min(max(RERANK, depth), score.shape[1])
    first = np.argpartition(-score, n - 1, axis=1)[:, :n]
    of = np.repeat(np.arange(len(q)), n)
    row = first.ravel()
    got = _exact(x, q, row, of)
    got[score[of, row] == -np.inf] = -np.inf
    asked_floor = np.maximum(floor, np.finfo(np.float64).min)
    if n >= depth:
        floor = np.maximum(floor, np.partition(got.reshape(len(q), n), n - depth, axis=1)[:, n - depth])
    open_ = score + error >= (floor / np.maximum(unit, 5e-324) * (1 - 1e-9 * np.sign(floor)))[:, None]
    open_ &= score > -np.inf
    np.put_along_axis(open_, first, False, axis=1)
    more_of, more_row = np.nonzero(open_)
    of, row = np.concatenate([of, more_of]), np.concatenate([row, more_row])
    got = np.concatenate([got, _exact(x, q, more_row, more_of)])
    keep = (got > -np.inf) & (got >= (asked_floor - 1e-12 * np.abs(asked_floor))[of])  # the rest are no answers, and aren't moved
    of, row, got = of[keep], row[keep], got[keep]
    order = np.lexsort((rep[row], -got, of))
    of, row, got = of[order], row[order], got[order]
    keep = np.arange(len(of)) - np.searchsorted(of, of) < depth
    return of[keep], row[keep], got[keep]


def search(table: DataFrame, queries: Column, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, query_key) for the rows of ``table`` that ``queries`` picks (a condition on the column ``vec_id``), against all other rows."""
    spark = table.sparkSession
    single = table.schema[vector].dataType.elementType.typeName() == "float"
    kind, real = ("array<float>", np.float32) if single else ("array<double>", np.float64)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toPandas()["v"]  # bounded by FIT_ROWS
    lengths = sample.map(len)
    d = int(lengths.mode().iloc[0]) if len(sample) else 1
    rows = rows.filter(F.size("v") == d).distinct()
    # the least k + 1 ids of each vector; taken in each task before the shuffle
    held = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    base = materialize(held.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumns({"rep": F.col("ids")[0], "vec": F.xxhash64("v")}), "vectors")
    count, scale = base.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))).cast("double")).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_key long")
    asked = rows.filter(queries).select("vec_id", "v")
    tried = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TUNE_QUERIES).toPandas()["v"]  # bounded by TUNE_QUERIES
    held_as = lambda v: (np.stack(v).astype(np.float64) / scale).astype(np.float32)
    model = fit(np.unique(held_as(sample[lengths == d]), axis=0), count, k, held_as(tried) if len(tried) else None)
    cells = len(model.centres)
    shared = spark.sparkContext.broadcast(model)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), d)
            held = x.astype(np.float64) / scale
            cell, code, error, reach = _encode(held, shared.value)
            length = np.sqrt((held * held).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("vec"), b.column("rep"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(error), pa.array(reach), pa.array(length)], ["vec", "rep", "cell", "code", "x", "error", "reach", "length"])

    index = materialize(base.select("vec", "rep", "v").mapInArrow(assign, "vec long, rep long, cell int, code binary, x binary, error double, reach double, length double"), "ivf")
    sizes, reach, most = np.zeros(cells, np.int64), np.full(cells, -np.inf), np.full(cells, -np.inf)
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach"), F.max("length").alias("length")).collect():  # one row for each cell, MOST_CELLS at most
        sizes[r["cell"]], reach[r["cell"]], most[r["cell"]] = r["n"], r["reach"], r["length"]
    index = index.drop("reach", "length")
    first, parts, block, room = np.zeros(cells, np.int64), np.ones(cells, np.int64), 0, BLOCK_ROWS
    along = np.argsort(model.centres @ np.linalg.svd(model.centres, full_matrices=False)[2][0], kind="stable")
    for c in along:  # cells that lie together share a block; large ones have several
        if sizes[c] > room:
            block, room = block + (room < BLOCK_ROWS), BLOCK_ROWS
        first[c], parts[c] = block, max(1, -(-sizes[c] // BLOCK_ROWS))
        room -= sizes[c]
        if room <= 0:
            block, room = block + int(parts[c]), BLOCK_ROWS
    table_of = lambda a: F.array(*[F.lit(int(v)) for v in a])
    placed = index.withColumn("block", F.get(table_of(first), F.col("cell")) + F.pmod("vec", F.get(table_of(parts), F.col("cell"))).cast("int"))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of the first round."""
        for b in batches:
            x = _matrix(b.column("v"), d)
            near = _probed(_directions(x)[0], shared.value, sizes)
            yield pa.RecordBatch.from_arrays([b.column("vec"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.astype(np.int16).tobytes() for c in near], pa.binary())], ["q", "x", "near"])

    def deal(again: bool):
        """A row for each query and block of its cells; again: of the cells that were not probed and could hold what reaches ``floor``."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: list[tuple] = []
                x = np.frombuffer(b"".join(b.column("x").to_pylist()), real).reshape(-1, d)
                floor = b.column("floor").to_numpy(zero_copy_only=False)
                if again and len(x):
                    q, size = _directions(x)
                    could = _could(q, floor / np.maximum(size * scale, 5e-324), shared.value, reach, most) & (sizes > 0)
                for i, near in enumerate(b.column("near").to_pylist()):
                    chosen = np.frombuffer(near, np.int16)
                    if again:
                        could[i, chosen] = False
                        chosen = np.flatnonzero(could[i])
                    by: dict[int, list[int]] = {}
                    for c in chosen.tolist():
                        for p in range(parts[c]):
                            by.setdefault(int(first[c] + p), []).append(c)
                    found += [(i, at, np.array(cs, np.int16).tobytes()) for at, cs in by.items()]
                who, where, which = zip(*found, strict=True) if found else ((), (), ())
                who = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("q").take(who), pa.array(where, pa.int32()), pa.array(which, pa.binary()), b.column("x").take(who), b.column("floor").take(who)], ["q", "block", "cells", "x", "floor"])

        return run

    # an id's own vectors are no answers to it: one of more vectors needs that much more depth
    own = asked.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    depth = k + own

    def scan(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        out = []
        if len(rows) and len(qs):
            rows = rows.sort_values(["rep", "vec"])
            vec, rep, cell, error = (rows[c].to_numpy() for c in ("vec", "rep", "cell", "error"))
            code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(-1, SLICES)
            x = np.frombuffer(b"".join(rows["x"]), real).reshape(-1, d).astype(np.float64)
            width = m.books.shape[2]
            for at in range(0, len(qs), 256):
                part = qs.iloc[at : at + 256]
                original = np.frombuffer(b"".join(part["x"]), real).reshape(-1, d).astype(np.float64)
                towards, size = _directions(original)
                q = towards.astype(np.float32)
                s = (q @ m.centres.T)[:, cell]
                slices = np.pad(q, ((0, 0), (0, SLICES * width - d))).reshape(len(q), SLICES, width)
                for j in range(SLICES):  # the asymmetric tables: the query's slice against each code
                    s += (slices[:, j] @ m.books[j].T)[:, code[:, j]]
                for i, near in enumerate(part["cells"]):
                    probed = np.zeros(len(m.centres), bool)
                    probed[np.frombuffer(near, np.int16)] = True
                    s[i, ~probed[cell]] = -np.inf
                off = np.sqrt((towards * towards).sum(axis=1))[:, None] * error
                of, found, score = _best_of(x, original, s, off, size * scale, part["floor"].to_numpy(), rep, depth)
                out.append(pd.DataFrame({"q": part["q"].to_numpy()[of], "vec": vec[found], "rep": rep[found], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "vec": [], "rep": [], "score": []})

    def scanned(dealt: DataFrame) -> DataFrame:
        sent = materialize(dealt, "ivf-queries")
        copies = sent.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("copies"))
        left = placed.join(copies, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        right = sent.join(copies, "block").withColumn("part", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int")).drop("copies")
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(scan, "q long, vec long, rep long, score double")

    def leading(near: DataFrame) -> DataFrame:
        return near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep", "vec"))).filter(F.col("n") <= depth).drop("n")

    sent_schema = "q long, block int, cells binary, x binary, floor double"
    asked_vectors = asked.select("v").distinct().join(base.select("v", "vec"), "v")
    probes = materialize(asked_vectors.select("vec", "v").mapInArrow(probe, "q long, x binary, near binary"), "probes")
    nothing = F.lit(float("-inf"))
    near = materialize(leading(scanned(probes.withColumn("floor", nothing).mapInArrow(deal(False), sent_schema))), "found-first")
    floors = near.groupBy("q").agg(F.when(F.count("*") >= depth, F.min("score")).alias("floor"))
    left_out = probes.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", nothing))
    best = leading(near.unionByName(scanned(left_out.mapInArrow(deal(True), sent_schema)))).drop("rep")
    answers = best.join(base.select("vec", "ids"), "vec").select("q", "score", F.explode("ids").alias("vec_id"))
    answers = materialize(answers.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= depth).drop("n"), "answers")
    of = materialize(asked.join(base.select("v", F.col("vec").alias("q")), "v").select(F.col("vec_id").alias("query_id"), "q", F.col("q").alias("query_key")), "queries")
    pairs = of.join(answers, "q").filter("vec_id <> query_id")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")
