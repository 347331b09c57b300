"""Ranked lexical search by the Best Position Algorithm.

Documents' occurrences of the queried terms are written once; from them come the
counts of documents, terms and occurrences that scores need. Tasks then take
portions of documents, and search each portion for every item:

* an impact list for each term, largest impact first, and a direct access from a
  document to its impacts and to their positions in the lists;
* sorted access reads the item's lists to a depth that doubles; each new document
  is scored whole by direct accesses, which mark its positions as seen;
* the best position of a list is the last one before which all have been seen. No
  unseen document has a larger impact there, so their sum bounds its score;
* the search of a portion stops once that bound is strictly below the least of
  the task's best documents so far, or the lists are at their ends.

A task keeps the best of each item over its portions and hands on those alone; a
window takes the best of all tasks. Items come in blocks of bounded vocabulary,
one pass over the documents for each, so that a task's terms are bounded.

Defined results: null and empty texts have no terms; an item without terms, or
whose terms occur nowhere, has no rows; scores of 0 are left out; repeated
documents are ranked each, repeated items too; of equal scores the smaller id
goes first, a null id last; an empty table gives no rows; other columns are
ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import materialize

#: A term is a run of ASCII letters, digits and characters beyond ASCII; A-Z lower-cased. In UTF-8 that is a table over bytes.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Documents of an item's answer.
TOP = 20
#: Fixed values of the score: saturation 1.2, length share 0.25, in integers.
SCALE, TF_PART, M_PART, LENGTH = 1_000_000_000, 1000, 12, 25
#: Items, and distinct terms beyond which no further item joins, of a block.
BLOCK_ITEMS, BLOCK_TERMS = 256, 1 << 16
#: Occurrences of a portion, and the first depth of sorted access.
PORTION, DEPTH = 1 << 20, 32


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _count(vocabulary: dict[bytes, int]):
    """Per document: its number of terms, and the queried ones with their counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, found, counts = b.column(0), [], [], []
            for text in b.column(1):
                each = terms(text.as_py() or b"")
                held = {}
                for w, n in Counter(each).items():
                    if (k := vocabulary.get(w)) is not None:
                        held[k] = n
                ns.append(len(each))
                found.append(list(held))
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, f.type) for x, f in zip((ns, found, counts), list(schema)[1:], strict=True))], schema=schema)

    return run


class Portion:
    """Impact lists of some documents, with direct accesses."""

    def __init__(self, n_terms: int, ids: list[int | None], sizes: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        self.ids, self.term, self.impact = ids, term, impact
        self.starts = np.concatenate([[0], np.cumsum(sizes)])  # of a document's occurrences
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.sorted = np.lexsort((self.doc, -impact, term))
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])
        self.place = np.empty(len(term), np.int64)
        self.place[self.sorted] = np.arange(len(term)) - self.lists[term[self.sorted]]  # an occurrence's position in its list

    def accessed(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of documents, each document's together, and where each document's start."""
        size = self.starts[docs + 1] - self.starts[docs]
        first = np.cumsum(size) - size
        return np.repeat(self.starts[docs] - first, size) + np.arange(size.sum()), first

    def search(self, query: dict[int, int], best: list[tuple], depth: int = DEPTH) -> int:
        """Adds to ``best``, a heap of the TOP best so far, documents of this portion; gives the occurrences read by sorted access."""
        lists = [(t, w) for t, w in query.items() if self.lists[t + 1] > self.lists[t] and w > 0]
        if not lists:
            return 0
        slot = np.full(len(self.lists) - 1, -1)
        slot[[t for t, _ in lists]] = np.arange(len(lists))
        weight = np.array([w for _, w in lists], np.int64)
        begin = np.array([self.lists[t] for t, _ in lists])
        ends = np.array([self.lists[t + 1] for t, _ in lists]) - begin
        at = np.concatenate([[0], np.cumsum(ends)])
        seen = np.zeros(at[-1], bool)
        position = np.zeros(len(lists), np.int64)  # the best positions
        known = np.zeros(len(self.ids), bool)
        last = read = 0
        while True:
            rows = np.concatenate([self.sorted[b + min(last, e) : b + min(depth, e)] for b, e in zip(begin, ends, strict=True)])
            read += len(rows)
            docs = np.unique(self.doc[rows])
            docs = docs[~known[docs]]
            if len(docs):
                known[docs] = True
                every, first = self.accessed(docs)
                of = slot[self.term[every]]
                share = np.where(of >= 0, self.impact[every] * weight[of], 0)
                score = np.add.reduceat(share, first)
                hits = of >= 0
                seen[at[of[hits]] + self.place[every[hits]]] = True
                if len(best) == TOP:
                    keep = score >= best[0][0]
                    docs, score = docs[keep], score[keep]
                elif len(docs) > 4 * TOP:
                    keep = score >= np.partition(score, -TOP)[-TOP]
                    docs, score = docs[keep], score[keep]
                for d, s in zip(docs.tolist(), score.tolist(), strict=True):
                    i = self.ids[d]
                    entry = (s, i is not None, -(i or 0), i)
                    if s > 0:
                        heapq.heappush(best, entry) if len(best) < TOP else heapq.heappushpop(best, entry)
            bound = 0
            for k in range(len(lists)):
                p, e = position[k], ends[k]
                if p < e:
                    rest = seen[at[k] + p : at[k] + e]
                    gap = int(rest.argmin())
                    p = position[k] = e if rest[gap] else p + gap
                    if p < e:
                        bound += int(weight[k] * self.impact[self.sorted[begin[k] + p - 1]])
            if bound == 0 or (len(best) == TOP and best[0][0] > bound):
                return read
            last, depth = depth, 2 * depth


def _portions(batches: Iterable[pa.RecordBatch], n_terms: int, n_docs: int, n_all: int) -> Iterator[Portion]:
    ids: list[int | None] = []
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0

    def made() -> Portion:
        size, term, tf, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        m = np.repeat(100 - LENGTH + (LENGTH * n * n_docs) // n_all, size)
        return Portion(n_terms, ids, size, term, (SCALE * tf) // (TF_PART * tf + M_PART * m))

    for b in batches:
        at = 0
        while at < b.num_rows:  # rows up to a portion's bound
            sizes = b.column("term").slice(at).value_lengths().to_numpy()
            take = max(1, int(np.searchsorted(np.cumsum(sizes), PORTION - held, "right")))
            cut = b.slice(at, take)
            ids += cut.column("doc_id").to_pylist()
            parts.append((sizes[:take], cut.column("term").flatten().to_numpy(), cut.column("tf").flatten().to_numpy(), cut.column("n").to_numpy()))
            held, at = held + int(sizes[:take].sum()), at + take
            if held >= PORTION or at < b.num_rows:
                yield made()
                ids, parts, held = [], [], 0
    if parts:
        yield made()


def _search(queries: list[dict[int, int]], n_terms: int, n_docs: int, n_all: int, depth: int):
    """A task's best documents of each query, and what it read for it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        read = [0] * len(queries)
        for portion in _portions(batches, n_terms, n_docs, n_all):
            for k, q in enumerate(queries):
                read[k] += portion.search(q, best[k], depth)
        rows = [(k, s, i, read[k]) for k, found in enumerate(best) for s, _, _, i in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([],) * 4)], names=["query", "score", "doc_id", "read"])

    return run


def _blocks(items: Iterable[Row]) -> Iterator[list[tuple[int | None, Counter]]]:
    block, vocabulary = [], set()
    for item_id, text in items:
        counts = Counter(terms(bytes(text or b"")))
        if not counts:
            continue
        if block and (len(block) >= BLOCK_ITEMS or len(vocabulary | counts.keys()) > BLOCK_TERMS):
            yield block
            block, vocabulary = [], set()
        block.append((item_id, counts))
        vocabulary |= counts.keys()
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The TOP best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score, and the occurrences read by sorted access."""
    spark = docs.sparkSession
    out = []
    for block in _blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).toLocalIterator()):
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, c in block for w in c))}
        counted = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_count(vocabulary), "doc_id long, n long, term array<int>, tf array<long>").filter("n > 0"), "terms")
        n_docs, n_all = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(counted.select(F.explode("term").alias("term")).groupBy("term").count().collect())  # a row for each term of the block at most
        weigh = lambda n: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        queries = [{vocabulary[w]: k * weigh(df[vocabulary[w]]) for w, k in c.items() if vocabulary[w] in df} for _, c in block]
        found = counted.filter(F.size("term") > 0).mapInArrow(_search(queries, len(vocabulary), n_docs, n_all, depth), "query long, score long, doc_id long, read long")
        by = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP)
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "query long, item_id long")
        out.append(top.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score", F.col("read").alias("task_read")))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, task_read long")
    return reduce(DataFrame.unionByName, out)
