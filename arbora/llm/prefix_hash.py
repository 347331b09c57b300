"""Document fingerprints by prefix polynomial hashes.

``H[i]`` is the sum of ``(code + 1) * BASE**j`` over the first ``i`` code points,
modulo a prime, in two lanes. With the array of these, the equality of any two
spans is a subtraction and a multiplication (``PrefixHashes.equal``), and the
longest common extension of two places is found by binary search, since prefixes
of equal spans are equal (``PrefixHashes.extension``). Whole arrays are held for
CHUNK code points at a time; between chunks stand marks from which a chunk's
array is rebuilt, so that memory beside the text doesn't grow with its length.

A fingerprint is a sparse prefix array: length, both lanes of the whole, then one
lane at every multiple of the step from the front, and from the back. The step is
the least power of two that leaves CELLS places at most, so the places of two
fingerprints are nested and can be compared. Equal texts have equal fingerprints.
``likeness`` locates the longest equal front and back by binary search over the
common places: their share of the longer text, 1 for equal fingerprints alone.

Defined results: a null text is empty; the empty text has a fingerprint, like
itself and unlike any other; invalid UTF-8 is replaced by U+FFFD; repeated rows
are neighbours of each other; rows of one id go by a hash of the text; a null id
comes after all others; a lone document is its own next; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Primes below 2**31, so that products fit 64 bits, and a base for each.
MODS = (2147483647, 2147483629)
BASES = (1284865837, 1947293411)
INVERSES = tuple(pow(b, -1, m) for b, m in zip(BASES, MODS, strict=True))
#: Code points whose whole array is held, and places of a fingerprint on each side.
CHUNK, CELLS = 1 << 16, 32
#: Bytes of text after which finished rows are handed on.
PORTION = 1 << 22


def _powers(base: int, mod: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < CHUNK:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), mod)) % np.uint64(mod)])
    return out[:CHUNK]


POWERS = [_powers(b, m) for b, m in zip(BASES, MODS, strict=True)]


class PrefixHashes:
    """Modular prefix arrays of a text."""

    def __init__(self, text: str) -> None:
        self.codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.n = len(self.codes)
        self.marks: list[tuple[int, ...]] = [(0, 0)]
        self.held: tuple[int, list[np.ndarray]] = (-1, [])
        for k in range(0, self.n, CHUNK):
            self.marks.append(tuple(int(a[-1]) for a in self._arrays(k // CHUNK)))

    def _arrays(self, k: int) -> list[np.ndarray]:
        """The prefix arrays at the places of a chunk, from its start to its end."""
        if self.held[0] != k:
            codes = self.codes[k * CHUNK : (k + 1) * CHUNK].astype(np.uint64) + np.uint64(1)
            out = []
            for lane, m in enumerate(MODS):
                mod = np.uint64(m)
                a = np.empty(len(codes) + 1, np.uint64)
                a[0] = 0
                np.cumsum(codes * POWERS[lane][: len(codes)] % mod, out=a[1:])
                if k:
                    a = a % mod * np.uint64(pow(BASES[lane], k * CHUNK, m)) + np.uint64(self.marks[k][lane])
                out.append(a % mod)
            self.held = (k, out)
        return self.held[1]

    def at(self, i: int) -> tuple[int, ...]:
        """Hash of the first ``i`` code points."""
        if i % CHUNK == 0:
            return self.marks[i // CHUNK]
        return tuple(int(a[i % CHUNK]) for a in self._arrays(i // CHUNK))

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """Hash of a span, wherever it stands."""
        return tuple((b - a) * pow(inv, i, m) % m for a, b, inv, m in zip(self.at(i), self.at(j), INVERSES, MODS, strict=True))

    def equal(self, i: int, other: PrefixHashes, k: int, length: int) -> bool:
        """Whether the spans of this length at ``i`` and, in the other text, at ``k`` are equal."""
        mine = zip(self.at(i), self.at(i + length), strict=True)
        its = zip(other.at(k), other.at(k + length), strict=True)
        return all(((b - a) * pow(base, k, m) - (d - c) * pow(base, i, m)) % m == 0 for (a, b), (c, d), base, m in zip(mine, its, BASES, MODS, strict=True))

    def extension(self, i: int, other: PrefixHashes, k: int) -> int:
        """Length of the longest common extension of two places."""
        low, high = 0, min(self.n - i, other.n - k)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, k, mid) else (low, mid - 1)
        return low

    def fingerprint(self) -> str:
        n, step = self.n, _step(self.n)
        places = range(step, n + 1, step)
        front = [self.at(p)[0] for p in places]
        total = self.at(n)
        back = [(total[0] - self.at(n - p)[0]) * pow(INVERSES[0], n - p, MODS[0]) % MODS[0] for p in reversed(places)][::-1]
        return f"{n:012x}" + "".join(f"{h:08x}" for h in (*total, *front, *back))


def _step(n: int) -> int:
    return 1 << max(0, -(-n // CELLS) - 1).bit_length()


def likeness(a: str, b: str) -> float:
    """Equal front and back of two fingerprinted texts as a share of the longer one."""
    if a == b:
        return 1.0
    (n, s), (m, t) = ((k, _step(k)) for k in (int(a[:12], 16), int(b[:12], 16)))
    step, most = max(s, t), max(n, m)
    shared = 0
    for back in (0, 1):
        at = lambda x, k, own, count: x[(y := 28 + 8 * (k * step // own - 1 + back * (count // own))) : y + 8]
        low, high = 0, min(n, m) // step
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if at(a, mid, s, n) == at(b, mid, t, m) else (low, mid - 1)
        shared += low * step
    return min(shared, most - 1) / most


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, KINDS[k]) for n, k in (x.split() for x in schema.split(", "))])


def _row(doc_id: int | None, text: str, own: PrefixHashes, mark: str, after: str, its: PrefixHashes, its_mark: str) -> tuple:
    k = own.n // 3
    edited = text[: own.n - k] + after[:k]
    changed = PrefixHashes(edited)
    changed_mark = changed.fingerprint()
    return (doc_id, own.n, hashlib.sha256(edited.encode()).hexdigest(), mark, changed_mark, likeness(mark, changed_mark), likeness(mark, its_mark), own.extension(0, changed, 0), own.extension(0, its, 0))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: A row of a partition's run: what is finished, or (edge 1) the first row's text, or (2) the last row, which lacks its next.
RUN = SCHEMA + ", pid long, edge long, text string"


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, pid, before, out, held = _arrow(RUN), TaskContext.get().partitionId(), None, [], 0
    blank = (None,) * 8
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            own = PrefixHashes(text)
            now = (doc_id, text, own, own.fingerprint())
            out.append((doc_id, *blank, pid, 1, text) if before is None else (*_row(*before, *now[1:]), pid, 0, None))
            before, held = now, held + len(text)
            if held > PORTION or len(out) >= 4096:
                yield _batch(out, schema)
                out, held = [], 0
    if before is not None:
        yield _batch([*out, (before[0], *blank, pid, 2, before[1])], schema)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(SCHEMA)
    for b in batches:
        for doc_id, text, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own, its = PrefixHashes(text), PrefixHashes(after)
            yield _batch([_row(doc_id, text, own, own.fingerprint(), after, its, its.fingerprint())], schema)


def chain(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edits with the next document's head, by descending id.

    Ranges of ids are sorted in tasks; each text is shuffled once. Only the first
    and last row of a range meet rows of other ranges, by a join on the range.
    """
    body = F.expr(f"make_valid_utf8(coalesce(`{text}`, ''))")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("_h"), F.monotonically_increasing_id().alias("_r"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h"), F.col("_r")]  # a hot id is several ranges
    run = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_runs, RUN), "runs")
    heads = run.filter("edge = 1").select("pid", F.col("text").alias("after"))
    by = Window.orderBy("pid")  # a row for each range
    follows = heads.select("pid").select("pid", F.lead("pid").over(by).alias("next"), F.first("pid").over(by).alias("least")).select("pid", F.coalesce("next", "least").alias("next"))
    last = run.filter("edge = 2").select("doc_id", "text", "pid").join(follows, "pid").alias("l")
    ends = last.join(heads.alias("h"), F.expr("l.next = h.pid")).select("l.doc_id", "l.text", "h.after").mapInArrow(_joined, SCHEMA)
    return run.filter("edge = 0").drop("pid", "edge", "text").unionByName(ends)
