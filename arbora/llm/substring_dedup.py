"""Substring dedup by level-wise doubling.

A word is removed if a window of ``window`` consecutive words covers it whose
word sequence also starts anywhere else. Windows are judged at lengths that
double up to the wanted one. At each length below it a window is represented by
one of its subwindows of that length, the one of least hash, so that equal
windows pick equal subwindows and neighbouring windows mostly pick the same
one. A run is a series of windows with one pick; it is a row (pick's hash, hash
of the run's words, where). Then

* a pick that occurs once in the corpus ends its windows: none can be repeated;
* runs with equal words are repeated as a whole, however many copies there are;
* picks whose runs differ are extended to twice the length, once for each
  different run, until at the wanted length each window left is compared itself.

Rows of windows are thus only shuffled where a shorter part is repeated and the
surroundings differ. Counts are aggregated before the shuffle; joins are on
hashes of content, whose hot values Spark splits. The last comparison uses 128
bits of hash.

Defined results: a null or empty text has no words and nothing removed; rows
with equal id and text are copies of each other, so all their windows repeat; a
null id is an id; texts shorter than the window keep all words; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

WINDOW = 35
#: Lengths below the window's; each doubles the one before, and the window at most doubles the last.
LEVELS = (9, 18)
#: Windows that are handled at once: what bounds a task's memory.
CHUNK = 1 << 17
#: Bytes of text whose words are hashed at once.
PORTION = 1 << 20
BASE = 0x9E3779B97F4A7C15
RUN_SCHEMA = "doc_id long, text_key long, p int, n int, h long, span long"
_powers: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(v: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on, doubling the length until it is reached."""
    g, k = _mix(v), 1
    while k < length:
        step = min(k, length - k)  # the last step may overlap
        g = _mix(g[: len(g) - step] * np.uint64(BASE) + (g[step:] ^ np.uint64(k)))
        k += step
    return g


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, CHUNK + 4096), base, np.uint64)]))
        _powers[base] = have
    return have


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of ``width`` hashes from each place on, the first of equals."""
    low = np.uint64((1 << 24) - 1)
    key, k = (g & ~low) | np.arange(len(g), dtype=np.uint64), 1
    while k < width:
        step = min(k, width - k)
        key = np.minimum(key[: len(key) - step], key[step:])
        k += step
    return (key & low).astype(np.int64)


def _runs(v: np.ndarray, alive: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """Runs of the windows that ``alive`` marks by their first words: place, windows, hash of the pick, hash of the run."""
    at = np.flatnonzero(alive)
    g = _grams(v, length)
    pick = _least(g, window - length + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    start, count = at[first], np.diff(np.append(first, len(at)))
    end = start + count + window - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(v) * _power(BASE, len(v))[: len(v)])])
    span = (total[end] - total[start]) * _power(pow(BASE, -1, 1 << 64), len(v))[start]
    return start, count, g[pick[first]], _mix(span + count.astype(np.uint64))


def _parts(sizes: np.ndarray, marks: list | None, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows to look at, in portions: (row, first window, windows)."""
    portion, held = [], 0
    for i, size in enumerate(sizes.tolist()):
        for a, b in [(0, size - window + 1)] if marks is None else marks[i]:
            while a < b:
                n = min(b - a, CHUNK - held)
                portion.append((i, a, n))
                held, a = held + n + window, a + n
                if held >= CHUNK:
                    yield portion
                    portion, held = [], 0
    if portion:
        yield portion


def _portions(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words' hashes in place of the text, for texts of a window at least, a portion of texts at a time; each different word of it is hashed once."""
    for batch in batches:
        text = batch.column("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(text):
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, side="right")) - at)
            part = batch.slice(at, n)
            at += n
            split = pc.ascii_split_whitespace(part.column("text"))
            coded = pc.dictionary_encode(split.flatten())
            code, known = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
            real = np.array([bool(w) for w in known], bool)[code]  # a text that begins or ends with blanks has empty words there
            hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in known), np.int64)[code[real]]
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())])
            bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
            enough = np.diff(bounds) >= window
            hashed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes))
            names = [x for x in part.schema.names if x != "text"]
            out = pa.RecordBatch.from_arrays([*[part.column(x) for x in names], hashed], [*names, "hashes"])
            if enough.any():
                yield out if enough.all() else out.filter(pa.array(enough))


def _level(length: int, window: int, given: bool, last: bool) -> Callable:
    """The task of one level. given: only the windows in ``runs`` are looked at. last: the windows' own hashes come with the runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("hashes")
            value, start = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy().astype(np.int64)
            marks = [[(x["p"], x["p"] + x["n"]) for x in m] for m in batch.column("runs").to_pylist()] if given else None
            for portion in _parts(np.diff(start), marks, window):
                v = np.concatenate([value[start[i] + a : start[i] + a + n + window - 1] for i, a, n in portion])
                n = np.array([x[2] for x in portion])
                begin = np.concatenate([[0], np.cumsum(n + window - 1)])[:-1]
                alive = np.zeros(len(v) + 1, np.int8)
                np.add.at(alive, begin, 1)
                np.add.at(alive, begin + n, -1)
                p, count, h, span = _runs(v, np.cumsum(alive[:-1]) > 0, length, window)
                of = np.searchsorted(begin, p, side="right") - 1
                row = np.array([x[0] for x in portion])[of]
                place = p - begin[of] + np.array([x[1] for x in portion])[of]
                out = [batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row)), pa.array(place, pa.int32()), pa.array(count, pa.int32()), pa.array(h.view(np.int64)), pa.array(span.view(np.int64))]
                names = ["doc_id", "text_key", "p", "n", "h", "span"]
                if last:
                    inner = np.concatenate([np.arange(a, a + c) for a, c in zip(p, count, strict=True)])
                    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    for name, salt in (("a", 0), ("b", 1)):
                        g = _grams(v ^ np.uint64(salt * 0xD1B54A32D192ED03), window)[inner]
                        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(g.view(np.int64))))
                        names.append(name)
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def _same(left: str, right: str) -> str:
    return f"{left}.doc_id <=> {right}.doc_id and {left}.text_key = {right}.text_key"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))


def _of_texts(level: Callable, window: int) -> Callable:
    """A level's task on texts. Their words are split and hashed in it: as arrays of strings they would fill the executor's heap."""
    return lambda batches: level(_portions(batches, window))


def _settled(t: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Of a level's runs: those that are repeated as a whole, one of each kind whose pick is repeated with other surroundings, and the tables that both read. The runs' own table goes."""
    picks = t.groupBy("h").agg(F.count("*").alias("c"), F.min("span").alias("lo"), F.max("span").alias("hi")).filter("c > 1")
    # as a table, so that both sides of the join are plain shuffles, whose hot partitions Spark splits
    picks = materialize(picks.select("h", (F.col("lo") != F.col("hi")).alias("differ")), "picks")
    hit = materialize(t.join(picks, "h"), "runs-met")
    kinds = materialize(hit.filter("differ").groupBy("h", "span").agg(F.count("*").alias("c"), F.min(F.struct(*[x for x in t.columns if x not in ("h", "span")])).alias("one")), "run-kinds")
    release(t, picks)
    twice = hit.filter("not differ").select("doc_id", "text_key", "p", "n").unionByName(hit.filter("differ").join(kinds.filter("c > 1").select("h", "span"), ["h", "span"]).select("doc_id", "text_key", "p", "n"))
    return twice, kinds.select("h", "span", "one.*"), [hit, kinds]


def _found(docs: DataFrame, doc_id: str, text: str, window: int, levels: tuple[int, int]) -> tuple[DataFrame, list[DataFrame]]:
    """What repeated_windows() returns, before it is a table, and the tables that it reads."""
    keyed = _keyed(docs, doc_id, text)
    long_enough = keyed.filter(F.octet_length("text") >= 2 * window - 1)
    t = materialize(long_enough.mapInArrow(_of_texts(_level(levels[0], window, False, False), window), RUN_SCHEMA), "runs")
    twice, other, held = _settled(t)
    alive = other.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("runs"))
    joined = keyed.alias("l").join(alive.hint("shuffle_hash").alias("r"), F.expr(_same("l", "r"))).select("l.*", "r.runs")
    again = materialize(joined.mapInArrow(_of_texts(_level(levels[1], window, True, True), window), RUN_SCHEMA + ", a array<long>, b array<long>"), "runs")
    twice2, other2, held2 = _settled(again)
    each = other2.select("doc_id", "text_key", "p", F.posexplode(F.arrays_zip("a", "b")).alias("k", "w")).select("doc_id", "text_key", (F.col("p") + F.col("k")).alias("p"), "w.a", "w.b")
    each = materialize(each, "windows")
    more = materialize(each.groupBy("a", "b").agg(F.count("*").alias("c")).filter("c > 1").select("a", "b"), "windows-met")
    twice3 = each.join(more, ["a", "b"]).select("doc_id", "text_key", "p", F.lit(1).alias("n"))
    return twice.unionByName(twice2).unionByName(twice3).distinct(), [*held, *held2, each, more]


def repeated_windows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, levels: tuple[int, int] = LEVELS) -> DataFrame:
    """(doc_id, text_key, p, n): the n windows from word p on are repeated. Rows may overlap."""
    found, read = _found(docs, doc_id, text, window, levels)
    found = materialize(found, "windows-found")
    release(*read)
    return found


def strip(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``docs`` without the words that repeated windows cover.

    A text that loses words is its kept words, joined by one space; others stay
    as they are. digest: doc_id, n_words, n_removed, kept_sha256 instead.
    """
    gone, read = _found(docs, doc_id, text, window, LEVELS)
    spans = materialize(gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("runs")), "repeated")
    release(*read)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("runs").alias("_runs"))
    rows = docs.withColumn("_text", F.col(text).cast("binary"))
    rows = rows.select(F.col(doc_id).cast("long").alias("doc_id"), text, "_text") if digest else rows
    same = rows[doc_id if not digest else "doc_id"].cast("long").eqNullSafe(spans["_id"]) & (F.xxhash64(rows[text]) == spans["_key"])
    joined = rows.join(spans.hint("shuffle_hash"), same, "left").drop("_id", "_key")

    def kept(body: bytes | None, runs: list | None) -> tuple[int, list[bytes]]:
        have = (body or b"").split()
        if not runs:
            return len(have), have
        cover = np.zeros(len(have) + 1, np.int32)
        for x in runs:
            cover[x["p"]] += 1
            cover[x["p"] + x["n"] + window - 1] -= 1
        return len(have), [have[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for n, k in (kept(t.as_py(), r.as_py()) for t, r in zip(b.column("_text"), b.column("_runs"), strict=True))]
            n, gone, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    if digest:
        return joined.select("doc_id", "_text", "_runs").mapInArrow(digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            at = b.schema.get_field_index(text)
            new = [b" ".join(kept(t.as_py(), r.as_py())[1]).decode() if r.is_valid else b.column(at)[i].as_py() for i, (t, r) in enumerate(zip(b.column("_text"), b.column("_runs"), strict=True))]
            columns = [pa.array(new, pa.string()) if name == text else b.column(k) for k, name in enumerate(b.schema.names) if name not in ("_text", "_runs")]
            yield pa.RecordBatch.from_arrays(columns, [x for x in b.schema.names if x not in ("_text", "_runs")])

    return joined.mapInArrow(texts, docs.schema)
