"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits, each set if over half of the text's shingle hashes
have it. Fingerprints at Hamming distance 3 or less are linked. Half the radius
is 1.5: one bit is met by variants, the half bit by leaving out a third of the
fingerprint. For each third, every distinct fingerprint emits the rest of its
bits as they are and with each single bit flipped (132 variants in all), and the
variants are shuffled. Two fingerprints with 3 or fewer differing bits meet
under a variant in one of these ways, and those that meet so are close enough:

* same variant and same left-out bits: they differ in 2 bits at most;
* same variant, left-out bits that differ in one: 3 at most;
* same unflipped rest, left-out bits within 3.

Within a variant the second and third case are found by flipping left-out bits
and looking the result up, never by comparing all pairs, and every link is
verified. A variant's members are links of a star, so that a dense group costs
rows in proportion to its fingerprints. Copies share a fingerprint and count once.

Where texts are to be alike by the Jaccard similarity of their shingle sets (see
``keep_similar``), one fingerprint's small radius reaches few edited copies, so a
set has many short ones, its keys. Two sets at similarity 0.8 differ in a bit with
probability 0.15. Each key emits its variants of up to one flipped bit, half of
the radius 2, and ``keys_for`` says how many keys leave at most the share MISSED
of pairs at 0.8 without a meeting. A node that is shuffled with a variant holds a
48-bit fingerprint of its own, the set's size class and 8 bits of its hash: of
nodes that meet, only those within CHECK_RADIUS and of sizes that the similarity
allows are candidates, and each candidate pair of sets is verified by its
similarity, if all their bits allow it. A node with
up to CROWD near ones under a variant is compared with each. Those with more are a
crowd, whose members near its head, a node next to their bits' majority, are compared
with that alone; those that aren't make crowds of their own. Members of crowds that end in different components are then joined by
their rare shingles, of which any two similar sets share one (see ``_sharing``), so
that texts over one boilerplate don't meet each other by that.

Defined results: a null or empty text, or one of blanks, has fingerprint 0 and
links like any other, and such texts are copies of each other by similarity; a
text of fewer words than a shingle is one shingle; a null id stays in its component, whose id is its least
known id; repeated rows share a component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

RADIUS = 3
SEED = 42
#: Rows with a variant that a task looks at together; a variant's rows are never parted.
PORTION = 1 << 18
#: (first bit, bits) of the thirds that are left out in turn.
THIRDS = ((0, 21), (21, 21), (42, 22))


def shingle_hashes(text: bytes | None, width: int) -> list[int]:
    """Hashes of a text's shingles in order; a text of fewer words is one shingle, one without words has none."""
    flat = b" ".join((text or b"").lower().split())  # both treat ASCII alone
    if not flat:
        return []
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    if len(gaps) < width:
        return [xxhash.xxh64_intdigest(flat, SEED)]
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(flat)]
    return [xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]  # noqa: B905


def fingerprint(text: bytes | None, width: int) -> int:
    """Fingerprint of a whole text, signed."""
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) of every row; fp is a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), width) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), fps], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, text_key long, fp long"), "fingerprints")


def _variants() -> Column:
    """All variant keys of ``fp``: which third is left out, then the rest of the bits."""
    keys = []
    for k, (at, bits) in enumerate(THIRDS):
        turned = f"(shiftrightunsigned(fp, {at}) | shiftleft(fp, {64 - at}))" if at else "fp"
        rest = f"shiftrightunsigned({turned}, {bits})"
        tag = f"({k}L * {1 << 43}L)"
        keys.append(f"transform(sequence(-1, {63 - bits}), b -> ({rest} ^ if(b < 0, 0L, shiftleft(1L, b))) | {tag})")
    return F.expr(f"concat({', '.join(keys)})")


def _met(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key, whole keys only."""
    same = key[1:] == key[:-1]
    with_others = np.append(same, False) | np.insert(same, 0, False)
    key, fp = key[with_others], fp[with_others]
    if not len(key):
        return fp[:0], fp[:0]
    third = (key >> 43).astype(np.int64)
    at, bits = (np.array(x, np.uint64)[third] for x in zip(*THIRDS, strict=True))
    turned = np.where(at > 0, (fp >> at) | (fp << (np.uint64(64) - at) % np.uint64(64)), fp)
    left_out = turned & ((np.uint64(1) << bits) - np.uint64(1))
    plain = (turned >> bits) == (key & np.uint64((1 << 43) - 1))
    group = np.cumsum(np.insert(key[1:] != key[:-1], 0, False)).astype(np.uint64) << np.uint64(22)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def star(spot: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links rows of one spot to the first; gives the spots and their first rows."""
        order = np.lexsort((who, spot))
        spot, who = spot[order], who[order]
        first = np.insert(spot[1:] != spot[:-1], 0, True)
        spots, heads = spot[first], who[first]
        pairs.append((who, heads[np.cumsum(first) - 1]))
        return spots, heads

    def across(spots: np.ndarray, heads: np.ndarray) -> None:
        """Links the heads of spots that differ in one left-out bit."""
        for b in range(22):
            flipped = spots ^ np.uint64(1 << b)
            upper = flipped > spots
            k = np.minimum(np.searchsorted(spots, flipped[upper]), len(spots) - 1)
            hit = spots[k] == flipped[upper]
            pairs.append((heads[upper][hit], heads[k[hit]]))

    across(*star(group | left_out, fp))
    rest, own, who = group[plain], left_out[plain], fp[plain]
    if len(rest):
        again = rest[1:] == rest[:-1]
        several = np.append(again, False) | np.insert(again, 0, False)
        rest, own, who = rest[several], own[several], who[several]
        if len(rest):
            flips = np.append(np.uint64(1) << np.arange(22, dtype=np.uint64), np.uint64(0))
            across(*star((rest[:, None] | (own[:, None] ^ flips)).ravel(), np.repeat(who, len(flips))))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    near = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    return a[near], b[near]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the given ones: what their components need."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    kept: tuple[list[int], list[int]] = [], []
    both = np.unique(ends.reshape(2, -1), axis=1)
    for x, y in zip(*both.tolist(), strict=True):
        p, q = x, y
        while up[p] != p:
            up[p] = p = up[up[p]]
        while up[q] != q:
            up[q] = q = up[up[q]]
        if p != q:
            up[p] = q
            kept[0].append(x)
            kept[1].append(y)
    signed = nodes.view(np.int64)
    return signed[kept[0]].tolist(), signed[kept[1]].tolist()


def _whole_keys(batches: Iterable[pa.RecordBatch], value: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches sorted by key, gathered so that no key is in two portions: (keys, values), unsigned."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("key").to_numpy().view(np.uint64), batch.column(value).to_numpy().view(np.uint64)))
            count += batch.num_rows
        if count > PORTION and held[0][0][0] != held[-1][0][-1]:
            key, fp = gathered()
            cut = np.searchsorted(key, key[-1])  # the last key may go on
            held, count = [(key[cut:], fp[cut:])], len(key) - cut
            yield key[:cut], fp[:cut]
    if held:
        yield gathered()


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within the radius."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _whole_keys(batches, "fp"):
            a, b = _met(key, fp)
            x, y = _forest(a, b) if len(a) else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    # distinct fingerprints are few bytes: without a number of partitions of their own, few tasks would make all variants
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    met = distinct.select(F.explode(_variants()).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(run, "a long, b long")


def groups(prints: DataFrame) -> DataFrame:
    """(fp, root, low): each distinct fingerprint, its component, and the component's least id."""
    each = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-ids")
    parts = components(links(each.select("fp")))
    rooted = materialize(each.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"), "fingerprint-roots")
    lows = materialize(rooted.groupBy("root").agg(F.min("low").alias("low")), "fingerprint-lows")  # as a table: a giant component's join can be split
    return rooted.drop("low").join(lows, "root").select("fp", "root", "low")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, text_key, fp, root, component_id for every row of ``docs``."""
    prints = fingerprints(docs, doc_id=doc_id, text=text, width=width)
    return prints.join(groups(prints), "fp").select("doc_id", "text_key", "fp", "root", F.col("low").alias("component_id"))


#: Words of a shingle and similarity of near copies; bits of a key; share of pairs at that similarity that may miss each other.
WIDTH, SIMILAR = 5, 0.8
KEY_BITS, MISSED = 24, 0.005
CHECK_BITS, CHECK_RADIUS = 48, 15
#: Standard deviations; at the similarity itself a pair is beyond with probability 0.005, at 0.82 with 0.0003.
SPREAD = 2.6
#: A size class is a tenth larger than the one before.
SIZE_STEP = 1.1
#: Near nodes under a variant that a node is compared with, and nodes whose nearness is looked up each with each.
CROWD, LISTED = 4, 64
#: Heads that a member of crowds is compared with.
HEADS = 16
#: Numbers of the table by which shingles of crowds are put in order, and sets that are handled at once.
BUCKETS, AT_ONCE = 1 << 14, 256
SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)


def key_bits(rows: int) -> int:
    """Bits of a key: with the logarithm of the rows, so that the nodes that meet by chance stay as few."""
    return max(KEY_BITS, math.ceil(math.log2(max(rows, 1))) + 4)


def _flips(similar: float) -> float:
    """Chance that a bit differs between two sets of one size and the similarity: their angle, as a share of a half turn."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def keys_for(bits: int, similar: float = SIMILAR, missed: float = MISSED) -> int:
    """Keys of ``bits`` bits that a set needs for two at the similarity to meet under one, but for the share ``missed``."""
    p = _flips(similar)
    within = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return math.ceil(math.log(missed) / math.log(1 - within))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def signature(hashes: np.ndarray, longs: int) -> np.ndarray:
    """64 bits for each of the ``longs`` salts: set where over half of the salted hashes have them."""
    ones = np.zeros(64 * longs, np.int64)
    for k in range(0, len(hashes), 255):  # what a byte can count
        x = hashes[k : k + 255, None] ^ SALTS[:longs]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * ones > len(hashes)


def set_prints(docs: DataFrame, bits: int, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, text_key, set_key, node, keys) of every row."""
    keys = keys_for(bits, similar)
    longs = -(-(CHECK_BITS + keys * bits) // 64)
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, nodes, own = [], [], []
            for t in b.column("text"):
                hashes = shingle_set(t.as_py(), width)
                told = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
                sign = signature(hashes, longs)
                check = int.from_bytes(np.packbits(sign[:CHECK_BITS], bitorder="little").tobytes(), "little")
                sets.append(told)
                size = int(math.log(max(len(hashes), 1)) / math.log(SIZE_STEP))
                nodes.append(check << 16 | min(size, 255) << 8 | told & 0xFF)
                own.append(sign[CHECK_BITS : CHECK_BITS + keys * bits].reshape(keys, bits) @ weights)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * keys, pa.int32()), pa.array(np.concatenate([*own, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), signed(sets), signed(nodes), listed], ["doc_id", "text_key", "set_key", "node", "keys"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, text_key long, set_key long, node long, keys array<long>"), "set-prints")


def _classes(similar: float) -> int:
    """Size classes that sets of the similarity may lie apart."""
    return math.ceil(-math.log(similar) / math.log(SIZE_STEP))


def _close(a: np.ndarray, b: np.ndarray, classes: int) -> np.ndarray:
    size = lambda x: (x >> np.uint64(8) & np.uint64(255)).astype(np.int16)
    return (np.bitwise_count((a ^ b) >> np.uint64(16)) <= CHECK_RADIUS) & (np.abs(size(a) - size(b)) <= classes)


def _alike_sql(a: str, b: str, a_keys: str, b_keys: str, bits: int, similar: float) -> str:
    """Whether all bits that two sets have allow the similarity: SPREAD standard deviations more may differ than do on average there."""
    keys, p = keys_for(bits, similar), _flips(similar)
    n = CHECK_BITS + keys * bits
    differ = " + ".join(f"bit_count({a_keys}[{k}] ^ {b_keys}[{k}])" for k in range(keys))
    return f"bit_count(shiftrightunsigned({a} ^ {b}, 16)) + {differ} <= {n * p + SPREAD * math.sqrt(n * p * (1 - p))}"


def _head(nodes: np.ndarray) -> np.uint64:
    """Of the nodes next to the majority of the nodes' bits one that other crowds choose too: the least under one order for all."""
    bits = np.unpackbits((nodes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(nodes), bitorder="little").view("<u8")[0]
    far = np.bitwise_count((nodes >> np.uint64(16)) ^ middle)
    central = nodes[far <= far.min() + 2]
    return central[np.argmin(central * np.uint64(0x9E3779B97F4A7C15))]


def _candidates(key: np.ndarray, node: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, kind): pairs of nodes to verify (0), members of crowds near a head b (1), and all members of crowds (2, a = b). Rows come sorted by key, whole keys only."""
    none = (node[:0], node[:0])
    kinds: tuple[list, list, list] = [none], [none], [none]
    begins = np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True))
    sizes = np.diff(np.append(begins, len(key)))
    small = np.repeat(sizes <= CROWD, sizes)
    for step in range(1, CROWD):
        at = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
        a, b = node[at], node[at + step]
        near = _close(a, b, classes)
        kinds[0].append((np.minimum(a, b)[near], np.maximum(a, b)[near]))
    for k in np.flatnonzero(sizes > CROWD):
        rest = np.unique(node[begins[k] : begins[k] + sizes[k]])
        if len(rest) <= LISTED:  # only nodes with many near ones are a crowd
            near = _close(rest[:, None], rest, classes)
            many = near.sum(axis=0) > CROWD + 1
            i, j = np.nonzero(np.triu(near & ~(many[:, None] & many), 1))
            kinds[0].append((rest[i], rest[j]))
            rest = rest[many]
        kinds[2].append((rest, rest))
        while len(rest) > CROWD:
            head = _head(rest)
            near = _close(rest, head, classes)
            kinds[1].append((rest[near], np.full(near.sum(), head)))
            rest = rest[~near]
    each = [np.unique(np.stack([np.concatenate(x) for x in zip(*pairs, strict=True)]), axis=1) for pairs in kinds]
    a, b = np.concatenate(each, axis=1)
    return a, b, np.repeat(np.arange(3, dtype=np.int8), [x.shape[1] for x in each])


def met(sets: DataFrame, bits: int, similar: float = SIMILAR) -> DataFrame:
    """(a, b, kind) from sets (node, keys): see _candidates()."""
    classes = _classes(similar)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node in _whole_keys(batches, "node"):
            a, b, kind = _candidates(key, node, classes)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(kind)], ["a", "b", "kind"])

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = sets.select("node", "keys").repartition(n, "node").select("node", F.posexplode("keys").alias("t", "w")).select("node", F.expr(f"w | shiftleft(cast(t as bigint), {bits})").alias("w"))
    balls = each.select(F.explode(F.array("w", *[F.expr(f"w ^ {1 << b}L") for b in range(bits)])).alias("key"), "node")
    found = balls.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, kind byte")
    return materialize(found.distinct(), "met")


def _shingles(docs: DataFrame, sets: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(set_key, shingles) of the wanted sets, from one text of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [shingle_set(t.as_py(), width).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("set_key"), pa.array(each, pa.list_(pa.int64()))], ["set_key", "shingles"])

    where = materialize(sets.join(wanted, "set_key").select("set_key", F.col("one.i").alias("i"), F.col("one.k").alias("k")), "wanted")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).cast("binary").alias("text"))
    texts = rows.join(where, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_key") == F.col("k"))).dropDuplicates(["set_key"]).select("set_key", "text")
    return materialize(texts.mapInArrow(run, "set_key long, shingles array<long>"), "shingles")


def _verified(pairs: DataFrame, shingles: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of sets that are similar."""
    left, right = (shingles.select(F.col("set_key").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("sa", "sb")))
    return materialize(both.filter(F.col("c") >= similar * (F.size("sa") + F.size("sb") - F.col("c"))).select("a", "b"), "similar")


def _counted(shingles: DataFrame) -> np.ndarray:
    """How many of the sets' shingles fall in each of BUCKETS buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, AT_ONCE):
                total += np.bincount(_bucket(b.column("shingles").slice(k, AT_ONCE).flatten().to_numpy()), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["b", "n"])

    told = shingles.select("shingles").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[told["b"].to_numpy(np.int64)] = told["n"].to_numpy(np.int64)
    return out


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _sharing(shingles: DataFrame, placed: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of sets of different roots that may be similar, none of the similar ones left out.

    Every set's shingles are put into one order, rare ones first. Of two sets with
    the similarity, the smaller one's first n - ceil(2 s n / (1 + s)) + 1 shingles
    and the larger one's first n - ceil(s n) + 1 share one, so sets meet under these
    alone; where they first do, enough shingles must be left in both. Boilerplate
    stands last in the order, so that texts over it don't meet by it. Under a
    shingle, sets of its most frequent root meet those of other roots alone.
    """
    spark = shingles.sparkSession
    counts = spark.sparkContext.broadcast(_counted(shingles))  # BUCKETS numbers; any order is right, this one is short

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(k, AT_ONCE) for part in batches for k in range(0, part.num_rows, AT_ONCE)):
            each = []
            for key, root, own in zip(*(b.column(c).to_pylist() for c in ("set_key", "root")), b.column("shingles"), strict=True):
                own = own.values.to_numpy()
                n = len(own)
                probe, index = (n - math.ceil(x * n - 1e-9) + 1 for x in (similar, 2 * similar / (1 + similar)))
                order = np.lexsort((own, counts.value[_bucket(own)]))[:probe] if n else np.zeros(0, np.int64)
                at = np.arange(len(order))
                each.append((np.full(len(order), key), np.full(len(order), root), np.full(len(order), n), own[order], at, at < index))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*each, strict=True)], ["set_key", "root", "size", "shingle", "at", "index"])

    rows = materialize(shingles.join(placed, "set_key").select("set_key", "root", "shingles").mapInArrow(run, "set_key long, root long, size long, shingle long, at long, index boolean"), "prefixes")
    most = rows.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.bool_or("index").alias("index")).groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.bool_or("index").alias("any"))
    rows = materialize(rows.join(most.filter("roots > 1 and any").drop("roots", "any"), "shingle"), "prefixes")
    side = lambda x: [F.col("shingle"), *[F.col(c).alias(f"{x}_{c}") for c in ("set_key", "root", "size", "at", "index")]]
    both = rows.filter("root <> main").select(*side("l")).join(rows.select(*side("r"), "main"), "shingle")
    need, left = f"{similar / (1 + similar)} * (l_size + r_size) - 1e-9", "least(l_size - l_at, r_size - r_at)"
    smaller = "(l_size < r_size or (l_size = r_size and l_set_key < r_set_key))"
    met = both.filter(f"l_root <> r_root and (r_root = main or l_set_key < r_set_key) and if({smaller}, l_index, r_index) and least(l_size, r_size) >= {similar} * greatest(l_size, r_size) - 1e-9 and {left} >= {need}")
    return met.select(F.least("l_set_key", "r_set_key").alias("a"), F.greatest("l_set_key", "r_set_key").alias("b")).distinct()


def similar_sets(docs: DataFrame, prints: DataFrame, bits: int, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """(set_key, root) of the sets that have a link to another: those of set_prints()."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_key").alias("k"))).alias("one")
    sets = materialize(prints.groupBy("set_key").agg(one, F.first("node").alias("node"), F.first("keys").alias("keys")), "sets")
    meetings = met(sets, bits, similar)
    names = sets.select("node", "set_key", "keys")
    # sets that share all bits of a node
    same = names.groupBy("node").agg(F.min("set_key").alias("b"), F.count("*").alias("n")).filter("n > 1").join(names, "node").select(F.least("set_key", "b").alias("a"), F.greatest("set_key", "b").alias("b")).filter("a <> b")

    def named(pairs: DataFrame) -> DataFrame:
        """Pairs of sets for pairs of nodes, but those that all their bits rule out."""
        name = lambda x: names.select(F.col("node").alias(x), F.col("set_key").alias(f"{x}_key"), F.col("keys").alias(f"{x}_keys"))
        both = pairs.join(name("a"), "a").join(name("b"), "b").filter(_alike_sql("a", "b", "a_keys", "b_keys", bits, similar))
        return both.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct()

    crowded = materialize(meetings.filter("kind = 2").select(F.col("a").alias("node")).distinct(), "crowded")
    # pairs of two members of crowds are found by their shingles, if not through a head
    member = lambda x: crowded.select(F.col("node").alias(x), F.lit(True).alias(f"{x}_in"))
    single = meetings.filter("kind = 0").join(member("a"), "a", "left").join(member("b"), "b", "left").filter("a_in is null or b_in is null").select("a", "b")
    far = F.expr("bit_count(shiftrightunsigned(a ^ b, 16))").alias("far")
    chosen = F.slice(F.array_sort(F.collect_set(F.struct(far, "b"))), 1, HEADS)  # the nearest
    led = meetings.filter("kind = 1 and a <> b").groupBy("a").agg(chosen.alias("b")).select("a", F.explode("b.b").alias("b"))
    plain = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(single).distinct()
    pairs = materialize(named(plain).unionByName(same), "candidates")
    wanted = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()
    linked = _verified(pairs, _shingles(docs, sets, wanted, doc_id, text, width), similar)
    roots = materialize(components(linked), "set-roots").withColumnRenamed("node", "set_key")
    if crowded.isEmpty():
        return roots
    placed = names.join(crowded, "node").join(roots, "set_key", "left").select("set_key", F.coalesce("root", "set_key").alias("root"))
    placed = materialize(placed, "crowds")
    shingles = _shingles(docs, sets, placed.select("set_key"), doc_id, text, width)
    more = materialize(_sharing(shingles, placed, similar).join(pairs, ["a", "b"], "left_anti"), "candidates")
    if more.isEmpty():
        return roots
    return materialize(components(linked.unionByName(_verified(more, shingles, similar))), "set-roots").withColumnRenamed("node", "set_key")


def keep_similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each group of texts linked by the similarity, that of the least id; a null id comes after all others."""
    bits = key_bits(docs.count())
    prints = set_prints(docs, bits, doc_id=doc_id, text=text, width=width, similar=similar)
    roots = similar_sets(docs, prints, bits, doc_id=doc_id, text=text, width=width, similar=similar)
    told = prints.join(roots, "set_key", "left").select("doc_id", "text_key", F.coalesce("root", "set_key").alias("root"))
    return _first_of(docs, told, doc_id, text)


def _first_of(docs: DataFrame, told: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each root: that of the least id, or else of a null one."""
    first = told.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_key").alias("k"))).alias("x")).select(F.col("x.i").alias("_first_id"), F.col("x.k").alias("_first_key"))
    same = docs[doc_id].cast("long").eqNullSafe(first["_first_id"]) & (F.xxhash64(docs[text]) == first["_first_key"])
    return docs.join(first, same).dropDuplicates(["_first_id", "_first_key"]).select(*docs.columns)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with one row of each component of fingerprints, that of the least id."""
    return _first_of(docs, near_duplicates(docs, doc_id=doc_id, text=text, width=width), doc_id, text)
