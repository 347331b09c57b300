"""BPE encoding and decoding with tree concatenation.

For vocabularies whose pre-tokenizer drops blanks. A whole text is halved down to
leaves, wherever the middle falls, in a word or not. All leaves of a portion are
encoded together, and neighbours are concatenated level by level. At each join a
window of runs (what lies between ASCII blanks, which no token spans) on either
side is encoded anew, as one text; it grows until its first ids are those of its
outermost run on the left and its last ids those of the one on the right, or it
reaches the ends. Runs that recur are encoded once and remembered.

A run longer than a leaf is not halved with its text. It is normalised and
pre-tokenized, and each long pre-token is a tree of its own, whose windows are
counted in tokens: at a join they grow until the first token is the left side's
and a later one the right side's. The result has only pairs of neighbouring
tokens that occur in some encoding, which makes it the encoding of the whole.

Defined results: a null text is empty; an empty text has no tokens and decodes
to the empty string; texts of any length are encoded whole; repeated rows are
encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a leaf of a text, characters of a leaf of a long pre-token, and runs on either side of a join's first window.
LEAF, RUNS = 1024, 2
#: Encoded runs that a worker remembers, at about 300 bytes each, and the longest of them in bytes.
REMEMBERED, LONGEST = 300_000, 64
#: A stop or comma that ends a run after a letter or digit; a pre-token of its own there.
CLOSING = re.compile(rb"(?<=[A-Za-z0-9])([.,])(?=[\x20\x09-\x0D]|$)")
#: What tells runs apart, as blanks.
BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")
#: Bytes of text that are handled at once.
PORTION = 4 << 20


class TreeEncoder:
    """Encodes with the vocabulary in a tokenizers file."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.leaf = leaf
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        #: The same merges, without any work on the text before them.
        self.core = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "truncation": None, "padding": None, "added_tokens": []}))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        #: Each id in digits and its token.
        n = max(self.full.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.digits, self.names = [str(i) for i in range(n)], [self.full.id_to_token(i) for i in range(n)]
        ids = lambda t: self.full.encode(t, add_special_tokens=False).ids
        self.lowers = ids("QzJ KIT") == ids("qzj kit")
        self.closes = all(ids(f"ab{c}") == ids(f"ab {c}") and ids(f"1{c}") == ids(f"1 {c}") for c in ".,")

    def tree(self, token: str) -> list[int]:
        """Ids of one pre-token."""
        parts = [token]
        while len(parts[0]) > self.leaf:
            parts = [half for p in parts for half in (p[: len(p) // 2], p[len(p) // 2 :])]
        done = [(p, e.ids, [b - a for a, b in e.offsets]) for p, e in zip(parts, self.core.encode_batch(parts, add_special_tokens=False), strict=True)]
        while len(done) > 1:
            done = [self.join(a, b) for a, b in zip(done[::2], done[1::2], strict=True)]
        return done[0][1]

    def join(self, left: tuple, right: tuple) -> tuple[str, list[int], list[int]]:
        """Concatenates two encoded texts (text, ids, lengths), each encoded as if it stood alone."""
        (text_l, ids_l, len_l), (text_r, ids_r, len_r) = left, right
        k = 4
        while True:
            i, j = max(0, len(ids_l) - k), min(len(ids_r), k)
            before, after = sum(len_l[i:]), sum(len_r[:j])
            e = self.core.encode(text_l[len(text_l) - before :] + text_r[:after], add_special_tokens=False)
            ids, lens = e.ids, [b - a for a, b in e.offsets]
            # the last token of the left side and of a window inside the right one end a word only there
            if i == 0 or (ids[0] == ids_l[i] and i < len(ids_l) - 1):
                if j == len(ids_r):
                    return text_l + text_r, ids_l[:i] + ids, len_l[:i] + lens
                starts, at = {}, before
                for q in range(j):
                    starts[at] = q
                    at += len_r[q]
                at = 0
                for m in range(len(ids) - 1):
                    q = starts.get(at) if m else None
                    if q is not None and ids_r[q] == ids[m] and len_r[q] == lens[m]:
                        return text_l + text_r, ids_l[:i] + ids[:m] + ids_r[q:], len_l[:i] + lens[:m] + len_r[q:]
                    at += lens[m]
            k *= 2

    def long_run(self, text: str) -> list[int]:
        """Ids of a text longer than a leaf."""
        out: list[int] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.full.token_to_id(part))
                continue
            flat = self.full.normalizer.normalize_str(part) if self.full.normalizer else part
            tokens = [t for t, _ in self.full.pre_tokenizer.pre_tokenize_str(flat)] if flat else []
            short = iter(self.core.encode_batch([t for t in tokens if len(t) <= self.leaf], add_special_tokens=False))
            for t in tokens:
                out += next(short).ids if len(t) <= self.leaf else self.tree(t)
        return out

    def runs(self, wanted: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """For each run of characters between blanks: its ids and its tokens, each joined by blanks."""
        short = [w for w in wanted if len(w) <= self.leaf]
        ids = dict(zip(short, (e.ids for e in self.full.encode_batch_fast([w.decode() for w in short], add_special_tokens=False)), strict=True))
        ids |= {w: self.long_run(w.decode()) for w in wanted if len(w) > self.leaf}
        return {w: self.told(x) for w, x in ids.items()}

    def told(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids and their tokens, each joined by blanks."""
        if len(ids) == 1:
            return self.digits[ids[0]].encode(), self.names[ids[0]].encode()
        return " ".join([self.digits[i] for i in ids]).encode(), self.decode(ids).encode()

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by blanks, special ones included: what the library does for a vocabulary without a decoder."""
        return " ".join([self.names[i] for i in ids])

    def plain(self, body: bytes) -> bytes:
        """A text with blanks alone between runs, and with what the vocabulary treats alike made equal, so that fewer runs are new.

        Closing stops and commas are cut off where they are pre-tokens anyway.
        Capitals go where the whole text is ASCII, so that no mark joins a letter,
        and nothing in it can become a special token.
        """
        if self.lowers and body.isascii() and b"<" not in body:
            body = body.lower()
        return (CLOSING.sub(rb" \1", body) if self.closes else body).translate(BLANKS)

    def middle(self, body: bytes, a: int, b: int) -> int:
        """Where to halve a part of a text: the middle, or the nearer end of a run that is longer than a leaf; the start if there is no such place."""
        at = (a + b) // 2
        while at < b and body[at] & 0xC0 == 0x80:  # not inside a character
            at += 1
        first = body.rfind(b" ", max(a, at - self.leaf), at) + 1 or (a if at - a <= self.leaf else 0)
        last = body.find(b" ", at, at + self.leaf)
        last = last if last >= 0 else b if b - at <= self.leaf else -1
        if first >= a and last >= 0 and (first or a == 0) and last - first <= self.leaf:
            return at
        ends = [x for x in (body.rfind(b" ", a, at) + 1, body.find(b" ", at, b)) if a < x < b]
        return min(ends, key=lambda x: abs(x - at), default=a)

    def leaves(self, body: bytes) -> list[tuple[int, int]]:
        """The leaves of a text, halved down evenly, so that neighbours meet level by level."""
        parts = [(0, len(body))]
        while any(b - a > self.leaf for a, b in parts):
            halved = []
            for a, b in parts:
                at = self.middle(body, a, b) if b - a > self.leaf else a
                halved += [(a, at), (at, b)] if at > a else [(a, b)]
            if len(halved) == len(parts):
                break
            parts = halved
        return parts

    def encoded(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and tokens, each joined by blanks, of texts that are encoded as they are."""
        found = self.full.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [self.told(e.ids) for e in found]

    def concatenate(self, pairs: list[tuple[list[bytes], list[bytes], bool]], known: dict, once: dict) -> list[list[bytes]]:
        """Joins pairs of parts (runs, runs, whether the last and the first touch), whose runs are in one of the tables; windows are added to ``once``."""
        ids = lambda w: (known.get(w) or once[w])[0]
        done: list[list[bytes] | None] = [None] * len(pairs)
        todo, k = [i for i, (left, right, _) in enumerate(pairs)], RUNS
        while todo:
            windows = []
            for n in todo:
                left, right, touch = pairs[n]
                windows.append(b" ".join(left[-k:]) + (b"" if touch else b" ") + b" ".join(right[:k]))
            grown = []
            for n, window, told in zip(todo, windows, self.encoded(windows), strict=True):
                left, right, _ = pairs[n]
                i, j = len(left) - k, k
                from_left = i <= 0 or (k > 1 and (told[0] + b" ").startswith(ids(left[i]) + b" "))
                to_right = j >= len(right) or (k > 1 and (b" " + told[0]).endswith(b" " + ids(right[j - 1])))
                if from_left and to_right:
                    once[window] = told
                    done[n] = left[: max(0, i)] + [window] + right[j:]
                else:
                    grown.append(n)
            todo, k = grown, 2 * k
        return done

    def texts(self, bodies: list[bytes]) -> Iterator[tuple[bytes, bytes, int]]:
        """Ids and decoded text of each whole text, and the joins it took."""
        bodies = [self.plain(b) for b in bodies]
        each = [self.leaves(b) for b in bodies]
        nodes = [[(body[a:b].split(), a, b) for a, b in leaves] for body, leaves in zip(bodies, each, strict=True)]
        seen = set().union(*[ws for parts in nodes for ws, _, _ in parts])
        unknown = seen.difference(self.known)
        if len(self.known) + len(unknown) > REMEMBERED:
            self.known = {w: x for w in seen if (x := self.known.get(w))}
        new = self.runs(list(unknown))
        known = self.known
        known.update((w, x) for w, x in new.items() if len(w) <= LONGEST)
        once = {w: x for w, x in new.items() if len(w) > LONGEST}  # long runs and windows aren't remembered
        while any(len(parts) > 1 for parts in nodes):
            pairs = []
            for body, parts in zip(bodies, nodes, strict=True):
                for left, right in zip(parts[::2], parts[1::2]):  # noqa: B905
                    if left[0] and right[0]:
                            pairs.append((left[0], right[0], body[left[2] - 1] != 32 and body[right[1]] != 32))
            joined = iter(self.concatenate(pairs, known, once))
            for parts in nodes:
                up = [(next(joined) if left[0] and right[0] else left[0] + right[0], left[1], right[2]) for left, right in zip(parts[::2], parts[1::2])]  # noqa: B905
                parts[:] = up + parts[2 * len(up) :]
        told = (known | once).__getitem__
        for parts, leaves in zip(nodes, each, strict=True):
            found = list(map(told, parts[0][0]))
            ids = [x[0] for x in found]
            if b"" in ids:  # runs without tokens
                found = [x for x in found if x[0]]
                ids = [x[0] for x in found]
            yield b" ".join(ids), b" ".join([x[1] for x in found]), len(leaves) - 1


_encoders: dict[tuple[str, int], TreeEncoder] = {}


def encoder(path: str, leaf: int = LEAF) -> TreeEncoder:
    """One encoder for a process, with what it remembers."""
    if (path, leaf) not in _encoders:
        _encoders[path, leaf] = TreeEncoder(path, leaf)
    return _encoders[path, leaf]


def _mapped(docs: DataFrame, doc_id: str, text: str, path: str, leaf: int, schema: str, row: Callable[[bytes, bytes, int], tuple]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        kinds = None
        for b in batches:
            bodies, at = b.column("text"), 0
            while at < len(bodies):
                part, held = [], 0
                while at + len(part) < len(bodies) and held < PORTION:
                    part.append(bodies[at + len(part)].as_py() or b"")
                    held += len(part[-1])
                columns = list(zip(*[row(*x) for x in enc.texts(part)], strict=True))
                kinds = kinds or [pa.list_(pa.int32()) if isinstance(c[0], list) else pa.string() if isinstance(c[0], str) else pa.int64() for c in columns]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)
                at += len(part)

    names = [x.split(" ")[0] for x in schema.split(", ")]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, ids, decoded."""
    return _mapped(docs, doc_id, text, path, leaf, "doc_id long, ids array<int>, decoded string", lambda ids, back, _: ([int(x) for x in ids.split()], back.decode()))


def digests(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode() gives, without moving it, and n_joins, the joins of the text's tree."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, doc_id, text, path, leaf, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long", lambda ids, back, joins: (ids.count(b" ") + 1 if ids else 0, sha(ids), sha(back), joins))


def counts(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id and n_tokens of every row."""
    return _mapped(docs, doc_id, text, path, leaf, "doc_id long, n_tokens long", lambda ids, back, joins: (ids.count(b" ") + 1 if ids else 0,))
