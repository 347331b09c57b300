"""Model-assisted steps behind plain callables, with deterministic defaults.

A model is any function; it runs in tasks on batches of rows, and where it fails
for good the result is null. Finished answers are kept in a store, so that calls
that cost time or money aren't made twice.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, NamedTuple

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Summarize = Callable[[str], str | None]
MOST_CHARS, AT_ONCE = 4000, 10
#: A task writes its answers at the latest with the first one that comes so many seconds after the last file, or so many answers.
WRITE_AFTER, IN_A_FILE = 1.0, 20_000
PACKS = "packs"


_turn = threading.Lock()


class Told(NamedTuple):
    value: Any
    error: str | None


@dataclass
class Answers:
    """Durable answers by the hash of what was asked, one small file each, in a folder that all tasks reach.

    A file is written beside its place and moved there, so that it is whole or
    absent: a task that is run again, a second build or another task finds every
    finished call. Calls that fail are tried again, waiting twice as long each time
    with some chance; a call that failed for good leaves no file. ``gap``: the
    least seconds between two calls of one task, its share of a rate for all.
    """

    path: str
    tries: int = 3
    wait: float = 0.5
    gap: float = 0.0

    def __post_init__(self) -> None:
        self._at = 0.0

    def _place(self, key: Any) -> tuple[fs.FileSystem, str]:
        name = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()
        where, base = _folder(self.path)
        return where, f"{base}/{name[:2]}/{name}.json"

    def found(self, key: Any) -> Told | None:
        """The stored answer to ``key``."""
        where, place = self._place(key)
        if where.get_file_info(place).type == fs.FileType.File:
            with where.open_input_stream(place) as f:
                return Told(json.loads(f.read()), None)
        return None

    def single(self) -> bool:
        """Whether the folder has answers in files of their own."""
        where, base = _folder(self.path)
        return any(f.base_name != PACKS for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)))

    def ask(self, key: Any, call: Callable[[], Any]) -> Told:
        """The stored answer to ``key``, or the call's, which is stored; it must be what JSON can hold."""
        if told := self.found(key):
            return told
        told = self.call(call)
        if told.error is None:
            where, place = self._place(key)
            _write(where, place, json.dumps(told.value).encode())
        return told

    def call(self, call: Callable[[], Any]) -> Told:
        """The call's answer, which isn't stored here."""
        error = ""
        for k in range(max(1, self.tries)):
            if k:
                time.sleep(self.wait * 2 ** (k - 1) * (1 + random.random()))
            self._pace()
            try:
                value = call()
            except Exception as e:  # a failed call is told, not raised  # noqa: BLE001
                error = str(e) or type(e).__name__
                continue
            return Told(value, None)
        return Told(None, error)

    def _pace(self) -> None:
        if self.gap:
            with _turn:
                self._at = max(time.monotonic(), self._at + self.gap)
                wait = self._at - time.monotonic()
            time.sleep(max(0.0, wait))


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write(where: fs.FileSystem, place: str, body: bytes) -> None:
    """A file that is whole or absent."""
    folder = place.rsplit("/", 1)[0]
    where.create_dir(folder, recursive=True)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    with where.open_output_stream(draft, compression=None) as f:
        f.write(body)
    where.move(draft, place)


class Pack:
    """Many answers to a file, each by its key, in a store's folder ``packs``: what one task of a run has asked.

    A file is whole or absent. Answers are written with the first one that comes a
    second after the last file, so slow calls are kept as they end; a task that is
    lost asks again what ended within that second. A task that is run again reads
    what its earlier attempts have written.
    """

    def __init__(self, path: str, run: str) -> None:
        self.where, base = _folder(path)
        self.folder, self.mine = f"{base}/{PACKS}", f"{run}-{TaskContext.get().partitionId()}-"
        self.lines: list[str] = []
        self.lock, self.at = threading.Lock(), time.monotonic()

    def earlier(self) -> dict[str, str | None]:
        """What earlier attempts of this task have asked, by key."""
        out: dict[str, str | None] = {}
        for f in self.where.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if f.base_name.startswith(self.mine):
                with self.where.open_input_stream(f.path, compression="gzip") as x:
                    out |= {r["key"]: r["value"] for r in map(json.loads, x.read().decode().splitlines())}
        return out

    def add(self, key: str, value: str | None) -> None:
        with self.lock:
            self.lines.append(json.dumps({"key": key, "value": value}) + "\n")
            if time.monotonic() - self.at >= WRITE_AFTER or len(self.lines) >= IN_A_FILE:
                self.write()

    def write(self) -> None:
        if self.lines:
            _write(self.where, f"{self.folder}/{self.mine}{uuid.uuid4().hex}.json.gz", gzip.compress("".join(self.lines).encode(), 6))
        self.lines, self.at = [], time.monotonic()


def packed(rows: DataFrame, store: str) -> DataFrame | None:
    """(_key, _known, _has): the answers of a store's packs; none if there are none."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{PACKS}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    told = spark.read.schema("key string, value string").json(f"{store}/{PACKS}")
    return told.groupBy(F.col("key").alias("_key")).agg(F.first("value").alias("_known"), F.lit(True).alias("_has"))


def share(per_second: float | None, rows: DataFrame) -> float:
    """Seconds between two calls of a task, where all tasks that run at once keep to a rate."""
    return rows.sparkSession.sparkContext.defaultParallelism / per_second if per_second else 0.0


def first_words(text: str) -> str | None:
    """The summary without a model: the first line with letters, at most 20 words."""
    line = next((x.strip(" #/*\"'") for x in text.splitlines() if any(c.isalpha() for c in x)), "")
    return " ".join(line.split()[:20]) or None


def summarize(rows: DataFrame, text: str, model: Summarize = first_words, *, into: str = "summary", at_once: int = AT_ONCE, store: str | None = None, tries: int = 3, wait: float = 0.5, per_second: float | None = None) -> DataFrame:
    """``rows`` with the column ``into`` from the model; a task has ``at_once`` calls under way, in the rows' order.

    With a ``store``, a folder that all tasks reach, equal texts are asked once, by
    the model's name and the text that it sees, and failed calls are tried again.
    Answers are packed (see Pack); what a store holds already meets the rows by a join.
    """
    names = [c for c in rows.columns if c != into]
    schema = rows.select(*names).schema.add(into, "string")
    who = getattr(model, "__qualname__", type(model).__name__)
    if store:
        return _summarize_kept(rows.select(*names), text, model, who, schema, into, at_once, Answers(store, tries, wait, share(per_second, rows)))

    def ask(body: str | None) -> str | None:
        try:
            return None if body is None else model(body[:MOST_CHARS])
        except Exception:  # a failed call leaves no summary  # noqa: BLE001
            return None

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                told = {body: pool.submit(ask, body) for body in dict.fromkeys(batch[text])}  # equal texts of a batch are asked once
                yield batch.assign(**{into: [told[body].result() for body in batch[text]]})

    return rows.select(*names).mapInPandas(run, schema)


def _summarize_kept(rows: DataFrame, text: str, model: Summarize, who: str, schema: StructType, into: str, at_once: int, kept: Answers) -> DataFrame:
    key = F.when(F.col(text).isNotNull(), F.sha2(F.concat_ws("\t", F.lit("summary"), F.lit(who), F.left(text, F.lit(MOST_CHARS))), 256))
    keyed, known, run_id = rows.withColumn("_key", key), packed(rows, kept.path), uuid.uuid4().hex
    keyed = keyed.withColumns({"_known": F.lit(None).cast("string"), "_has": F.lit(None).cast("boolean")}).repartition("_key") if known is None else keyed.join(known, "_key", "left").repartition("_key")
    keyed = keyed.sortWithinPartitions("_key")  # equal texts meet in one task, one after the other

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = Pack(kept.path, run_id)
        before, single = pack.earlier(), kept.single()

        def ask(key: str, body: str) -> str | None:
            seen = body[:MOST_CHARS]
            told = (kept.found(["summary", who, seen]) if single else None) or kept.call(lambda: model(seen))
            if told.error is None:
                pack.add(key, told.value)
            return told.value

        last: dict[str, str | None] = {}
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                told: dict[str, Any] = {}
                for k, body, value, has in zip(batch["_key"], batch[text], batch["_known"], batch["_has"], strict=True):
                    if k is not None and k not in told:
                        told[k] = value if has is True else before[k] if k in before else last[k] if k in last else pool.submit(ask, k, body)
                told = {k: x.result() if isinstance(x, Future) else x for k, x in told.items()}
                yield batch[names].assign(**{into: [told.get(k) for k in batch["_key"]]})
                last = {k: told[k] for k in list(told)[-1:]}
        pack.write()

    names = rows.columns
    return keyed.mapInPandas(run, schema)
