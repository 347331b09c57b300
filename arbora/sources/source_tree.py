"""Scans of trees of source files.

Spark's own readers skip names that begin with ``_`` or ``.``, so tasks list the
folders themselves. A frontier of folders starts with the root; each round deals
it over tasks, every task goes down from a folder until it has listed so many
entries, and the folders that it didn't enter are the next frontier. Each round
is a table in the shared folder: what was listed isn't listed again when an
executor is lost, and the driver sees counts alone. The rows are those of a walk
that leaves out excluded folders on the way down and doesn't follow links to
folders. The tree must be in a folder that all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.paths import excluded_folder, source_file
from arbora.functions.text import stable_id
from arbora.sources.shared import materialize

#: Entries that a task lists below one folder of the frontier before it hands on the rest, and bytes of files that it reads at once.
LISTED, PORTION = 4096, 8 << 20
FOUND = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("error", pa.string())])
READ = pa.schema([("path", pa.string()), ("folder", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def _below(root: str, folder: str, most: int) -> Iterator[tuple[str, bool, str | None]]:
    """Source files below a folder, and the folders left to be listed, all by relative path; a folder that can't be listed has an error."""
    todo, listed = [folder], 0
    while todo:
        at = todo.pop()
        if listed >= most:
            yield at, True, None
            continue
        try:
            with os.scandir(os.path.join(root, at)) as entries:
                for e in entries:
                    listed += 1
                    path = f"{at}/{e.name}" if at else e.name
                    if e.is_dir():
                        if not excluded_folder(e.name) and not e.is_symlink():
                            todo.append(path)
                    elif source_file(e.name):
                        yield path, False, None
        except OSError as e:
            yield at, False, e.strerror or type(e).__name__


def scan(spark: SparkSession, root: str, listed: int = LISTED) -> DataFrame:
    """(path, error): the source files of a tree, and with an error the folders that can't be listed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows = list(_below(root, folder, listed))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frontier, rounds = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = materialize(frontier.mapInArrow(run, "path string, is_folder boolean, error string"), "listed")
        rounds.append(found.filter("not is_folder").select("path", "error"))
        left = found.filter("is_folder").select("path")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        frontier = left.repartition(tasks, "path")


def contents(spark: SparkSession, root: str, files_per_task: int = 64, listed: int = LISTED) -> DataFrame:
    """(path, folder, content, error) of a tree's source files; what can't be opened, listed or isn't UTF-8 has an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

        rows, held = [], 0
        for b in batches:
            for path, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                content = None
                if error is None:
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            content = f.read()
                    except OSError as e:
                        error = e.strerror or type(e).__name__
                rows.append((path, os.path.dirname(path), content, error))
                held += len(content or b"")
                if held >= PORTION:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    found = scan(spark, root, listed)
    dealt = found.repartition(max(1, -(-found.count() // files_per_task)), "path")
    read = dealt.mapInArrow(run, "path string, folder string, content binary, error string")
    fault = F.when(F.col("error").isNull() & ~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    return materialize(read.withColumn("error", F.coalesce("error", fault)), "contents")


def texts(read: DataFrame) -> DataFrame:
    """(path, folder, text) from contents(): files in UTF-8, line ends as ``\\n``."""
    return read.filter("error is null").select("path", "folder", F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n").alias("text"))


def faults(read: DataFrame) -> DataFrame:
    """(path, error) from contents()."""
    return read.filter("error is not null").select("path", "error")


def read_tree(spark: SparkSession, root: str, files_per_task: int = 64) -> DataFrame:
    """(path, folder, text): files in UTF-8; others are left out, and skipped() lists them."""
    return texts(contents(spark, root, files_per_task))


def skipped(spark: SparkSession, root: str, files_per_task: int = 64) -> DataFrame:
    """(path, error): source files that can't be opened or aren't UTF-8, and folders that can't be listed."""
    return faults(contents(spark, root, files_per_task))


def folder_nodes(files: DataFrame, root: str) -> DataFrame:
    """(node_id, parent_id, kind, path): the repository and its packages, which are folders with files of their own.

    A package's parent is the package of the folder above, else the repository.
    """
    repo = stable_id(F.lit("repo"), F.lit(root))
    pkg = files.select("folder").distinct().select(F.when(F.col("folder") == "", ".").otherwise(F.col("folder")).alias("path"))
    above = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit(None))
    known = pkg.select(F.col("path").alias("up"))
    out = pkg.withColumn("up", above).join(known.withColumn("has", F.lit(True)), "up", "left")
    packages = out.select(stable_id(F.lit("pkg"), F.col("path")).alias("node_id"), F.when(F.col("has"), stable_id(F.lit("pkg"), F.col("up"))).otherwise(repo).alias("parent_id"), F.lit("pkg").alias("kind"), "path")
    one = files.sparkSession.range(1).select(repo.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("repo").alias("kind"), F.lit(root).alias("path"))
    return one.unionByName(packages)
