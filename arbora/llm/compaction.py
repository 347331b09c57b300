"""Sharding with size-tiered compaction.

A store is a folder of immutable Parquet shards and a series of manifests. An
arrival is appended as it comes, one small shard for each task that writes. The
manifest of a version lists its shards with rows and bytes. Compaction groups
shards of similar size (a tier spans a factor of four), merges groups of enough
runs into files of about the target size, and commits a manifest in which the
new shards stand for the merged ones. A version's file is written under another
name and published by a rename that fails if another writer has published the
version, so readers see a version whole or not at all; an interrupted job leaves
files that no manifest names, and a version file without content counts as absent.

Defined results: an empty arrival adds no shard, but a version; repeated rows are
kept, each once; nulls and extra columns, whatever their names, are stored as they
are, and a version has the columns of all its arrivals, null where an arrival
lacks one; an arrival whose column has another type than before is refused; shards
of one size are taken by name; texts of any length are stored; a store without
shards reads as None.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import file_system

#: Bytes of a full shard, runs that are worth merging, and the factor between tiers.
TARGET_BYTES, FAN_IN, TIER_FACTOR = 128 << 20, 4, 4
#: A shard of at least this part of the target is full, and isn't merged again.
FULL = 0.5
#: Groups that the driver merges at a time, at most; fewer where the session has fewer cores.
AT_ONCE = 256
#: A shard goes by its path below the data folder.
MANIFEST = "shard string, rows long, bytes long"
NAME = "([0-9a-f]{32}(/_run=[0-9]+)?/[^/]+)$"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def merged(old: StructType, new: StructType) -> StructType:
    """The columns of both, all nullable; a column of two types is refused."""
    out = {f.name: StructField(f.name, f.dataType) for f in old}
    for f in new:
        if f.name in out and out[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {out[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        out.setdefault(f.name, StructField(f.name, f.dataType))
    return StructType(list(out.values()))


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _published(self, version: int) -> dict | None:
        """A version's manifest and schema; None if its file is absent or has no content."""
        path = f"{self.path}/versions/{version:08d}"
        fs, p = file_system(self.spark, path)
        if not fs.exists(p) or not fs.getFileStatus(p).getLen():
            return None
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        fs, p = file_system(self.spark, f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(p) if f.getLen()] if fs.exists(p) else []
        return max([int(x) for x in names if x.isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(shard, rows, bytes) of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._published(version)['manifest']}")

    def schema(self, version: int | None = None) -> StructType:
        """The columns of all arrivals up to a version."""
        version = self.version() if version is None else version
        return StructType.fromJson(self._published(version)["schema"]) if version else StructType()

    def _commit(self, version: int, manifest: DataFrame, schema: StructType) -> int:
        name = f"{version:08d}-{uuid.uuid4().hex}"
        manifest.select("shard", "rows", "bytes").write.parquet(f"{self.path}/manifests/{name}")
        fs, draft = file_system(self.spark, f"{self.path}/drafts/{name}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        out.close()
        _, p = file_system(self.spark, f"{self.path}/versions/{version:08d}")
        if fs.exists(p) and not fs.getFileStatus(p).getLen():
            fs.delete(p, False)  # left by a writer that died
        fs.mkdirs(p.getParent())
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(p), no_options)  # fails if the version is there
        except Exception as e:
            raise Conflict(f"version {version} exists") from e
        return version

    def _written(self, folder: str) -> DataFrame:
        """Manifest rows of the shards in a folder; files without rows are left out."""
        try:
            found = self.spark.read.parquet(f"{self.path}/data/{folder}")
        except AnalysisException:
            fs, p = file_system(self.spark, f"{self.path}/data/{folder}")
            if fs.exists(p) and any(x.isFile() and x.getPath().getName()[0] not in "_." for x in fs.listStatus(p)):
                raise  # there are shards, but they can't be read
            return self.spark.createDataFrame([], MANIFEST)
        file = found.metadataColumn("_metadata")  # also where a column has that name
        told = found.select(F.regexp_extract(file["file_path"], NAME, 1).alias("shard"), file["file_size"].alias("bytes"))
        return told.groupBy("shard", "bytes").agg(F.count("*").alias("rows")).select("shard", "rows", "bytes")

    def append(self, arrival: DataFrame) -> int:
        """Adds an arrival's rows as new shards; gives the new version."""
        version, folder = self.version(), uuid.uuid4().hex
        schema = merged(self.schema(version), arrival.schema)
        arrival.write.option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        return self._commit(version + 1, self.manifest(version).unionByName(self._written(folder)), schema)

    def plan(self, *, target: int = TARGET_BYTES, fan_in: int = FAN_IN, factor: int = TIER_FACTOR) -> DataFrame:
        """Manifest rows to merge, with the number ``grp`` of the file to become: shards that aren't full, by tier, filled up to it."""
        small = self.manifest().filter(F.col("bytes") < target * FULL).withColumn("tier", F.floor(F.log(float(factor), F.col("bytes") + 1)))
        line = Window.partitionBy("tier").orderBy("bytes", "shard")
        filled = F.sum("bytes").over(line.rowsBetween(Window.unboundedPreceding, -1))
        part = small.withColumn("part", F.floor(F.coalesce(filled, F.lit(0)) / target))
        group = Window.partitionBy("tier", "part")
        ready = part.withColumns({"runs": F.count("*").over(group), "sum": F.sum("bytes").over(group)}).filter((F.col("runs") >= fan_in) | ((F.col("runs") > 1) & (F.col("sum") >= target)))
        return ready.withColumn("grp", F.col("tier") * (1 << 40) + F.col("part"))

    def compact(self, *, target: int = TARGET_BYTES, fan_in: int = FAN_IN, factor: int = TIER_FACTOR) -> int:
        """Merges until no group is ready; gives the latest version.

        A group, at most twice the target, is merged by a job of one task, without
        a shuffle; a few jobs run at a time. The driver holds names and sizes of
        the shards to merge, never rows.
        """
        version = self.version()
        schema, cores = self.schema(version), self.spark.sparkContext.defaultParallelism
        while True:
            todo: dict[int, list[str]] = {}
            for r in self.plan(target=target, fan_in=fan_in, factor=factor).select("shard", "grp").collect():
                todo.setdefault(r.grp, []).append(r.shard)
            if not todo:
                return version
            folder = uuid.uuid4().hex

            def merge(group: tuple[int, list[str]], folder: str = folder) -> None:
                self._read(group[1], schema).coalesce(1).write.option("compression", "zstd").parquet(f"{self.path}/data/{folder}/_run={group[0]}")

            with ThreadPoolExecutor(max(1, min(AT_ONCE, cores))) as pool:
                list(pool.map(merge, todo.items()))
            old = self.spark.createDataFrame([(x,) for shards in todo.values() for x in shards], "shard string")
            kept = self.manifest(version).join(old, "shard", "left_anti")
            version = self._commit(version + 1, kept.unionByName(self._written(folder)), schema)

    def _read(self, files: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version; None if it has no shard."""
        version = self.version() if version is None else version
        files = [r.shard for r in self.manifest(version).collect()]
        return self._read(files, self.schema(version)) if files else None

    def vacuum(self) -> int:
        """Deletes shards that the latest version doesn't name; gives their number. Older versions can't be read after it."""
        live = {r.shard for r in self.manifest().collect()}
        fs, p = file_system(self.spark, f"{self.path}/data")
        found, gone, top = fs.listFiles(p, True), 0, fs.makeQualified(p).toString()
        while found.hasNext():
            at = found.next().getPath()
            name = at.toString()[len(top) + 1 :]
            if name.endswith(".parquet") and name not in live:
                gone += bool(fs.delete(at, False))
        return gone
