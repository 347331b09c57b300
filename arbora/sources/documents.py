"""Named text files that tasks write, line by line."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

LINE_SCHEMA = "file string, part int, key string, n bigint, line string"
#: Bytes of a file that a task holds before they are written.
BUFFER = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def checked(name: str | None) -> str:
    """A file's name, if it stays below the folder."""
    if not name or any(x in ("", ".", "..") for x in name.split("/")):
        raise ValueError(f"no name of a document: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class _Writer(DataSourceWriter):
    """Each task writes to a folder of its own; the commit moves finished files to their places, an abort removes all of them."""

    def __init__(self, path: str) -> None:
        self.path, self.drafts = path.rstrip("/"), f".drafts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        where, base = located(self.path)
        mine, names, out = f"{base}/{self.drafts}/{uuid.uuid4().hex}", [], None
        try:
            for row in rows:
                if not names or row.file != names[-1]:
                    if out is not None:
                        out.close()
                    names.append(checked(row.file))
                    place = f"{mine}/{row.file}"
                    where.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = where.open_output_stream(place, compression=None, buffer_size=BUFFER)
                out.write(((row.line or "") + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return Written(mine, tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        where, base = located(self.path)
        for told in filter(None, messages):
            for name in told.names:
                where.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                where.move(f"{told.folder}/{name}", f"{base}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, base = located(self.path)
        if where.get_file_info(f"{base}/{self.drafts}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/{self.drafts}")


class Documents(DataSource):
    """Rows (file, line), all of a file in one partition and in order."""

    @classmethod
    def name(cls) -> str:
        return "arbora_documents"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def lines(rows: DataFrame, file: Column, part: int, line: Column, *, key: Column | None = None, n: Column | None = None) -> DataFrame:
    """(file, part, key, n, line): one line of a file for each row; a file's lines go by part, key, n."""
    key, n = F.lit("") if key is None else key, F.lit(0) if n is None else n
    return rows.select(file.alias("file"), F.lit(part).alias("part"), key.alias("key"), n.cast("long").alias("n"), line.alias("line"))


def fixed(spark: SparkSession, file: str, part: int, *texts: str) -> DataFrame:
    return spark.createDataFrame([(file, part, "", n, text) for n, text in enumerate(texts)], LINE_SCHEMA)


def write_documents(each: DataFrame, path: str) -> None:
    """Files of lines() below ``path``; a file there of the same name gives way.

    A task streams the sorted lines of a file, whatever their number; a null line
    is blank. Only the files' names reach the driver. Every file appears whole or
    not at all; a write that fails leaves all files as they were.
    """
    each.sparkSession.dataSource.register(Documents)
    order = ("file", "part", "key", "n", "line")
    each.select(*order).repartition("file").sortWithinPartitions(*order).select("file", "line").write.format(Documents.name()).mode("append").save(path)
