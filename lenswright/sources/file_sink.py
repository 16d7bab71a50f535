"""A sink for many binary files: pictures, sheets, evidence.

Every task attempt writes below a folder of its own, with a manifest of its
files.  The commit keeps the folders of the attempts that count and removes those
of others, so an attempt that was lost, repeated or run twice leaves nothing.
Rows are (name, content); names may hold folders.  Equal names are kept, each in
its attempt's folder; rows without a content write no file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "named_files"
MANIFEST = "name string, file string, bytes long, sha256 string"
#: Files that a task reads at most (about), and bytes after which it passes on what it has read.
TASK_FILES, CHUNK = 5_000, 16 << 20


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute local path, and the path in it."""
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:") and "://" not in uri else uri)


@dataclass
class Attempt(WriterCommitMessage):
    """What one task attempt wrote."""

    folder: str
    files: int


def safe(name: str) -> str:
    """A name that stays inside its folder."""
    parts = name.split("/")
    if not name or name.startswith("/") or "\0" in name or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"no file can have the name {name!r}")
    return name


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.write_id = folder, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        context = TaskContext.get()
        own = f"{self.write_id}-{context.partitionId()}-{context.taskAttemptId()}"
        fs, base = store(self.folder)
        lines, made = [], set()
        for b in iterator:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                if content is None:
                    continue
                file = f"{base}/{own}/files/{safe(name)}"
                if (folder := file.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                while (file, 0) in made:  # the same name again
                    file += "~"
                made.add((file, 0))
                with fs.open_output_stream(file) as out:
                    out.write(content)
                lines.append(json.dumps({"name": name, "file": file[len(base) + 1 :], "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}))
        if lines:
            with fs.open_output_stream(f"{base}/{own}/manifest.json") as out:
                out.write("".join(f"{line}\n" for line in lines).encode())
        return Attempt(own, len(lines))

    def _folders(self) -> list[str]:
        fs, base = store(self.folder)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return [f.base_name for f in found if f.type == pafs.FileType.Directory]

    def _remove(self, folders: list[str]) -> None:
        fs, base = store(self.folder)
        for f in folders:
            fs.delete_dir(f"{base}/{f}")

    def commit(self, messages: list[Attempt | None]) -> None:
        kept = {m.folder for m in messages if m is not None and m.files}
        self._remove([f for f in self._folders() if f not in kept and (self.overwrite or f.startswith(f"{self.write_id}-"))])

    def abort(self, messages: list[Attempt | None]) -> None:
        self._remove([f for f in self._folders() if f.startswith(f"{self.write_id}-")])


class FileSink(DataSource):
    """``df.write.format("named_files").option("path", folder)`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if "path" not in self.options:
            raise ValueError("the sink needs a path")
        if {"name", "content"} - set(schema.names):
            raise ValueError("the sink takes the columns name and content")
        return FileWriter(self.options["path"].rstrip("/"), overwrite)


def write_files(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Write the rows (name, content) of ``df`` as files; ``overwrite`` removes what other writes left, once this one has succeeded."""
    spark = df.sparkSession
    spark.dataSource.register(FileSink)
    df.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).write.format(NAME).option("path", folder).mode(mode).save()


def written_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, bytes and sha256 of the files that have been written to ``folder``."""
    fs, base = store(folder)
    if not any(f.type == pafs.FileType.Directory for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))):
        return spark.createDataFrame([], "name string, path string, bytes long, sha256 string")
    found = spark.read.schema(MANIFEST).json(f"{folder}/*/manifest.json")
    return found.select("name", F.concat(F.lit(f"{folder}/"), "file").alias("path"), "bytes", "sha256")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``written_files`` with their content, and whether it is what was written (``intact``).

    Tasks open the files that the manifests name, so no list of files passes the
    driver.  A file that is gone has no content.
    """
    listed = written_files(spark, folder)
    if not listed.columns or listed.isEmpty():
        return listed.withColumns({"content": F.lit(None).cast("binary"), "intact": F.lit(None).cast("boolean")})

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        for b in batches:
            held, size, at = [], 0, 0
            for k, path in enumerate(b.column("path").to_pylist(), 1):
                try:
                    with fs.open_input_stream(base + path[len(folder) :]) as f:
                        held.append(f.read())
                        size += len(held[-1])
                except FileNotFoundError:
                    held.append(None)
                if size >= CHUNK or k == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(at, len(held)).columns, pa.array(held, pa.binary())], names=[*b.schema.names, "content"])
                    held, size, at = [], 0, k

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-listed.count() // TASK_FILES))
    read = listed.repartition(tasks, "path").mapInArrow(bodies, "name string, path string, bytes long, sha256 string, content binary")
    return read.withColumn("intact", F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)))
