"""Helpers shared by the corpus operators: shared folders, written tables, files.

Executors can be lost and do not share local folders with each other or with
the driver, so whatever outlives a stage is written below the folder named by
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TypeVar
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workspace import materialise, shared_dir, work_path

__all__ = ["ascii_lower", "columns", "filesystem", "free_names", "id_crc32", "kept", "mapped", "materialise", "quoted", "release", "shared_dir", "small_batches", "stored", "text_bytes", "tidy", "without", "work_path"]

#: Rows and bytes of one Arrow batch; texts may be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20

T = TypeVar("T")

def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Bound the rows and the bytes of an Arrow batch, as whole texts travel in them.

    Plans read the session's settings when they run, after an operator has
    returned; so the bounds stay, and one that is lower already is left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None) or ""
        now = int(now) if now.isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


_KEPT: dict[str, dict] = {}


def kept(owner: str, name: object, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task, for one operator at a time: another owner's goes first."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
    own = _KEPT[owner]
    if name not in own:
        own[name] = make()
    return own[name]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's call that gives free memory back, if it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(work: Callable[[Iterator], Iterator], owner: str | None = None) -> Callable[[Iterator], Iterator]:
    """``work`` on a partition; at its end the worker lets go of mapped files, of what other owners keep, and of free memory.

    Workers outlive their tasks, and idle ones count against the executor.
    """

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        for other in [k for k in _KEPT if k != owner]:
            del _KEPT[other]
        try:
            yield from work(batches)
        finally:
            mapped.cache_clear()
            _reader.cache_clear()
            release()

    return run


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc32(column: str = "doc_id") -> Column:
    """crc32 of an id written as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def quoted(name: str) -> str:
    """A column's name as expressions take it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by their quoted names."""
    return [F.col(quoted(c)) for c in df.columns]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before them where ``df`` has such columns (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (in any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute local path, and the path in it."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


@lru_cache(maxsize=512)
def _reader(uri: str) -> Callable[[int, int], np.ndarray]:
    """A file's bytes by offset and number: mapped into memory, or read by range from a store that has no files."""
    if uri.startswith(("file:", "/")):
        whole = np.asarray(np.memmap(unquote(urlparse(uri).path), np.uint8, "r"))
        return lambda at, n: whole[at : at + n]
    fs, where = filesystem(uri)
    f = fs.open_input_file(where)
    return lambda at, n: np.frombuffer(f.read_at(n, at), np.uint8)


def stored(uri: str, at: int, n: int) -> np.ndarray:
    """``n`` bytes of a file from ``at`` on."""
    return _reader(uri)(at, n)


@lru_cache(maxsize=256)
def mapped(uri: str) -> np.ndarray:
    """All bytes of a file: mapped into memory, or fetched from a store that has no files."""
    if uri.startswith(("file:", "/")):
        return np.memmap(unquote(urlparse(uri).path), np.uint8, "r")
    fs, where = filesystem(uri)
    with fs.open_input_file(where) as f:
        return np.frombuffer(f.read(), np.uint8)
