"""Folders and files of a shared file system, listed and read on the executors.

`list_tree` gives the items of a folder tree as a table, a folder to a task, empty files and sizes included; `read_listed`
reads the bytes of listed files that fit a row. Both open addresses with pyarrow (file, hdfs, s3, gs); another store
is given as a `lister`, and as an `opener` from an address to its bytes.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvec.scratch import materialize
from docvec.session import small_batches
from docvec.sources.files import route_of
from docvec.sources.folders import FOLDER_MIME_TYPE

# Larger files are listed, not read.
MAX_ROW_BYTES = 256 << 20
TASK_BYTES = 128 << 20
_BATCH_BYTES = 4 << 20
_BATCH_ROWS = 1_000

Lister = Callable[[str], Iterable[tuple[str, bool, int]]]
Opener = Callable[[str], bytes]

ITEMS = "id string, name string, mime_type string, parent_id string, size long, problem string"
_ITEMS = pa.schema(
    [
        ("id", pa.string()), ("name", pa.string()), ("mime_type", pa.string()), ("parent_id", pa.string()),
        ("size", pa.int64()), ("problem", pa.string()),
    ]
)


def address(path: str) -> str:
    """A plain path as the address that listings give their files."""
    return path.rstrip("/") if "://" in path else Path(path).absolute().as_uri()


def list_folder_at(uri: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and size of everything directly in a folder.

    pyarrow gives a listing whole; a local folder is gone through entry by entry, so that one of many files takes no more room.
    """
    fs, path = FileSystem.from_uri(uri)
    if isinstance(fs, LocalFileSystem):
        with os.scandir(path) as entries:
            for entry in entries:
                try:
                    yield entry.name, entry.is_dir(), entry.stat().st_size
                except FileNotFoundError:  # gone meanwhile, or a link to nothing
                    yield entry.name, False, 0
        return
    for info in fs.get_file_info(FileSelector(path, recursive=False)):
        yield info.base_name, info.type == FileType.Directory, info.size or 0


def read_at(uri: str) -> bytes:
    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        return file.read()


def _listed(lister: Lister):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    for name, is_folder, size in lister(folder):
                        kind = FOLDER_MIME_TYPE if is_folder else None
                        rows.append(
                            {"id": f"{folder}/{quote(name)}", "name": name, "mime_type": kind, "parent_id": folder, "size": None if is_folder else size, "problem": None}
                        )
                        if len(rows) >= _BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ITEMS)
                            rows = []
                except Exception as error:  # the folder is told, the others go on
                    rows.append({"id": None, "name": None, "mime_type": None, "parent_id": folder, "size": None, "problem": str(error)[:200]})
        yield pa.RecordBatch.from_pylist(rows, schema=_ITEMS)

    return run


def list_tree(spark: SparkSession, root: str, lister: Lister = list_folder_at) -> DataFrame:
    """items(id, name, mime_type, parent_id, size, problem) of everything under a folder, as a stored table.

    An id is the address, a folder is marked as one, and a folder that can't be listed gives a row without an id that
    names the problem. A round lists all folders of a level at once, each by a task of its own while there are
    tasks; levels are what a file system has few of.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.range(1).select(F.lit(address(root)).alias("id"))
    levels: list[DataFrame] = []
    while True:
        level = materialize(folders.repartition(tasks, "id").mapInArrow(_listed(lister), ITEMS), "listing")
        levels.append(level)
        folders = level.where(F.col("mime_type") == FOLDER_MIME_TYPE).select("id")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)


_READ = "path string, content binary, problem string"
_READ_SCHEMA = pa.schema([("path", pa.string()), ("content", pa.binary()), ("problem", pa.string())])


def _read(opener: Opener, path: str, wanted: bool) -> dict:
    if not wanted:
        return {"path": path, "content": None, "problem": None}
    try:
        return {"path": path, "content": opener(path), "problem": None}
    except FileNotFoundError:
        return {"path": path, "content": None, "problem": "missing"}
    except Exception:
        return {"path": path, "content": None, "problem": "unreadable"}


def read_listed(files: DataFrame, max_bytes: int = MAX_ROW_BYTES, opener: Opener = read_at) -> DataFrame:
    """Add content and problem to listed files(path, size, ...): too_large, missing or unreadable, null where all went well.

    Files without a reader are not opened. Tasks are given about the same number of bytes.
    """
    others = [c for c in files.columns if c != "path"]
    readable = (F.col("size") <= max_bytes) & (route_of(F.col("path")) != "unsupported")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, begin = [], 0, 0
            for i, (path, wanted) in enumerate(zip(batch["path"].to_pylist(), batch["_wanted"].to_pylist(), strict=True)):
                rows.append(_read(opener, path, wanted))
                held += len(rows[-1]["content"] or b"")
                if held >= _BATCH_BYTES or i + 1 == batch.num_rows:
                    read = pa.RecordBatch.from_pylist(rows, schema=_READ_SCHEMA)
                    given = batch.slice(begin, len(rows)).select(others)
                    yield pa.RecordBatch.from_arrays([*given.columns, *read.columns], [*others, *read.schema.names])
                    rows, held, begin = [], 0, i + 1

    small_batches(files.sparkSession)
    total = files.agg(F.sum(F.least("size", F.lit(max_bytes)))).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "path")
    rows = files.withColumn("_wanted", F.coalesce(readable, F.lit(False))).repartition(tasks)
    read = rows.mapInArrow(run, f"{schema}, {_READ}" if others else _READ)
    large = F.when((F.col("size") > max_bytes) & (route_of(F.col("path")) != "unsupported"), "too_large")
    return read.withColumn("problem", F.coalesce("problem", large))
