"""Numbered versions of a stored thing: small JSON notes, each written once.

A note names the folders of its version. It is written whole under a hidden name and then put in its place by a step
that never overwrites, for exactly the number after the version its writer started from: of two writers that start from
one version the second fails, and a lost writer leaves a hidden file and folders that no note names.

Versions stay readable: what a version names is deleted only by `expire`, when the version was replaced longer ago than
the retention and no reader holds it. A reader that needs one for longer holds it (`hold`) by a small file of its own.
The file system is the one Spark reads the path with.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

RETAIN_SECONDS = 24 * 3600
HOLD_SECONDS = 7 * RETAIN_SECONDS


class ConcurrentWrite(RuntimeError):
    """Another writer has made the version meanwhile."""


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _fs(spark: SparkSession, path: str):
    at = _path(spark, path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> dict[int, int]:
    """The versions there are, with the time in seconds at which each was made."""
    fs, at = _fs(spark, f"{path}/versions")
    if not fs.exists(at):
        return {}
    files = ((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at))
    return {int(name): made for name, made in files if name.isdigit()}


def _read(spark: SparkSession, file: str) -> dict:
    fs, at = _fs(spark, file)
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def note_of(spark: SparkSession, path: str, number: int) -> dict:
    return _read(spark, f"{path}/versions/{number}")


def latest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """Number and note of the current version, None where there is none."""
    numbers = _numbers(spark, path)
    return (max(numbers), note_of(spark, path, max(numbers))) if numbers else None


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    fs, at = _fs(spark, path)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def _put(spark: SparkSession, hidden: str, place: str) -> bool:
    """Give a whole file its name in one step; False where the name is taken.

    A rename of the Hadoop API refuses a taken name in one step on a distributed file system, but on a local one it
    looks first and then renames, so there a hard link takes its part.
    """
    jvm, (fs, source), target = spark._jvm, _fs(spark, hidden), _path(spark, place)
    try:
        if fs.getUri().getScheme() == "file":
            real = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (target, source)]
            jvm.java.nio.file.Files.createLink(*real)
        else:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(source, target, options)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def commit(spark: SparkSession, path: str, after: int, note: dict) -> int:
    """Make the version that follows number `after` and return its number; ConcurrentWrite if it is there already."""
    if max(_numbers(spark, path), default=0) > after:
        raise ConcurrentWrite(f"{path} was changed by another writer: version {after} is not the last any more")
    hidden = f"{path}/versions/.{uuid.uuid4().hex}"
    _write(spark, hidden, json.dumps(note).encode())
    try:
        if not _put(spark, hidden, f"{path}/versions/{after + 1}"):
            raise ConcurrentWrite(f"{path} was changed by another writer: version {after + 1} is there already")
    finally:
        drop(spark, [hidden])
    return after + 1


def new_folder(path: str) -> str:
    return f"{path}/data/{uuid.uuid4().hex}"


def drop(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        fs, at = _fs(spark, folder)
        fs.delete(at, True)


@contextmanager
def hold(spark: SparkSession, path: str) -> Iterator[tuple[int, dict] | None]:
    """The current version, kept from being deleted inside the block.

    The hold, which names what it keeps, is put first and the version looked at again: if it has gone meanwhile, the
    next one is held. A reader that is lost holds for `HOLD_SECONDS`.
    """
    while True:
        found = latest(spark, path)
        if found is None:
            yield None
            return
        file = f"{path}/holds/{found[0]}-{uuid.uuid4().hex}"
        _write(spark, file, json.dumps(found[1]).encode())
        try:
            if found[0] in _numbers(spark, path):
                yield found
                return
        finally:
            drop(spark, [file])


def _holds(spark: SparkSession, path: str) -> list[dict]:
    """Notes of the versions that are held."""
    fs, at = _fs(spark, f"{path}/holds")
    if not fs.exists(at):
        return []
    live = [s.getPath() for s in fs.listStatus(at) if time.time() - s.getModificationTime() / 1000 < HOLD_SECONDS]
    held = []
    for file in live:
        if not file.getName().startswith("."):
            try:
                held.append(_read(spark, f"{path}/holds/{file.getName()}"))
            except Exception as error:  # let go meanwhile
                if "FileNotFound" not in str(error):
                    raise
    return held


def expire(spark: SparkSession, path: str, retain_seconds: float = RETAIN_SECONDS) -> list[str]:
    """Delete notes that were replaced that long ago, and folders as old that neither a note nor a hold names.

    A folder without a note is one of a lost writer, or of one still at work: no write may take longer than the
    retention. Returns the deleted folders.
    """
    now = time.time()
    made = _numbers(spark, path)
    order = sorted(made)
    gone = [n for n, following in zip(order, order[1:]) if now - made[following] >= retain_seconds]
    drop(spark, [f"{path}/versions/{n}" for n in gone])
    notes = [note_of(spark, path, n) for n in order if n not in gone]
    named = {folder.rsplit("/", 1)[1] for note in [*notes, *_holds(spark, path)] for folder in note["folders"]}
    fs, at = _fs(spark, f"{path}/data")
    if not fs.exists(at):
        return []
    there = ((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at))
    unnamed = [f"{path}/data/{name}" for name, changed in there if name not in named and now - changed >= retain_seconds]
    drop(spark, unnamed)
    return unnamed
