"""Web pages as WARC archives, and whole-file gzip streams turned into archives that can be read from any record.

`write_archives` writes a record for each page; an archive is one gzip stream, as many crawls leave them, which can only be
read from its beginning. `normalise` inflates each such stream once, from first byte to last, writes every record as a gzip
member of its own and beside the archive a sidecar with a line for each record: where its member begins and how long it is.
`read_index` reads the sidecars as a table, `read_records` any of their records, by offset.

Payloads that are equal and not short are kept once: the page of the smallest id is a response, the others are revisits
that refer to it. Which is which comes from a grouping by digest, whose hot keys are added up in the map tasks and salted
for the join back, so that a payload that most pages share is spread.

A task writes files of names that no other attempt uses, and gives their names as its rows. A lost task leaves files that
no row names; sidecars of such files are passed over. Files go to a folder that all executors share, on any file system
that pyarrow opens by its URI (file, hdfs, s3, gs). Records are copied, hashed and compressed a piece at a time.

Edge cases: a null payload is an empty one, a null id is written as none. Pages that share the smallest id of their payload
are all responses; pages without an id revisit the one with the smallest, and are responses where none has an id.
Control characters and blanks of an address are percent-encoded, a null address is left out. Empty tables make no archives and no
rows. Other columns are not looked at. An archive that is cut off or broken gives the records before the damage and counts
as damaged; the member that the damage falls in is the last of the new archive and in no index. Archives that have a member
for each record already, or are not compressed, are normalised the same way.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvec.llm.common import bounded_batches, partitions, whole
from docvec.scratch import materialize

# Fixed value: payloads of fewer bytes are always written whole.
SHORT = 100
ARCHIVE_BYTES = 64 << 20  # payload bytes after which an archive is closed
SEGMENT_BYTES = 8 << 20  # neighbouring records of an archive that one task reads
SALTS = 32
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PIECE = 1 << 20
_LEVEL = 6
_CONTROL = re.compile("[\x00-\x20\x7f]")
FILES = "archive string, sidecar string, records long, damaged boolean"
SIDECAR = "archive string, offset long, length long, type string, record_id string, uri string, digest string"
RECORDS = (
    "archive string, offset long, type string, record_id string, uri string, page_id string, refers_to string, "
    "payload_bytes long, payload_digest string, intact boolean"
)


def _deflater():
    return zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)  # 31: with a gzip head and tail


def _head(first: bytes, fields: list[tuple[str, str | None]]) -> bytes:
    lines = [first, *(f"{name}: {value}".encode() for name, value in fields if value is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def _record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id} {digest}'.encode()).hexdigest()[:32])}>"


def page_record(page_id: str | None, url: str | None, payload: bytes, digest: str, original: str | None, date: str) -> tuple[bytes, bytes]:
    """Head and block of a page's record: a revisit where there is an original, whose block then is the HTTP head alone."""
    http = _head(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if original is not None else http + payload
    fields = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Page-ID", page_id),
        ("WARC-Refers-To", None if original is None else _record_id(original, digest)),
        ("WARC-Refers-To-Page-ID", original),
        ("WARC-Profile", None if original is None else REVISIT_PROFILE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _head(VERSION, fields), block


def _info_record(date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", str(len(block))),
    ]
    return _head(VERSION, fields) + block + b"\r\n\r\n"


# --- writing ----------------------------------------------------------------------


def with_originals(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Add _payload, _digest, _bytes and _original: the smallest id of an equal payload, null unless it is another page's."""
    rows = pages.withColumn("_payload", whole(payload_col).cast("binary"))
    rows = rows.withColumns({"_digest": F.sha2("_payload", 256), "_bytes": F.octet_length("_payload").cast("long")})
    shared = rows.where(F.col("_bytes") >= SHORT).groupBy("_digest").agg(F.count("*").alias("n"), F.min(id_col).alias("_least"))
    # stored, so that its size is known: payloads move only where it is too large to be sent to them
    shared = materialize(shared.where((F.col("n") > 1) & F.col("_least").isNotNull()), "shared")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    shared = shared.select("_digest", "_least", salts)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    joined = rows.withColumn("_salt", salt).join(shared, ["_digest", "_salt"], "left")
    other = ~F.col("_least").eqNullSafe(F.col(id_col)) & (F.col("_bytes") >= SHORT)
    return joined.withColumn("_original", F.when(other, F.col("_least"))).drop("_salt", "_least")


class _Archive:
    """A file being written; its name is known to nobody before it is whole."""

    def __init__(self, folder: str) -> None:
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.uri = f"{folder.rstrip('/')}/{self.name}"
        self._fs, self._base = fs, base
        self._out = fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.written = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.written += len(data)

    def close(self, lines: list[str] | None = None) -> str | None:
        """Finish the file and, given its lines, the sidecar beside it, whose address is returned."""
        self._out.close()
        if lines is None:
            return None
        with self._fs.open_output_stream(f"{self._base}/{self.name}.idx", compression=None) as out:
            for line in lines:
                out.write(line.encode() + b"\n")
        return f"{self.uri}.idx"


def _files(rows: list[tuple[str, str | None, int, bool]]) -> pa.RecordBatch:
    names, types = ["archive", "sidecar", "records", "damaged"], [pa.string(), pa.string(), pa.int64(), pa.bool_()]
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _written(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, deflate, records, filled = None, None, 0, 0
        for batch in batches:
            for page in batch.to_pylist():
                if archive is None:
                    archive, deflate, records, filled = _Archive(folder), _deflater(), 1, 0
                    archive.write(deflate.compress(_info_record(date)))
                head, block = page_record(page["id"], page["url"], page["payload"], page["digest"], page["original"], date)
                for data in (head, block, b"\r\n\r\n"):
                    archive.write(deflate.compress(data))
                records += 1
                filled += len(block)
                if filled >= archive_bytes:
                    archive.write(deflate.flush())
                    archive.close()
                    yield _files([(archive.uri, None, records, False)])
                    archive = None
        if archive is not None:
            archive.write(deflate.flush())
            archive.close()
            yield _files([(archive.uri, None, records, False)])

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record for each page into archives under `folder`, each one gzip stream; a row for each archive."""
    bounded_batches(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("text"))
    rows = with_originals(own, "id", "text").select(
        F.col("id").cast("string").alias("id"), "url", F.col("_payload").alias("payload"), F.col("_digest").alias("digest"),
        F.col("_original").cast("string").alias("original"),
    )
    return materialize(rows.mapInArrow(_written(folder, date, archive_bytes), FILES), "archives")


# --- reading ----------------------------------------------------------------------


class _Span(io.RawIOBase):
    """Some bytes of a file as a stream."""

    def __init__(self, file: pa.NativeFile, offset: int, length: int) -> None:
        self._file, self._at, self._end = file, offset, offset + length

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self._file.read_at(min(len(buffer), self._end - self._at), self._at)
        buffer[: len(data)] = data
        self._at += len(data)
        return len(data)


def _fields(stream: BinaryIO) -> tuple[bytes, list[bytes], dict[str, str]]:
    """First line, all lines and the named fields of a head, which ends with an empty line; nothing at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):  # what divides records
        line = stream.readline()
    lines, fields = [line], {}
    while line and line not in (b"\r\n", b"\n"):
        line = stream.readline()
        lines.append(line)
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if lines[0] and not line:
        raise EOFError("a head without its end")
    return lines[0].strip(), lines, fields


def _pieces(stream: BinaryIO, n: int) -> Iterator[bytes]:
    while n:
        data = stream.read(min(n, _PIECE))
        if not data:
            raise EOFError("a block without its end")
        n -= len(data)
        yield data


_DAMAGE = (EOFError, zlib.error, gzip.BadGzipFile, ValueError)


def _line(archive: str, offset: int, length: int, fields: dict[str, str]) -> str:
    return json.dumps(
        {
            "archive": archive, "offset": offset, "length": length, "type": fields.get("warc-type"),
            "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"),
        }
    )


def _normalised_one(source: str, folder: str) -> tuple[str, str | None, int, bool]:
    fs, path = FileSystem.from_uri(source)
    lines: list[str] = []
    damaged = False
    archive = _Archive(folder)
    with fs.open_input_file(path) as raw:
        whole_file = _Span(raw, 0, raw.size())
        zipped = raw.read_at(2, 0) == b"\x1f\x8b"
        stream = gzip.GzipFile(fileobj=whole_file) if zipped else io.BufferedReader(whole_file)
        try:
            while True:
                first, head, fields = _fields(stream)
                if not first:
                    break
                if not first.startswith(b"WARC/"):
                    raise ValueError("no record")
                size = int(fields.get("content-length", ""))
                if size < 0:
                    raise ValueError("no length")
                begin, deflate = archive.written, _deflater()
                archive.write(deflate.compress(b"".join(head)))
                for data in _pieces(stream, size):
                    archive.write(deflate.compress(data))
                archive.write(deflate.compress(b"\r\n\r\n") + deflate.flush())
                lines.append(_line(archive.uri, begin, archive.written - begin, fields))
        except _DAMAGE:
            damaged = True
    return archive.uri, archive.close(lines), len(lines), damaged


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Every archive(archive) again under `folder` with a member for each record and a sidecar; a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                yield _files([_normalised_one(source, folder)])

    # an archive a task as far as there are tasks: a stream can not be cut
    tasks = max(1, min(archives.count(), int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return materialize(archives.select("archive").repartition(tasks).mapInArrow(run, FILES), "normalised")


def read_index(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """The lines of the sidecars of `files` under `folder`; those of lost tasks are passed over."""
    if files.isEmpty():
        return spark.createDataFrame([], SIDECAR)
    lines = spark.read.schema(SIDECAR).option("pathGlobFilter", "*.idx").json(folder)
    return lines.join(files.select("archive"), "archive", "left_semi")


def _read_one(file: pa.NativeFile, offset: int, length: int) -> dict:
    """What a record says, its payload counted and hashed; a revisit has the numbers of the payload it refers to."""
    stream = gzip.GzipFile(fileobj=_Span(file, offset, length))
    _, _, fields = _fields(stream)
    left = int(fields["content-length"])
    size, stated = left, (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None
    if fields.get("content-type", "").startswith("application/http"):
        _, head, http = _fields(stream)
        left -= sum(map(len, head))
        size = int(http.get("content-length", left))
    digest, intact = stated, True
    if fields.get("warc-type") != "revisit":
        hashed, size = hashlib.sha256(), left
        for data in _pieces(stream, left):
            hashed.update(data)
        digest = hashed.hexdigest()
        intact = stated in (None, digest)
    return {
        "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"),
        "page_id": fields.get("warc-page-id"), "refers_to": fields.get("warc-refers-to-page-id"), "payload_bytes": size,
        "payload_digest": digest, "intact": intact,
    }


_RECORDS = pa.schema(
    [
        ("archive", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()),
        ("page_id", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("intact", pa.bool_()),
    ]
)


def read_records(index: DataFrame) -> DataFrame:
    """Every record of an index(archive, offset, length), read by its place; `intact` says whether the digest it states holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    fs, path = FileSystem.from_uri(archive)
                    name, file = archive, fs.open_input_file(path)
                rows.append({"archive": archive, "offset": offset, **_read_one(file, offset, length)})
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    places = index.select("archive", "offset", "length")
    segment = F.floor(F.col("offset") / SEGMENT_BYTES)
    # with a number, since Spark would join partitions of so few bytes, which stand for many more
    return places.repartition(partitions(index.sparkSession), "archive", segment).sortWithinPartitions("archive", "offset").mapInArrow(run, RECORDS)


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages, normalise the archives, read every page back: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    files = normalise(write_archives(pages, f"{folder}/streams", id_col, url_col, payload_col), f"{folder}/members")
    records = read_records(read_index(spark, files, f"{folder}/members").where("type in ('response', 'revisit')"))
    kind = pages.schema[id_col].dataType
    return records.select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
