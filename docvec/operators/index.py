"""The vector index: a Parquet table of positioned vectors and what is known of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvec.operators.keyfilter import folders_with_keys, key_filter, key_filter_bits
from docvec.scratch import materialize, staged
from docvec.sources import versions
from docvec.sources.vectors import KEYS

# Fixed value: the one metric, squared L2.
METRIC = "l2sq"

PIECE_ROWS = 1 << 18  # positions in a folder of their own
_PIECE = "_piece"
_MOST_PIECES = 10_000  # named in one filter

_EMPTY = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("chunk_id", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
_BROADCAST_RANGES = 100_000  # two numbers each
_SLOT_BITS = 33  # monotonically_increasing_id: partition above, place in the partition below


@dataclass(frozen=True)
class VectorIndex:
    """Vectors with their positions. `dimension` is None until the first vector is in."""

    vectors: DataFrame
    dimension: int | None
    n_vectors: int
    metric: str = METRIC
    stored: DataFrame | None = None  # the rows with their piece, if they lie in pieces
    piece_rows: int | None = None


def dimension_check(vectors: DataFrame) -> DataFrame:
    """How many vectors there are of each width."""
    return vectors.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))


def _one_dimension(widths: DataFrame, expected: int | None) -> tuple[int | None, int]:
    """The width all vectors share and their number; an error when they differ."""
    row = widths.agg(F.min("low"), F.max("high"), F.sum("n")).first()
    low, high, n = row[0], row[1], row[2] or 0
    if low != high or (n and expected is not None and low != expected):
        raise ValueError(f"vectors of width {low} to {high}, expected {expected or 'one width'}")
    return (low if n else expected), n


def _positioned(vectors: DataFrame, keys: list[str], first: int) -> tuple[DataFrame, DataFrame]:
    """Dense positions in key order for a stored table, and the widths seen on the way.

    Rows are range-partitioned by key and stored with their partition and place in it;
    a row's position is its place plus the rows of the partitions before. Behind the keys rows are cut by a hash of the
    vector and by their place in the table, so that no task holds more than one range however many rows
    share a key, or are equal. Only one count per partition is ever brought together.
    """
    ranges = max(vectors.rdd.getNumPartitions(), 1)  # as many as the table has pieces to scan
    ties = {"_hash": F.xxhash64("embedding"), "_row": F.monotonically_increasing_id()}
    by = [*keys, *ties]
    ordered = vectors.withColumns(ties).repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop(*ties)
    slot = F.monotonically_increasing_id()
    placed = materialize(
        ordered.select(
            "*",
            F.shiftright(slot, _SLOT_BITS).alias("_range"),
            slot.bitwiseAND((1 << _SLOT_BITS) - 1).alias("_place"),
            F.size("embedding").alias("_width"),
        ),
        "positions",
    )
    counts = materialize(
        placed.groupBy("_range").agg(
            F.count("*").alias("n"), F.min("_width").alias("low"), F.max("_width").alias("high")
        ),
        "ranges",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = placed.join(F.broadcast(starts) if ranges <= _BROADCAST_RANGES else starts, "_range")
    vec_id = (F.col("_start") + F.col("_place") + F.lit(first)).alias("vec_id")
    return placed.select(vec_id, *vectors.columns), counts


def _as_table(vectors: DataFrame, stored: bool) -> AbstractContextManager[DataFrame]:
    """The vectors as a stored table.

    Cutting into ranges reads its input twice, once for a sample of the keys; without
    this every chunk would be encoded twice.
    """
    return nullcontext(vectors) if stored else staged(vectors, "vectors")


def index_positions(vectors: DataFrame, keys: list[str] | None = None, stored: bool = False) -> DataFrame:
    """Add vec_id: the 0-based position in key order."""
    with _as_table(vectors, stored) as table:
        return _positioned(table, keys or KEYS, 0)[0]


def build_index(
    vectors: DataFrame,
    dimension: int | None = None,
    metric: str = METRIC,
    keys: list[str] | None = None,
    stored: bool = False,
) -> VectorIndex:
    """Index of all vectors; an error when their widths differ or miss `dimension`.

    `stored` says that `vectors` is read from a table rather than computed.
    """
    if metric != METRIC:
        raise ValueError(f"metric {metric!r} is not supported, only {METRIC!r}")
    with _as_table(vectors, stored) as table:
        placed, counts = _positioned(table, keys or KEYS, 0)
    dimension, n = _one_dimension(counts, dimension)
    if n == 0:
        raise ValueError("no vectors to build an index from")
    return VectorIndex(placed, dimension, n, metric)


def empty_index(spark: SparkSession, dimension: int | None) -> VectorIndex:
    if dimension is None:
        raise ValueError("an empty index needs a dimension")
    return VectorIndex(spark.createDataFrame([], _EMPTY), dimension, 0)


def new_vectors(base: DataFrame, delta: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row of `delta` for each key that is not in `base` yet; null counts as a key like others.

    Of the rows of a key the one with the least vector stays, then the least of its other columns. They are
    reduced in the map tasks, before a shuffle. Finding the known keys first lets Spark broadcast a small
    delta to the scan of a large base instead of shuffling the base.
    """
    on = keys or KEYS
    rest = ["embedding", *(c for c in delta.columns if c not in on and c != "embedding")]
    single = delta.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_row")).select(*on, "_row.*").select(*delta.columns)
    wanted = delta.select(*(F.col(k).alias(f"_{k}") for k in on)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on]
    known = base.select(*on).join(wanted, same, "left_semi").select(*(F.col(k).alias(f"_{k}") for k in on))
    return single.join(known, same, "left_anti")


def _added(
    index: VectorIndex, delta: DataFrame, keys: list[str], stored: bool, known_in: Callable[[DataFrame], DataFrame | None]
) -> tuple[DataFrame, int | None, int]:
    """Positioned new rows behind the last one, the common width and their number.

    `known_in` gives the rows that may hold keys of the stored delta; None, as for an index without vectors, says that
    there are none, and the types of the keys are then those of the delta.
    """
    with _as_table(delta, stored) as table:
        base = known_in(table) if index.n_vectors else None
        with staged(new_vectors(table.limit(0) if base is None else base, table, keys), "new") as fresh:
            placed, counts = _positioned(fresh, keys, index.n_vectors)
    dimension, n = _one_dimension(counts, index.dimension)
    return placed, dimension, n


def add_vectors(
    index: VectorIndex, delta: DataFrame, keys: list[str] | None = None, stored: bool = False
) -> VectorIndex:
    """Index with the vectors of `delta` behind its own; keys already indexed are left out."""
    placed, dimension, n = _added(index, delta, keys or KEYS, stored, lambda _: index.vectors)
    if n == 0:
        return index
    vectors = index.vectors.unionByName(placed, allowMissingColumns=True) if index.n_vectors else placed
    return VectorIndex(vectors, dimension, index.n_vectors + n, index.metric)


# --- stored indexes ---------------------------------------------------------------


def _write_folder(rows: DataFrame, path: str, first: int, n: int, keys: list[str], piece_rows: int) -> tuple[str, dict]:
    """Write positioned rows to a folder of their own, with a filter of their keys beside them; what a note says of it.

    Rows lie in folders of `piece_rows` positions each, so that a position is found without a look at the others.
    """
    folder = versions.new_folder(path)
    spark = rows.sparkSession
    rows.withColumn(_PIECE, F.floor(F.col("vec_id") / piece_rows).cast("int")).write.partitionBy(_PIECE).parquet(f"{folder}/rows")
    about: dict = {"first": first, "n": n}
    if set(keys) <= set(rows.columns):
        about |= {"keys": keys, "bits": key_filter_bits(n)}
        written = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
        key_filter(written, keys, about["bits"]).write.parquet(f"{folder}/keys")
    return folder, about


def _note(index: VectorIndex, folders: dict[str, dict], schema: T.StructType, piece_rows: int) -> dict:
    return {
        "dimension": index.dimension, "metric": index.metric, "n_vectors": index.n_vectors, "piece_rows": piece_rows,
        "folders": list(folders), "about": folders, "schema": schema.json(),
    }


def _commit(spark: SparkSession, path: str, after: int, note: dict, written: str) -> None:
    """Make the version; a writer that comes second takes its folder away again."""
    try:
        versions.commit(spark, path, after, note)
    except versions.ConcurrentWrite:
        versions.drop(spark, [written])
        raise


def save_index(
    index: VectorIndex | None, path: str, keys: list[str] | None = None, retain_seconds: float = versions.RETAIN_SECONDS
) -> None:
    """Write the vectors to a folder of their own, then the note that makes it the current version.

    The index may be read from the same path, and so may those of other readers: what the new version replaces stays
    for `retain_seconds`, longer where it is held. A run that is lost before the note leaves the old index as it was,
    and of two writers the second fails.
    """
    if index is None:
        raise RuntimeError("the index was not built")
    spark = index.vectors.sparkSession
    number, _ = versions.latest(spark, path) or (0, None)
    folder, about = _write_folder(index.vectors, path, 0, index.n_vectors, keys or KEYS, PIECE_ROWS)
    _commit(spark, path, number, _note(index, {folder: about}, index.vectors.schema, PIECE_ROWS), folder)
    versions.expire(spark, path, retain_seconds)


def _rows_of(spark: SparkSession, note: dict, folders: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(note["schema"]))
    with_piece = T.StructType([*schema.fields, T.StructField(_PIECE, T.IntegerType())])
    return reduce(DataFrame.unionByName, (spark.read.schema(with_piece).parquet(f"{f}/rows") for f in folders))


def _may_hold(spark: SparkSession, note: dict, delta: DataFrame, keys: list[str]) -> DataFrame | None:
    """The rows of the folders whose filters do not rule out all keys of the delta; None if all do."""
    filtered = {f: a["bits"] for f, a in note["about"].items() if a.get("keys") == keys}
    asked = [f for f in note["folders"] if f not in filtered]
    if filtered:
        asked += folders_with_keys(delta, keys, {f: (spark.read.parquet(f"{f}/keys"), bits) for f, bits in filtered.items()})
    return _rows_of(spark, note, asked).drop(_PIECE) if asked else None


def append_to_saved(
    spark: SparkSession,
    delta: DataFrame,
    path: str,
    keys: list[str] | None = None,
    stored: bool = False,
    after: int | None = None,
    max_folders: int = 16,
) -> VectorIndex:
    """Add vectors to a stored index in place: only the new rows are written.

    Known keys are looked for only in the folders whose filters let them through. Running it again with the same
    vectors changes nothing, and files that a lost run left are not seen. The new version follows the current one, or
    number `after` if that is what the caller has read; where another writer has made one meanwhile this is an
    error (`versions.ConcurrentWrite`), nothing is kept of it, and the append can be run again. Beyond
    `max_folders` the smaller folders are merged.
    """
    keys = keys or KEYS
    index = open_index(spark, path)
    number, note = versions.latest(spark, path) if after is None else (after, versions.note_of(spark, path, after))
    if after is not None:
        index = _opened(spark, note)
    placed, dimension, n = _added(index, delta, keys, stored, lambda table: _may_hold(spark, note, table, keys))
    if n:
        folder, about = _write_folder(placed, path, index.n_vectors, n, keys, note["piece_rows"])
        grown = VectorIndex(index.vectors, dimension, index.n_vectors + n, index.metric)
        folders = {**(note["about"] if index.n_vectors else {}), folder: about}
        schema = _merged(index.vectors.schema, placed.schema) if index.n_vectors else placed.schema
        _commit(spark, path, number, _note(grown, folders, schema, note["piece_rows"]), folder)
        if len(folders) > max_folders:
            compact(spark, path, max_folders)
    return open_index(spark, path)


def _merged(old: T.StructType, new: T.StructType) -> T.StructType:
    return T.StructType([*old.fields, *(f for f in new.fields if f.name not in old.names)])


def compact(spark: SparkSession, path: str, max_folders: int = 1) -> int:
    """Merge folders of a stored index until there are `max_folders` at most; the number there is then.

    The smaller ones become one: at least as many as have to go, and all that hold less than a quarter of the rows, so
    that a row is rewritten about once each time the index has grown by a quarter. Positions stay; readers and the
    keys of a later append see no difference. Another writer at the same time makes one of the two fail.
    """
    found = versions.latest(spark, path)
    if found is None:
        return 0
    number, note = found
    by_size = sorted(note["folders"], key=lambda f: note["about"][f]["n"])
    excess = len(by_size) - max_folders + 1
    if excess < 2:
        return len(by_size)
    small = [f for i, f in enumerate(by_size) if i < excess or 4 * note["about"][f]["n"] < note["n_vectors"]]
    rows = _rows_of(spark, note, small).drop(_PIECE)
    n = sum(note["about"][f]["n"] for f in small)
    pieces = max(1, rows.rdd.getNumPartitions() // len(small), -(-n // note["piece_rows"]))
    keys = next((note["about"][f]["keys"] for f in small if "keys" in note["about"][f]), KEYS)
    merged = rows.repartitionByRange(pieces, "vec_id").sortWithinPartitions("vec_id")
    folder, about = _write_folder(merged, path, min(note["about"][f]["first"] for f in small), n, keys, note["piece_rows"])
    about_all = {f: note["about"][f] for f in note["folders"] if f not in small} | {folder: about}
    _commit(spark, path, number, {**note, "folders": list(about_all), "about": about_all}, folder)
    versions.expire(spark, path)
    return len(about_all)


def _opened(spark: SparkSession, note: dict) -> VectorIndex:
    rows = _rows_of(spark, note, note["folders"])
    return VectorIndex(rows.drop(_PIECE), note["dimension"], note["n_vectors"], note["metric"], rows, note["piece_rows"])


def load_index(spark: SparkSession, path: str, dimension: int | None = None) -> VectorIndex:
    """Stored index, with its own dimension; a new empty one where nothing is stored."""
    found = versions.latest(spark, path)
    return empty_index(spark, dimension) if found is None else _opened(spark, found[1])


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """Stored index; an error where none was built. It can be read for as long as versions are retained."""
    try:
        return load_index(spark, path)
    except ValueError as error:
        raise RuntimeError(f"no index at {path}: build one first") from error


@contextmanager
def held_index(spark: SparkSession, path: str) -> Iterator[VectorIndex]:
    """`open_index`, readable to the end of the block whatever other writers do."""
    with versions.hold(spark, path) as found:
        if found is None:
            raise RuntimeError(f"no index at {path}: build one first")
        yield _opened(spark, found[1])


def lookup(index: VectorIndex, positions: DataFrame, columns: list[str]) -> DataFrame:
    """vec_id and wanted columns of the rows at some positions(vec_id); of a stored index only their pieces are read."""
    wanted = positions.select("vec_id").distinct()
    if index.stored is None:
        return index.vectors.select("vec_id", *columns).join(wanted, "vec_id", "left_semi")
    piece = F.floor(F.col("vec_id") / index.piece_rows).cast("int")
    there = [row[0] for row in wanted.select(piece).distinct().limit(_MOST_PIECES + 1).collect()]
    rows = index.stored.where(F.col(_PIECE).isin(there)) if len(there) <= _MOST_PIECES else index.stored
    return rows.select("vec_id", *columns).join(wanted, "vec_id", "left_semi")
