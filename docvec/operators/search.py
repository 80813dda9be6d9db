"""Exact nearest neighbours: one query, many queries, hits with their metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from docvec.functions.vectors import as_matrix, finite, l2_squared_to
from docvec.operators.index import VectorIndex, lookup
from docvec.operators.topk import NearestRows
from docvec.scratch import materialize
from docvec.session import small_batches

# Fixed value: neighbours returned when no number is given.
TOP_K = 5

# Queries are sent to every task up to this size, counted as float64.
BROADCAST_BYTES = 16 << 20
# Beyond it they are cut into blocks of this size, one of which a task holds.
BLOCK_BYTES = 128 << 20
# Vectors stored together in a row, and those of a task's part of the index; counted as float64.
PACK_BYTES = 1 << 20
PART_BYTES = 128 << 20


def query_vector(query: DataFrame | Sequence[float] | np.ndarray, dimension: int | None) -> np.ndarray:
    """The one query row as a vector; an error for more rows, none, or a wrong width."""
    if isinstance(query, DataFrame):
        rows = query.select("embedding").limit(2).collect()
        matrix = np.array([row[0] for row in rows], dtype=np.float64)
    else:
        matrix = np.atleast_2d(np.asarray(query, dtype=np.float64))
    if matrix.ndim != 2 or matrix.shape[0] != 1 or (dimension is not None and matrix.shape[1] != dimension):
        raise ValueError(f"expected one query of width {dimension}, got shape {matrix.shape}")
    return matrix[0]


def search(
    index: VectorIndex,
    query: DataFrame | Sequence[float] | np.ndarray,
    top_k: int = TOP_K,
    columns: Sequence[str] = (),
) -> DataFrame:
    """The `top_k` nearest vectors to one query: vec_id, distance and wanted columns, nearest first.

    One scan of the index; each task keeps its own best rows and only those meet.
    Distance is squared L2; equal ones are ordered by vec_id. A small index gives what it has. Vectors that are
    null or hold a null, a NaN or an infinity have no distance and take no part.
    """
    vector = query_vector(query, index.dimension)
    distance = l2_squared_to(vector)(F.col("embedding"))
    vectors = index.vectors.where(finite("embedding"))
    scored = vectors.select("vec_id", *columns, distance.alias("distance"))
    return scored.orderBy("distance", "vec_id").limit(top_k)


def self_query(index: VectorIndex, top_k: int = TOP_K, columns: Sequence[str] = ()) -> DataFrame:
    """Search with the first vector of the index; it finds itself at distance 0."""
    first = index.vectors.where("vec_id = 0").limit(1)  # the scan stops where it is found
    return search(index, first, top_k, columns)


_PARTIAL = "query_id long, vec_id long, distance double"


def _partial_rows(nearest: NearestRows, query_ids: np.ndarray) -> pa.RecordBatch:
    query, vec_id, distance = nearest.rows()
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[query]), pa.array(vec_id), pa.array(distance)],
        names=["query_id", "vec_id", "distance"],
    )


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Runs of a batch's rows of one cell and side: cell, side, ids, vectors."""
    cell, is_vector = (batch[name].to_numpy(zero_copy_only=False) for name in ("cell", "is_vector"))
    new = np.flatnonzero((cell[1:] != cell[:-1]) | (is_vector[1:] != is_vector[:-1])) + 1
    for begin, end in pairwise([0, *new.tolist(), len(cell)]):
        if end > begin:
            part = batch.slice(begin, end - begin)
            yield int(cell[begin]), bool(is_vector[begin]), part["id"].to_numpy(), as_matrix(part["embedding"])


def _nearest_in_cells(top_k: int, sent: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows (cell, is_vector, id, embedding), cell by cell, the queries of a cell before its vectors.

    Only the queries of one cell and what they have found are held; the vectors stream by, however many there are.
    Queries that were `sent` to every task are those of its only cell.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, nearest = None, [], None
        if sent is not None:
            at, asked = 0, [sent.value]
        for batch in batches:
            for cell, is_vector, ids, matrix in _segments(batch):
                if cell != at:
                    if nearest is not None:
                        yield _partial_rows(nearest, query_ids)
                    at, asked, nearest = cell, [], None
                if not is_vector:
                    asked.append((ids, matrix))
                elif asked or nearest is not None:
                    if nearest is None:
                        query_ids = np.concatenate([i for i, _ in asked])
                        nearest, asked = NearestRows(np.concatenate([m for _, m in asked]), top_k), []
                    nearest.offer(ids, matrix)
        if nearest is not None:
            yield _partial_rows(nearest, query_ids)

    return scan


def cells_of(spark: SparkSession, query_bytes: int, block_bytes: int) -> tuple[int, int]:
    """Blocks of queries by their bytes, and parts of a block, so that there is a cell for every core: their product is the cells.

    The size of the index is no part of it, since vectors are not held.
    """
    blocks = max(1, -(-query_bytes // block_bytes))
    cores = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks, max(1, -(-cores // blocks))


def _packed(rows: int, numbers: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows (id, embedding) in packs of so many: all ids and all numbers of a pack, of one width, after each other."""

    def pack(ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        widths = {v.shape[1] for v in vectors}
        if len(widths) > 1:
            raise ValueError(f"vectors of width {min(widths)} to {max(widths)}, expected one width")
        values = [np.concatenate(ids).tobytes(), np.concatenate(vectors).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - held)
                ids.append(part["id"].to_numpy())
                vectors.append(as_matrix(part["embedding"]).astype(numbers))
                held, at = held + part.num_rows, at + part.num_rows
                if held == rows:
                    yield pack(ids, vectors)
                    ids, vectors, held = [], [], 0
        if held:
            yield pack(ids, vectors)

    return run


def _packs(rows: DataFrame, n: int) -> tuple[DataFrame, str]:
    """Packs of n of the rows (id, embedding) as they lie, and what their numbers are."""
    numbers = "float32" if rows.schema["embedding"].dataType == ArrayType(FloatType()) else "float64"
    return rows.select("id", "embedding").mapInArrow(_packed(n, numbers), "ids binary, vectors binary"), numbers


def _unpacked(query_numbers: str, numbers: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of packs (asked, queries, ids, vectors) as the rows of cells; the queries come again only where they change."""

    def rows(cell: int, is_vector: bool, ids: pa.Buffer, vectors: pa.Buffer, kind: str) -> pa.RecordBatch:
        ids, flat = np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind)
        ends = np.arange(len(ids) + 1, dtype=np.int32) * np.int32(len(flat) // len(ids))
        columns = [pa.array(np.full(len(ids), cell)), pa.array(np.full(len(ids), is_vector)), pa.array(ids)]
        embedding = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.RecordBatch.from_arrays([*columns, embedding], ["cell", "is_vector", "id", "embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at = 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                asked, queries, ids, vectors = (batch[name][i].as_buffer() for name in ("asked", "queries", "ids", "vectors"))
                if asked.to_pybytes() != at:
                    cell, at = cell + 1, asked.to_pybytes()
                    yield rows(cell, False, asked, queries, query_numbers)
                yield rows(cell, True, ids, vectors, numbers)

    return run


def _nearest_of_packs(
    vectors: DataFrame, queries: DataFrame, cells: int, block_bytes: int, row_bytes: int, n_vectors: int, top_k: int
) -> DataFrame:
    """The queries, cut into cells by a hash of their ids, and all packs of the vectors past each of them.

    The vectors are stored once, in packs, and a task reads its part of them for all of its cells, so what lies on disk
    is the queries, the vectors and the hits. Ids are spread evenly whatever the vectors are, so copies of one vector
    do not gather in a cell.
    """
    spark = queries.sparkSession
    cell = F.pmod(F.xxhash64("query_id"), F.lit(cells)).cast("int").alias("cell")
    asked = queries.select(F.col("query_id").alias("id"), "embedding", cell).repartitionById(cells, "cell")
    asked, query_numbers = _packs(asked, max(1, block_bytes // row_bytes))
    stored, numbers = _packs(vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding"), max(1, PACK_BYTES // row_bytes))
    parts = max(1, -(-n_vectors * row_bytes // PART_BYTES))
    stored = materialize(stored, "packs").coalesce(parts)
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.toDF("asked", "queries").coalesce(tasks).hint("shuffle_replicate_nl")  # a product, whatever the sizes
    nearest, unpacked = _nearest_in_cells(top_k), _unpacked(query_numbers, numbers)
    return asked.crossJoin(stored).mapInArrow(lambda batches: nearest(unpacked(batches)), _PARTIAL)


def _check_queries(most: int | None, low: int | None, high: int | None, dimension: int | None) -> None:
    if (most or 0) > 1:
        raise ValueError("several queries have one query_id")
    if low != high or (low is not None and dimension is not None and low != dimension):
        raise ValueError(f"queries of width {low} to {high}, expected {dimension}")


def knn_join(
    index: VectorIndex,
    queries: DataFrame,
    top_k: int = TOP_K,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`search` for every row of queries(query_id, embedding): query_id, rank, vec_id, distance.

    The queries are stored, so that an encoder behind them runs once, and counted; a query_id that comes twice is
    an error. Vectors and queries that `search` would leave out take no part. A task holds one block of queries and
    lets the vectors of its cell pass, gives `top_k` rows per query, never a row per pair, and the result is exact.
    Queries of up to `broadcast_bytes` are one block that is sent to the tasks which scan the index, and the index
    stays where it is; more of them, of any number, come to their cells in blocks of `block_bytes`, and every cell reads
    the vectors as they are stored.
    """
    spark = queries.sparkSession
    small_batches(spark)
    asked = materialize(queries.select(F.col("query_id").cast("long"), "embedding").where(finite("embedding")), "queries")
    vectors = index.vectors.where(finite("embedding"))
    n_queries, row_bytes = asked.count(), 8 * (index.dimension or 1)
    if n_queries * row_bytes <= broadcast_bytes:
        table = asked.toArrow()
        ids = table["query_id"].to_numpy()
        widths = np.unique(pc.list_value_length(table["embedding"]).to_numpy())
        low, high = (int(widths[0]), int(widths[-1])) if len(widths) else (None, None)
        _check_queries(2 if len(np.unique(ids)) < len(ids) else 1, low, high, index.dimension)
        sent = spark.sparkContext.broadcast((ids, as_matrix(table["embedding"].combine_chunks())))
        rows = vectors.select(F.lit(0).alias("cell"), F.lit(True).alias("is_vector"), F.col("vec_id").alias("id"), "embedding")
        partial = rows.mapInArrow(_nearest_in_cells(top_k, sent), _PARTIAL)
    else:
        per_id = asked.groupBy("query_id").agg(
            F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")
        )
        _check_queries(*per_id.agg(F.max("n"), F.min("low"), F.max("high")).first(), index.dimension)
        blocks, parts = cells_of(spark, n_queries * row_bytes, block_bytes)
        partial = _nearest_of_packs(vectors, asked, blocks * parts, block_bytes, row_bytes, index.n_vectors, top_k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    ranked = partial.withColumn("rank", rank).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", "vec_id", "distance")


def attach_metadata(hits: DataFrame, meta: DataFrame | VectorIndex, expected: Sequence[str]) -> DataFrame:
    """Metadata beside each hit, null where no row has that position, and `meta_complete`.

    The hits are stored first: the search runs once, and Spark, knowing how few they are,
    brings them to the scan of the metadata instead of shuffling that table. Of a stored index only the pieces
    that hold a hit are scanned.
    """
    hits = materialize(hits, "hits")
    if isinstance(meta, VectorIndex):
        wanted = lookup(meta, hits, list(expected))
    else:
        named = hits.select("vec_id").distinct()  # a vector may be a hit of most queries
        wanted = meta.select("vec_id", *expected).join(named, "vec_id", "left_semi")
    complete = F.lit(True)
    for name in expected:
        complete = complete & F.col(name).isNotNull()
    return hits.join(wanted, "vec_id", "left").withColumn("meta_complete", complete)
