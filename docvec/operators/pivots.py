"""Exact search that skips vectors: laid out by their nearest pivot, left out by the triangle inequality.

Every vector goes to the piece of the pivot it is nearest to; a piece knows its centre, its radius (the farthest of its
vectors) and its number of vectors. A query reads the pieces nearest to it until they hold k vectors, and then only those
that can hold a vector as near as the k-th of these: distance to the centre, less the radius, at most that. Rounding is
allowed for, so the result is that of `search`, bit for bit. It pays where vectors lie in groups; where all are about as
far from each other, as random ones of many dimensions are, most pieces are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvec.functions.vectors import as_matrix, exact_l2, finite
from docvec.operators.index import VectorIndex
from docvec.operators.search import TOP_K, query_vector, search
from docvec.scratch import staged
from docvec.sources import versions

PIECE_BYTES = 64 << 20
FILE_BYTES = 128 << 20
MOST_PIVOTS = 4096  # so many centres come to the driver and go to every task
_SLACK = 1e-9
_ROWS = 1 << 12


@dataclass(frozen=True)
class PivotLayout:
    """Stored vectors by piece, and of each piece its centre, radius (not squared) and size."""

    vectors: DataFrame  # with _pivot, by which they are partitioned
    dimension: int
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _nearest_pivot(centres: np.ndarray):
    """Column function for the nearest centre and the exact distance to it."""
    half = np.einsum("ij,ij->i", centres, centres) / 2

    @F.arrow_udf("struct<pivot:int,distance:double>")
    def nearest(embedding: pa.Array) -> pa.Array:
        vectors = as_matrix(embedding)
        near = [np.argmin(half - part @ centres.T, axis=1) for part in np.array_split(vectors, range(_ROWS, len(vectors), _ROWS)) if len(part)]
        pivot = np.concatenate(near) if near else np.empty(0, dtype=np.int64)
        distance = exact_l2(vectors, centres[pivot]) if len(vectors) else np.empty(0)
        return pa.StructArray.from_arrays([pa.array(pivot, pa.int32()), pa.array(distance)], ["pivot", "distance"])

    return nearest.asNondeterministic()


def lay_out(index: VectorIndex, path: str, pivots: int | None = None) -> PivotLayout:
    """Store the vectors of an index by pivots, vectors that `search` leaves out excepted; a new version of `path`.

    Pivots are the rows that come first in an order by hash: a sample of bounded size. A piece that is large, be it of
    copies of one vector, is written by several tasks.
    """
    if not index.n_vectors or index.dimension is None:
        raise ValueError("no vectors to lay out")
    spark = index.vectors.sparkSession
    row_bytes = 4 * index.dimension
    wanted = pivots or min(MOST_PIVOTS, max(1, index.n_vectors * row_bytes // PIECE_BYTES))
    good = index.vectors.where(finite("embedding"))
    first = good.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(wanted).toArrow()
    if not first.num_rows:
        raise ValueError("no vectors to lay out")
    centres = np.unique(as_matrix(first["embedding"].combine_chunks()), axis=0)
    with staged(good.withColumn("_near", _nearest_pivot(centres)(F.col("embedding"))), "pivots") as near:
        of_pieces = near.groupBy(F.col("_near.pivot").alias("pivot")).agg(F.count("*").alias("n"), F.max("_near.distance").alias("far"))
        radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
        for pivot, n, far in of_pieces.collect():  # a row a pivot
            sizes[pivot], radii[pivot] = n, np.sqrt(far)
        files = np.maximum(1, -(-sizes * row_bytes // FILE_BYTES))
        cuts = F.element_at(F.array(*(F.lit(int(f)) for f in files)), F.col("_near.pivot") + 1)
        placed = near.withColumns({"_pivot": F.col("_near.pivot"), "_cut": F.pmod(F.xxhash64("vec_id"), cuts)}).drop("_near")
        folder = versions.new_folder(path)
        tasks = max(int(files.sum()), 1)
        placed.repartition(tasks, "_pivot", "_cut").drop("_cut").write.partitionBy("_pivot").parquet(f"{folder}/rows")
    number, _ = versions.latest(spark, path) or (0, None)
    note = {
        "folders": [folder], "dimension": index.dimension, "centres": centres.tolist(), "radii": radii.tolist(), "sizes": sizes.tolist(),
        "schema": index.vectors.schema.json(),
    }
    try:
        versions.commit(spark, path, number, note)
    except versions.ConcurrentWrite:
        versions.drop(spark, [folder])
        raise
    versions.expire(spark, path)
    return open_layout(spark, path)


def open_layout(spark: SparkSession, path: str) -> PivotLayout:
    found = versions.latest(spark, path)
    if found is None:
        raise RuntimeError(f"no vectors laid out at {path}")
    note = found[1]
    centres, radii, sizes = (np.array(note[name]) for name in ("centres", "radii", "sizes"))
    return PivotLayout(spark.read.parquet(f"{note['folders'][0]}/rows"), note["dimension"], centres, radii, sizes)


def pieces_within(layout: PivotLayout, vector: np.ndarray, squared: float) -> np.ndarray:
    """The pieces that can hold a vector of at most that squared distance."""
    to_centre = np.sqrt(exact_l2(layout.centres, vector))
    slack = _SLACK * (to_centre + layout.radii + np.sqrt(squared))
    return np.flatnonzero((to_centre - layout.radii <= np.sqrt(squared) + slack) & (layout.sizes > 0))


def _in_pieces(layout: PivotLayout, pieces: Sequence[int]) -> VectorIndex:
    """Those pieces as an index; only their folders are scanned."""
    rows = layout.vectors.where(F.col("_pivot").isin([int(p) for p in pieces]))
    return VectorIndex(rows.drop("_pivot"), layout.dimension, int(layout.sizes[list(pieces)].sum()))


def search_pruned(
    layout: PivotLayout, query: DataFrame | Sequence[float] | np.ndarray, top_k: int = TOP_K, columns: Sequence[str] = ()
) -> DataFrame:
    """`search` over the pieces that can hold one of the `top_k` nearest vectors, with the same result."""
    vector = query_vector(query, layout.dimension)
    order = np.argsort(exact_l2(layout.centres, vector), kind="stable")
    order = order[layout.sizes[order] > 0]
    enough = int(np.searchsorted(np.cumsum(layout.sizes[order]), top_k)) + 1
    first = search(_in_pieces(layout, order[:enough]), vector, top_k).collect()  # k rows
    if len(first) < top_k:  # there are not as many vectors
        return search(_in_pieces(layout, order), vector, top_k, columns)
    return search(_in_pieces(layout, pieces_within(layout, vector, first[-1]["distance"])), vector, top_k, columns)
