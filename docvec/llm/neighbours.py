"""Nearest neighbours by a block matrix join of int8 tiles.

Queries and candidates are cut into blocks, and every pair of blocks meets in one task. There the unit vectors,
rounded to int8 with one scale per vector, are multiplied tile by tile; the rounding bounds how far such a product
can be from the true cosine. Only pairs that can still be among the k best of their query are computed again, in
double precision and in the order of the components, and pushed on the query's heap. The heaps of a query's
blocks are merged by a ranking per query, over k rows per block.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do
rows without an id. Vectors of another width than the query's are not compared with it. Rows that repeat an id
count once, by the least vector. Equal scores go to the smaller id. A query with fewer candidates gets all of
them. Empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
TILE = 4096
HITS = "query_id long, vec_id long, score double"


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _in_order(products: np.ndarray) -> np.ndarray:
    """Row sums added up from left to right, as SQL does it."""
    return np.add.accumulate(products, axis=1)[:, -1]


class Tile:
    """Vectors of one width: as they are but for a power of two, and as int8 with a scale and a rounding error."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        # each by a power of two, which changes no cosine: so no square overflows or vanishes
        peak = np.abs(vectors).max(axis=1, keepdims=True)
        small = np.ldexp(vectors, -np.frexp(peak)[1])
        self.ids, self.vectors = ids, small
        self.norms = np.sqrt(_in_order(small * small))
        unit = small / np.sqrt((small * small).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127.0
        self.cells = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rounded = self.cells * self.scale[:, None]
        self.error = np.sqrt(((unit - rounded) ** 2).sum(axis=1))
        self.length = np.sqrt((rounded * rounded).sum(axis=1))

    def estimates(self, other: Tile) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of the int8 vectors, and how far off they can be: |uv - u'v'| <= |u - u'| |v| + |u'| |v - v'|."""
        kind = np.float32 if self.cells.shape[1] <= 1000 else np.float64  # either holds the sums of products exactly
        product = self.cells.astype(kind) @ other.cells.astype(kind).T
        value = product * (self.scale[:, None] * other.scale[None, :])
        bound = self.error[:, None] + self.length[:, None] * other.error[None, :]
        return value, bound + 1e-9

    def cosines(self, other: Tile, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The exact scores of pairs, a slice at a time."""
        out = np.empty(len(rows))
        for s in range(0, len(rows), 65536):
            a, b = rows[s : s + 65536], columns[s : s + 65536]
            dots = _in_order(self.vectors[a] * other.vectors[b])
            out[s : s + 65536] = dots / (self.norms[a] * other.norms[b])
        return out


class Heaps:
    """The k best of each query of a tile; the root of a heap is the one to go first."""

    def __init__(self, queries: Tile, k: int) -> None:
        self.queries, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.worst = np.full(len(queries.ids), -np.inf)

    def take(self, tile: Tile) -> None:
        value, bound = self.queries.estimates(tile)
        same = tile.ids[None, :] == self.queries.ids[:, None]
        low = np.where(same, -np.inf, value - bound)
        if low.shape[1] > self.k:  # the k-th best lower bound of the tile: below it nothing can be among the k best
            floor = np.partition(low, -self.k, axis=1)[:, -self.k]
            floor = np.maximum(floor, self.worst)
        else:
            floor = self.worst
        rows, columns = np.nonzero((value + bound >= floor[:, None]) & ~same)
        scores = self.queries.cosines(tile, rows, columns)
        ids = tile.ids[columns]
        keep = scores >= self.worst[rows]
        for q, score, vec in zip(rows[keep].tolist(), scores[keep].tolist(), ids[keep].tolist(), strict=True):
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -vec))
            elif (score, -vec) > heap[0]:
                heapq.heapreplace(heap, (score, -vec))
        for q in np.unique(rows[keep]).tolist():
            if len(self.heaps[q]) == self.k:
                self.worst[q] = self.heaps[q][0][0]

    def rows(self) -> Iterator[tuple[int, int, float]]:
        for q, heap in zip(self.queries.ids.tolist(), self.heaps, strict=True):
            for score, vec in heap:
                yield q, -vec, score


def _lowest_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the k + 1 smallest ids: of copies, no query can have others among its k best."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate((np.ones(1, dtype=bool), (vectors[1:] != vectors[:-1]).any(axis=1)))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    keep = np.arange(len(ids)) - begin <= k
    return ids[keep], vectors[keep]


def _cell(k: int):
    """A task's cells one after the other; the queries of a cell come before its candidates, which stream by."""

    def tiles(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, part in frame.groupby("width", sort=False):
            yield part["id"].to_numpy(), np.array(part["vector"].tolist(), dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, heaps = None, [], {}

        def done() -> list[tuple[int, int, float]]:
            return [row for h in heaps.values() for row in h.rows()]

        def send(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                ["query_id", "vec_id", "score"],
            )

        for batch in batches:
            frame = pd.DataFrame({n: batch.column(n).to_pylist() for n in ("cell", "is_candidate", "id", "width", "vector")})
            for now, part in frame.groupby("cell", sort=False):
                if now != cell:
                    if rows := done():
                        yield send(rows)
                    cell, asked, heaps = now, [], {}
                q = part[~part["is_candidate"]]
                if len(q):
                    asked.append(q)
                c = part[part["is_candidate"]]
                if not len(c) or not (asked or heaps):
                    continue
                if asked:
                    heaps = {v.shape[1]: Heaps(Tile(i, v), k) for i, v in tiles(pd.concat(asked))}
                    asked = []
                for ids, vectors in tiles(c):
                    if (own := heaps.get(vectors.shape[1])) is None:
                        continue
                    ids, vectors = _lowest_copies(ids, vectors, k)
                    for s in range(0, len(ids), TILE):
                        own.take(Tile(ids[s : s + TILE], vectors[s : s + TILE]))
        if rows := done():
            yield send(rows)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest other rows of each query row: query_id, rank (from 1), vec_id, score.

    The number of query blocks follows the queries, 2048 in each; the candidates are cut only as far as there are
    cores to take a cell. A candidate travels once per query block, a query once per cut of the candidates.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.where(F.col(id_col).isNotNull() & usable(vector_col))
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.min_by(F.struct(F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")), F.col(vector_col)).alias("x"))
        .select("id", F.col("x.v").alias("vector"), F.coalesce("x.q", F.lit(False)).alias("q"), F.size("x.v").alias("width"))
    )
    asked = vectors.where(is_query & F.col(id_col).isNotNull() & usable(vector_col)).count()
    blocks = max(1, -(-asked // QUERY_BLOCK))
    cuts = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks))
    h = F.xxhash64("id")
    queries = rows.where("q").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(cuts - 1)), lambda c: F.pmod(h, F.lit(blocks)) * cuts + c)).alias("cell"),
        F.lit(False).alias("is_candidate"), "id", "width", "vector",
    )
    candidates = rows.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * cuts + F.pmod(h, F.lit(cuts)))).alias("cell"),
        F.lit(True).alias("is_candidate"), "id", "width", "vector",
    )
    met = queries.unionByName(candidates).repartition("cell").sortWithinPartitions("cell", "is_candidate")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.mapInArrow(_cell(k), HITS).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
