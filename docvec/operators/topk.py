"""The k nearest vectors to each of some queries, kept while batches of vectors pass by."""

from __future__ import annotations

import numpy as np

from docvec.functions.vectors import exact_l2

_BLOCK_CELLS = 1 << 20  # query x vector estimates held at once
_PAIRS = 1 << 13  # candidate pairs rescored at once
_UNIT = 2.0**-53


def _row_keys(vectors: np.ndarray) -> np.ndarray:
    """A number for each vector, equal for equal ones."""
    bits = np.ascontiguousarray(vectors + 0.0).view(np.uint64)  # one zero, not two
    odd = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, 2 * bits.shape[1], 2, dtype=np.uint64)
    bits ^= bits >> np.uint64(29)
    return np.einsum("ij,j->i", bits, odd)


def _lowest_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep: of equal vectors only the k lowest ids can be among the nearest."""
    if len(np.unique(_row_keys(vectors))) == len(ids):  # equal vectors have equal keys
        return np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(vectors[order] + 0.0)  # one zero, not two
    keys = rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, group = np.unique(keys, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    return order[by_group[_place_in_run(group[by_group]) < k]]


def _place_in_run(values: np.ndarray) -> np.ndarray:
    """0-based place of each element in its run of equal, adjacent values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return np.arange(len(values)) - np.repeat(starts, np.diff(np.r_[starts, len(values)]))


class NearestRows:
    """Exact top-k per query under (distance, id).

    A matrix product estimates all distances of a batch; its rounding error has a known
    bound, and every pair that could still be among the k best within that bound is
    computed again in plain order. So no neighbour is missed and the distances equal
    those of the column function bit for bit.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self._queries = queries
        self._widened = np.c_[queries, np.ones(len(queries))]
        self._norms = np.einsum("ij,ij->i", queries, queries)
        self._k = k
        self._count = np.zeros(len(queries), dtype=np.int64)
        self._id = np.zeros((len(queries), k), dtype=np.int64)
        self._distance = np.full((len(queries), k), np.inf)  # nearest first

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if len(ids) == 0 or len(self._queries) == 0:
            return
        kept = _lowest_copies(ids, vectors, self._k)
        ids, vectors = ids[kept], vectors[kept]
        norms = np.einsum("ij,ij->i", vectors, vectors)
        # Widened rows multiply to half the distance without the query's own norm.
        widened = np.c_[-vectors, norms / 2].T
        slack = 8.0 * (vectors.shape[1] + 4) * _UNIT * (self._norms + norms.max())
        step = max(1, _BLOCK_CELLS // len(ids))
        for start in range(0, len(self._queries), step):
            self._offer_to(slice(start, start + step), ids, vectors, widened, slack)

    def _offer_to(
        self, block: slice, ids: np.ndarray, vectors: np.ndarray, widened: np.ndarray, slack: np.ndarray
    ) -> None:
        """Find and keep the pairs of one block of queries that may be among the k best."""
        queries, slack = self._queries[block], slack[block]
        half = self._widened[block] @ widened
        worst = self._distance[block, -1]  # infinite until a query has k rows
        limit = (worst - self._norms[block] + slack) / 2
        if len(ids) >= self._k and np.isinf(limit).any():
            kth = np.partition(half, self._k - 1, axis=1)[:, self._k - 1]
            limit = np.minimum(limit, kth + slack)
        hits = np.flatnonzero(half <= limit[:, None])
        for at in range(0, len(hits), _PAIRS):
            row, col = np.divmod(hits[at : at + _PAIRS], len(ids))
            self._keep(block.start + row, ids[col], exact_l2(queries[row], vectors[col]))

    def _keep(self, query: np.ndarray, vec_id: np.ndarray, distance: np.ndarray) -> None:
        """Put new pairs among the kept ones of their queries; only these queries are touched."""
        touched, row = np.unique(query, return_inverse=True)
        kept = np.arange(self._k) < self._count[touched, None]
        row = np.concatenate([np.nonzero(kept)[0], row])
        vec_id = np.concatenate([self._id[touched][kept], vec_id])
        distance = np.concatenate([self._distance[touched][kept], distance])
        order = np.lexsort((vec_id, distance, row))
        place = _place_in_run(row[order])
        order, place = order[place < self._k], place[place < self._k]
        at = touched[row[order]]
        self._id[at, place], self._distance[at, place] = vec_id[order], distance[order]
        self._count[touched] = np.bincount(row[order])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and distance of every kept pair."""
        kept = np.arange(self._k) < self._count[:, None]
        return np.nonzero(kept)[0], self._id[kept], self._distance[kept]
