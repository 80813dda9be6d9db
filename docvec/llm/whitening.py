"""Whitening of embeddings from variances alone, by polarisation.

Entries become whole numbers x = floor(1024 c) + 100000. With n vectors and their sums S, y = n x - S is centred exactly.
A pass over the vectors adds up y_i^2 for every dimension and (y_i + y_j)^2 for every pair of dimensions, as whole
numbers without any rounding; the polarisation identity

    2 sum(y_i y_j) = sum((y_i + y_j)^2) - sum(y_i^2) - sum(y_j^2)

then gives all covariances, and `eigh` of that one matrix the components. What meets on the driver are the width squared
sums, whatever the number of vectors; each task sends its sums once, cut into digits that fit a long.

Edge cases: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of another
width than the most common one (of equally common ones the widest). Repeated rows count and stay as often as they come,
null ids are kept. A component without variance (of a single vector, of copies, of dimensions that depend on others)
whitens to 0.0 and does not count in the identity error. A deviation that no long holds is null. Tables without a
vector give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvec.functions.vectors import as_matrix, finite

# Steps of a unit and what keeps them positive.
STEPS, SHIFT = 1024, 100_000
COMPONENTS = 8

_LIMB = 21  # products of two such parts can be added up 2 ** 20 times in a long
_ROWS = 1 << 12  # rows looked at together
_CELLS = 1 << 21  # pair sums held at once
_DIGIT = 48  # digits of partial sums; 2 ** 15 tasks can be added up in a long
_SUMS = "i int, j int, digit int, value long"


@dataclass(frozen=True)
class Whitening:
    """n, sums and the covariance of the fitted vectors, and their components by falling eigenvalue."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # a component a column

    def projection(self, k: int) -> np.ndarray:
        """Columns that take centred x to whitened components; zeros where there is no variance."""
        values, vectors = self.values[:k], self.vectors[:, :k]
        there = self.has_variance(k)
        return np.where(there, vectors / np.sqrt(np.where(there, values, 1.0)), 0.0)

    def has_variance(self, k: int) -> np.ndarray:
        floor = len(self.values) * np.finfo(np.float64).eps * max(self.values.max(initial=0.0), 0.0)
        return self.values[:k] > floor

    def explained(self, k: int) -> np.ndarray:
        total = float(np.trace(self.covariance))
        return np.clip(self.values[:k], 0.0, None) / total if total > 0 else np.zeros(min(k, len(self.values)))


def whole_numbers(matrix: np.ndarray) -> np.ndarray:
    """x of every entry; Python's own integers where a long does not hold them."""
    x = np.floor(matrix * float(STEPS))
    if len(x) and not np.abs(x).max() < 2.0**62:
        return np.array([[int(v) + SHIFT for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    return x.astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly."""
    far = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0) * n + max(map(abs, sums))
    if x.dtype == object or far >= 1 << 61:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * np.int64(n) - np.array(sums, dtype=np.int64)


def squares(v: np.ndarray) -> list[int]:
    """The sum of squares of each column, exactly; at most 2 ** 20 rows."""
    if v.dtype == object:
        return [int(s) for s in (v * v).sum(axis=0)] if len(v) else [0] * v.shape[1]
    most = int(np.abs(v).max(initial=0))
    parts, rest = [], np.abs(v)
    for _ in range(max(1, -(-most.bit_length() // _LIMB))):
        parts.append(rest & ((1 << _LIMB) - 1))
        rest = rest >> _LIMB
    total = [0] * v.shape[1]
    for a, low in enumerate(parts):
        for b in range(a, len(parts)):
            shift = _LIMB * (a + b) + (a != b)
            sums = np.einsum("ij,ij->j", low, parts[b]).tolist()
            total = [t + (s << shift) for t, s in zip(total, sums, strict=True)]
    return total


def _digits(keys: list[tuple[int, int]], values: list[int]) -> pa.RecordBatch:
    """Whole numbers of any size as rows that Spark can add up in longs."""
    rows: list[tuple[int, int, int, int]] = []
    for (i, j), value in zip(keys, values, strict=True):
        sign, rest, digit = (-1 if value < 0 else 1), abs(value), 0
        while rest:
            rows.append((i, j, digit, sign * (rest & ((1 << _DIGIT) - 1))))
            rest >>= _DIGIT
            digit += 1
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["i", "j", "digit", "value"])


def _added(vectors: DataFrame, per_task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[tuple[int, int], int]:
    """The sums of all tasks by (i, j); as many as the width squared at most."""
    rows = vectors.mapInArrow(per_task, _SUMS).groupBy("i", "j", "digit").agg(F.sum("value").alias("value")).toArrow()
    out: dict[tuple[int, int], int] = {}
    for i, j, digit, value in zip(*(rows[c].to_pylist() for c in ("i", "j", "digit", "value")), strict=True):
        out[i, j] = out.get((i, j), 0) + (value << (_DIGIT * digit))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        matrix = as_matrix(batch.column(0))
        for at in range(0, len(matrix), _ROWS):
            yield whole_numbers(matrix[at : at + _ROWS])


def _plain_sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for x in _blocks(batches):
            small = x.dtype != object and int(np.abs(x).max()) < 1 << 50
            sums = x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0)
            total = [t + int(s) for t, s in zip(total, sums, strict=True)]
            n += len(x)
        yield _digits([(-1, -1), *((i, i) for i in range(width))], [n, *total])

    return run


def _square_sums(n: int, sums: list[int]):
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for x in _blocks(batches):
            y = centred(x, n, sums)
            step = max(1, _CELLS // width)
            for at in range(0, len(y), step):
                part = y[at : at + step]
                own = squares(part)
                for i in range(width):
                    totals[i, i] = totals.get((i, i), 0) + own[i]
                    pairs = squares(part[:, i + 1 :] + part[:, i : i + 1])
                    for j, s in enumerate(pairs, i + 1):
                        totals[i, j] = totals.get((i, j), 0) + s
        yield _digits(list(totals), list(totals.values()))

    return run


def usable(vectors: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The rows that take part, and the width of their vectors (0: there are none)."""
    good = vectors.where(finite(vector_col) & (F.size(vector_col) > 0))
    widths = good.groupBy(F.size(vector_col).alias("width")).agg(F.count("*").alias("n"))
    common = widths.orderBy(F.desc("n"), F.desc("width")).first()
    width = common["width"] if common else 0
    return good.where(F.size(vector_col) == width), width


def _fitted(good: DataFrame, width: int, vector_col: str) -> Whitening:
    only = good.select(vector_col)
    plain = _added(only, _plain_sums(width))
    n, sums = plain[-1, -1], [plain.get((i, i), 0) for i in range(width)]
    square = _added(only, _square_sums(n, sums))
    v = np.empty((width, width))
    for i in range(width):
        v[i, i] = square.get((i, i), 0) / n**3  # quotients of whole numbers, rounded once
        for j in range(i + 1, width):
            twice = square.get((i, j), 0) - square.get((i, i), 0) - square.get((j, j), 0)
            v[i, j] = v[j, i] = twice / (2 * n**3)
    values, columns = np.linalg.eigh(v)
    return Whitening(n, sums, v, values[::-1], columns[:, ::-1])


def fit(vectors: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """Covariance and components of all usable vectors; None where there are none."""
    good, width = usable(vectors, vector_col)
    return _fitted(good, width, vector_col) if width else None


def _whitened(x: np.ndarray, model: Whitening, weights: np.ndarray) -> np.ndarray:
    y = centred(x, model.n, model.sums)
    return (y / model.n).astype(np.float64) @ weights


def _identity_error(good: DataFrame, model: Whitening, k: int, vector_col: str) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over components that vary."""
    weights = model.projection(k)[:, model.has_variance(k)]
    size = weights.shape[1]
    if not size:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for x in _blocks(batches):
            w = _whitened(x, model, weights)  # centred already
            total += w.T @ w
        i, j = np.divmod(np.arange(size * size), size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "value"])

    rows = good.select(vector_col).mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("v"))
    found = np.zeros((size, size))
    for i, j, value in rows.collect():  # at most k * k
        found[i, j] = value / model.n
    return float(np.abs(found - np.eye(size)).max())


def deviations(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, None where no long holds it."""
    if y.dtype == object:
        return [s if s < 1 << 63 else None for s in map(int, (y * y).sum(axis=1))]
    with np.errstate(over="ignore"):
        wrapped = np.einsum("ij,ij->i", y, y)  # right modulo 2 ** 64
    real = y.astype(np.float64)
    fits = (np.einsum("ij,ij->i", real, real) < 2.0**63 * (1 + 1e-6)) & (wrapped >= 0)
    return [s if ok else None for s, ok in zip(wrapped.tolist(), fits.tolist(), strict=True)]


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every usable row projected on the first `k` components: id, component, n, deviation, whitened, explained, identity_error."""
    good, width = usable(vectors, vector_col)
    out = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {out}"
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    model = _fitted(good, width, vector_col)
    error = _identity_error(good, model, k, vector_col)
    weights, explained = model.projection(k), model.explained(k)
    size = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = whole_numbers(as_matrix(part.column(1)))
                again = np.repeat(np.arange(len(x)), size)
                columns = [
                    part.column(0).take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, size + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(again), model.n)),
                    pa.array(deviations(centred(x, model.n, model.sums)), pa.int64()).take(pa.array(again)),
                    pa.array(_whitened(x, model, weights).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(again), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.select(id_col, vector_col).mapInArrow(run, schema)
