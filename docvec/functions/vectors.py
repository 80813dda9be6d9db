"""Vector expressions: squared L2 distance and signed feature hashing."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIMS = 64


def l2_squared(a: Column, b: Column) -> Column:
    """Squared L2 distance of two float arrays, summed in double in index order."""

    def square(x: Column, y: Column) -> Column:
        diff = x.cast("double") - y.cast("double")
        return diff * diff

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda total, v: total + v)


def finite(name: str) -> Column:
    """Whether a vector column is there and holds numbers only: no null, NaN or infinity."""
    numbers = F.forall(F.col(name), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(name).isNotNull() & F.coalesce(numbers, F.lit(False))


def as_matrix(column: pa.Array) -> np.ndarray:
    """A list<float> Arrow column without nulls as a float64 matrix; an error when widths differ."""
    if len(column) == 0:
        return np.empty((0, 0))
    widths = np.diff(column.offsets.to_numpy())
    if (widths != widths[0]).any():
        raise ValueError(f"vectors of width {widths.min()} to {widths.max()}, expected one width")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def exact_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise squared L2 distance with the same additions, in the same order, as `l2_squared`."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        diff = a[:, i] - b[..., i]
        total += diff * diff
    return total


def l2_squared_to(vector: np.ndarray) -> Callable[[Column], Column]:
    """Column function for the distance to one fixed vector, a whole Arrow batch at a time.

    Same values as `l2_squared`, without sending the fixed vector along with every row.
    """
    target = np.asarray(vector, dtype=np.float64)

    @F.arrow_udf("double")
    def distance(embedding: pa.Array) -> pa.Array:
        vectors = as_matrix(embedding)
        if len(vectors) and vectors.shape[1] != len(target):
            raise ValueError(f"vectors of width {vectors.shape[1]}, query of width {len(target)}")
        return pa.array(exact_l2(vectors, target))

    return distance


def _token_codes(words: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each word."""
    heads = b"".join(md5(word.as_buffer()).digest()[:5] for word in words)
    heads = np.frombuffer(heads, dtype=np.uint8).reshape(-1, 5)
    bucket = np.ascontiguousarray(heads[:, :4]).view(">u4").ravel().astype(np.int64) % dims
    return bucket, 1.0 - 2.0 * ((heads[:, 4] >> 4) & 1)


def hashing_vector(tokens: Column, dims: int = HASH_DIMS) -> Column:
    """Signed feature hashing of a token list: lexical, not semantic.

    Bucket: the first 8 hex digits of md5(token), modulo `dims`. Sign: + when the
    ninth digit is even. A batch hashes each of its distinct tokens once and scatters
    them into a dense matrix; a chunk is hashed where it lies, without a shuffle.
    """

    @F.arrow_udf("array<float>")
    def scatter(tokens: pa.Array) -> pa.Array:
        rows = len(tokens)
        words = tokens.flatten().dictionary_encode()
        bucket, sign = _token_codes(words.dictionary, dims)
        word = words.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(rows), np.diff(tokens.offsets.to_numpy()))
        dense = np.bincount(row * dims + bucket[word], weights=sign[word], minlength=rows * dims)
        ends = np.arange(0, rows * dims + 1, dims, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(dense.astype(np.float32)))

    # So marked, a filter on the vector stays above it and no chunk is encoded twice.
    return scatter.asNondeterministic()(tokens)
