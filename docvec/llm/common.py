"""What the operators of this package share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvec.session import small_batches as bounded_batches  # noqa: F401

LOWEST_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def fold(id_col: str) -> Column:
    """crc32 of an id written as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array) -> list[str]:
    return [v or "" for v in column.to_pylist()]


def raw_bytes(column: pa.Array):
    """The values of a binary column without nulls, one at a time, as bytes."""
    return (v.as_buffer().to_pybytes() if v.is_valid else b"" for v in column)


def table_of_terms(kept: bytes) -> bytes:
    """A table for bytes.translate: A-Z as a-z, other kept bytes as they are, the rest as blanks."""
    return bytes(b if b in kept else 32 for b in range(256)).translate(bytes(range(256)).lower())


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n in 64 bits; kept up to the size of usual texts."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 1 << 22:
            _powers[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with all their bits stirred; the argument is written over."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def run_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs codes[begin:end], equal for equal runs: a polynomial from prefix sums, mixed."""
    n = len(codes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * _power_table(_BASE, n)[:n], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * _power_table(_INVERSE, n)[begin])
