"""Bloom filters of the keys of stored rows, as tables: which folders may hold some keys.

A filter is a bitmap of a power of two of bits, ten to twenty a key, cut into pieces of 4 KB that are rows of a table. It
is built and asked by Spark's own functions and never comes together in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
BITS_PER_KEY = 10
# Fixed value: bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768


def key_filter_bits(n: int) -> int:
    return max(BITMAP_BITS, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length())


def _places(keys: list[str]) -> list[Column]:
    """Hashes of a key, equal for equal values of different integer types."""
    names = [F.col(k).cast("string") for k in keys]
    return [F.xxhash64(F.lit(i), *names) for i in range(HASHES)]


def key_filter(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """bucket and bitmap of the keys of all rows, made distinct in the map tasks."""
    at = F.explode(F.array(*(h.bitwiseAND(F.lit(bits - 1)) + 1 for h in _places(keys)))).alias("at")
    buckets = rows.select(at).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
    return buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1))


def folders_with_keys(delta: DataFrame, keys: list[str], filters: dict[str, tuple[DataFrame, int]]) -> list[str]:
    """Of folders with their filters and bits, those that may hold a key of `delta`.

    Every key asks every folder; there are few, since folders are merged.
    """
    tables = (table.withColumn("folder", F.lit(folder)) for folder, (table, _) in filters.items())
    bitmaps = reduce(DataFrame.unionByName, tables)
    folder = F.explode(F.create_map(*(F.lit(x) for f, (_, bits) in filters.items() for x in (f, bits))))
    names = [f"k{i}" for i in range(HASHES)]
    wanted = delta.select(*(h.alias(n) for h, n in zip(_places(keys), names))).distinct()
    asked = wanted.select(*names, folder.alias("folder", "bits"))
    at = F.explode(F.array(*(F.col(n).bitwiseAND(F.col("bits") - 1) + 1 for n in names)))
    probes = asked.select(F.xxhash64(*names).alias("key"), "folder", at.alias("at"))
    probes = probes.select("key", "folder", F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
    hits = probes.join(bitmaps, ["folder", "bucket"], "left")
    set_bits = F.sum(F.coalesce(_is_set(F.col("bitmap"), F.col("bit")), F.lit(0)))
    maybe = hits.groupBy("key", "folder").agg(set_bits.alias("n")).where(F.col("n") == HASHES)
    return [row[0] for row in maybe.select("folder").distinct().collect()]  # at most the folders
