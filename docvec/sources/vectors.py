"""Stored vectors: one Parquet table, one row per chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEYS = ["doc_id", "chunk_id"]


def write_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    vectors.write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def listed_vectors(listing: DataFrame, vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Vectors the listing names and the table holds."""
    return listing.join(vectors, keys or KEYS)


def missing_vectors(listing: DataFrame, vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Listed vectors the table does not hold; a build skips them.

    Keys are made distinct in the map tasks first, so one that fills much of the table
    is sent once per task.
    """
    on = keys or KEYS
    return listing.join(vectors.select(*on).distinct(), on, "left_anti")
