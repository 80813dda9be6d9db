"""Intermediate tables that outlive lost executors.

They are written to the shared folder the session names in `spark.checkpoint.dir`;
reading them back cuts the lineage and gives Catalyst the true size of the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, label: str) -> str:
    root = spark.conf.get(_SETTING, None)
    if not root:
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    return f"{root.rstrip('/')}/docvec/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet and return the stored table."""
    return _store(df, scratch_path(df.sparkSession, label))


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """`materialize` for a table that is needed only inside the block and goes with it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    try:
        yield _store(df, path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
