"""A local session for tests, the bench and trying things out; a cluster brings its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app_name: str = "docvec") -> SparkSession:
    partitions = str(cores) if str(cores).isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    if not spark.conf.get("spark.checkpoint.dir", None):  # one machine, so its own folder is shared
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docvec-"))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_UNEVEN = 2  # times its share of the rows that a task may have


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a table out to all cores when its file has too few pieces, or few that hold rows.

    For a plain table scan only. A Parquet file is cut by bytes, but its rows go to the cuts in which their row groups
    begin: one of few large row groups has many cuts, most of them empty. The rows of each cut are counted, for which no
    column is read; a table whose rows lie evenly stays as it lies and is not shuffled.
    """
    cores, cuts = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    if cuts < cores:
        return scan.repartition(cores)
    per_cut = scan.groupBy(F.spark_partition_id().alias("cut")).agg(F.count("*").alias("n"))
    most, rows = per_cut.agg(F.max("n"), F.sum("n")).first()
    return scan.repartition(cuts) if (most or 0) * cores > _UNEVEN * (rows or 0) else scan


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of 4 MB, not 64, so that a worker's memory doesn't follow the length of rows.

    A row beyond that comes alone. A session that has set the bound itself keeps its own.
    """
    if spark.conf.get(_BATCH) == "67108864b":  # Spark's default
        spark.conf.set(_BATCH, "4m")
