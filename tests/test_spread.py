from pyspark.sql import functions as F

from docvec.plans import tables as T
from docvec.session import spread


def test_a_file_of_one_large_row_group_is_dealt_out(spark, tmp_path):
    """Its cuts by bytes are many, but all rows lie in one of them: one task did all the work."""
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "4096")
        scan = spark.read.parquet(f"{tmp_path}/one")
        cores = spark.sparkContext.defaultParallelism
        assert scan.rdd.getNumPartitions() > cores
        per_task = [r["n"] for r in spread(scan).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(per_task) == 4000 and max(per_task) < 2 * 4000 / cores
        even = spark.read.parquet(f"{tmp_path}/one").limit(0)
        assert spread(even).count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_ids_are_told_before_texts_are_encoded(spark, tmp_path):
    """Each part of the documents was taken from the vectors of all of them."""
    texts = [(i, f"word{i} and more") for i in range(12)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    some = T.document_vectors(spark, str(tmp_path), F.col("doc_id") % 3 == 1)
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("ArrowEvalPython") < plan.index("% 3")
    whole = T.document_vectors(spark, str(tmp_path)).where("doc_id % 3 = 1")
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.collect()))
