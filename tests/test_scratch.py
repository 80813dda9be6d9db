import os

from docvec.scratch import materialize, scratch_path, staged
from docvec.session import spread


def files_of(df):
    return [f.removeprefix("file://") for f in df.inputFiles()]


def test_tables_go_to_the_folder_the_session_names(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(f"{root}/docvec/") and scratch_path(spark, "x") != scratch_path(spark, "x")
    stored = materialize(spark.range(5), "numbers")
    assert all(f.startswith(root) for f in files_of(stored)) and stored.count() == 5


def test_staged_tables_go_with_their_block(spark):
    kept = materialize(spark.range(3), "kept")
    with staged(spark.range(5), "numbers") as table:
        files = files_of(table)
        assert files and all(map(os.path.exists, files)) and table.count() == 5
    assert not any(map(os.path.exists, files)) and kept.count() == 3


def test_spread_leaves_tables_of_many_pieces(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(10_000).repartition(40).write.option("maxRecordsPerFile", 10).parquet(f"{tmp_path}/many")
    one, many = spark.read.parquet(f"{tmp_path}/one"), spark.read.parquet(f"{tmp_path}/many")
    assert spread(one).rdd.getNumPartitions() == 8
    assert spread(many) is many
