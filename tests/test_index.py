import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from docvec.operators import index as V
from docvec.sources import versions
from docvec.sources import vectors as R


def vectors(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, chunk_id int, embedding array<float>")


def keyed(df):
    return {(r["doc_id"], r["chunk_id"]): r["vec_id"] for r in df.collect()}


def test_positions_of_a_document_that_is_most_of_the_table(spark):
    n = 3000
    doc = F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(100))
    rows = spark.range(n, numPartitions=8).select(doc.alias("doc_id"), F.col("id").cast("int").alias("chunk_id"))
    placed = V.index_positions(rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    files = {f.split("positions-")[1] for f in placed.inputFiles() if "positions-" in f}
    found = keyed(placed)
    assert [found[key] for key in sorted(found)] == list(range(n))
    assert len(files) > 4


def test_no_task_holds_all_positions(spark):
    placed = V.index_positions(vectors(spark, [(1, 0, [1.0])]))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_widths(spark):
    two, three = (1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0, 3.0])
    assert V.build_index(vectors(spark, [two])).dimension == 2
    with pytest.raises(ValueError, match="width 2 to 3"):
        V.build_index(vectors(spark, [two, three]))
    with pytest.raises(ValueError, match="expected 3"):
        V.build_index(vectors(spark, [two]), dimension=3)
    with pytest.raises(ValueError, match="no vectors"):
        V.build_index(vectors(spark, []))
    found = {r["dimension"]: r["n"] for r in V.dimension_check(vectors(spark, [two, two, three])).collect()}
    assert found == {2: 2, 3: 1}


def test_unknown_metric(spark):
    with pytest.raises(ValueError, match="cosine"):
        V.build_index(vectors(spark, [(1, 0, [1.0])]), metric="cosine")


def test_add(spark):
    index = V.build_index(vectors(spark, [(2, 0, [1.0]), (1, 1, [2.0]), (1, 0, [3.0])]))
    index = V.add_vectors(index, vectors(spark, [(1, 1, [9.0]), (0, 0, [4.0]), (3, 0, [5.0])]))
    assert index.n_vectors == 5
    assert keyed(index.vectors) == {(1, 0): 0, (1, 1): 1, (2, 0): 2, (0, 0): 3, (3, 0): 4}
    assert V.add_vectors(index, vectors(spark, [(0, 0, [4.0])])).n_vectors == 5
    with pytest.raises(ValueError):
        V.add_vectors(index, vectors(spark, [(7, 0, [4.0, 5.0])]))


def test_save_load_append(spark, tmp_path):
    path = f"{tmp_path}/index"
    V.save_index(V.build_index(vectors(spark, [(1, 0, [1.0, 2.0]), (2, 0, [3.0, 4.0])])), path)
    index = V.open_index(spark, path)
    assert (index.dimension, index.n_vectors, index.metric) == (2, 2, "l2sq")
    assert [tuple(r) for r in index.vectors.orderBy("vec_id").collect()] == [
        (0, 1, 0, [1.0, 2.0]),
        (1, 2, 0, [3.0, 4.0]),
    ]
    delta = vectors(spark, [(2, 0, [3.0, 4.0]), (0, 0, [5.0, 6.0])])
    for _ in range(2):  # the second time nothing is new
        index = V.append_to_saved(spark, delta, path)
        assert index.n_vectors == V.open_index(spark, path).n_vectors == 3
    assert keyed(index.vectors) == {(1, 0): 0, (2, 0): 1, (0, 0): 2}


def test_save_back_and_failures(spark, tmp_path):
    path = f"{tmp_path}/index"
    V.save_index(V.build_index(vectors(spark, [(1, 0, [1.0]), (2, 0, [2.0])])), path)
    V.save_index(V.add_vectors(V.open_index(spark, path), vectors(spark, [(3, 0, [3.0])])), path)
    assert keyed(V.open_index(spark, path).vectors) == {(1, 0): 0, (2, 0): 1, (3, 0): 2}
    broken = V.open_index(spark, path)
    broken = V.VectorIndex(broken.vectors.withColumn("bad", F.raise_error(F.lit("lost"))), 1, 3)
    with pytest.raises(Exception, match="lost"):
        V.save_index(broken, path)
    assert V.open_index(spark, path).vectors.count() == 3  # the old one is still there
    number, note = versions.latest(spark, path)
    versions.commit(spark, path, number, note)
    with pytest.raises(versions.ConcurrentWrite, match="another writer"):
        versions.commit(spark, path, number, note)
    with open(f"{path}/versions/.lost", "w") as f:
        f.write('{"dimen')  # a writer lost in the middle
    assert versions.latest(spark, path)[0] == number + 1
    assert V.append_to_saved(spark, vectors(spark, [(4, 0, [4.0])]), path).n_vectors == 4


def rows_of(index):
    return sorted(tuple(r) for r in index.vectors.select("vec_id", "doc_id", "chunk_id").collect())


def test_a_second_writer_fails_and_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/index"
    V.save_index(V.build_index(vectors(spark, [(1, 0, [1.0])])), path)
    V.append_to_saved(spark, vectors(spark, [(2, 0, [2.0])]), path)
    before = set(os.listdir(f"{path}/data"))
    with pytest.raises(versions.ConcurrentWrite):
        V.append_to_saved(spark, vectors(spark, [(3, 0, [3.0])]), path, after=1)
    assert set(os.listdir(f"{path}/data")) == before and not [f for f in os.listdir(f"{path}/versions") if f.startswith(".") and "crc" not in f]
    assert rows_of(V.open_index(spark, path)) == [(0, 1, 0), (1, 2, 0)]
    assert rows_of(V.append_to_saved(spark, vectors(spark, [(3, 0, [3.0])]), path)) == [(0, 1, 0), (1, 2, 0), (2, 3, 0)]


def test_of_many_writers_one_wins(spark, tmp_path):
    path = f"{tmp_path}/thing"

    def write(i):
        try:
            return versions.commit(spark, path, 0, {"writer": i, "folders": []})
        except versions.ConcurrentWrite:
            return None

    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(write, range(8)))
    assert [m for m in made if m] == [1]
    assert versions.latest(spark, path) == (1, {"writer": made.index(1), "folders": []})


def test_readers_outlive_saves(spark, tmp_path):
    path = f"{tmp_path}/index"
    V.save_index(V.build_index(vectors(spark, [(1, 0, [1.0]), (2, 0, [2.0])])), path)
    reader = V.open_index(spark, path)
    V.save_index(V.build_index(vectors(spark, [(5, 0, [5.0])])), path)
    assert rows_of(reader) == [(0, 1, 0), (1, 2, 0)] and rows_of(V.open_index(spark, path)) == [(0, 5, 0)]
    with V.held_index(spark, path) as held:
        V.save_index(V.build_index(vectors(spark, [(6, 0, [6.0])])), path, retain_seconds=0)
        assert rows_of(held) == [(0, 5, 0)]  # the first version has gone, the held one has not
        assert len(os.listdir(f"{path}/data")) == 2
    os.makedirs(f"{path}/data/lost")
    assert len(versions.expire(spark, path, 0)) == 2 and rows_of(V.open_index(spark, path)) == [(0, 6, 0)]
    with pytest.raises(RuntimeError, match="build one first"), V.held_index(spark, f"{tmp_path}/none"):
        pass


def test_a_folder_without_the_keys_is_not_read(spark, tmp_path):
    path = f"{tmp_path}/index"
    V.save_index(V.build_index(vectors(spark, [(i, 0, [float(i)]) for i in range(200)])), path)
    V.append_to_saved(spark, vectors(spark, [(1000 + i, 0, [1.0]) for i in range(50)]), path)
    first = versions.latest(spark, path)[1]["folders"][0]
    for folder, _, files in os.walk(f"{first}/rows"):
        for f in files:
            if f.endswith(".parquet"):
                with open(f"{folder}/{f}", "wb") as out:
                    out.write(b"no rows here")
    index = V.append_to_saved(spark, vectors(spark, [(1003, 0, [2.0]), (5000, 0, [3.0]), (None, 7, [4.0])]), path)
    assert index.n_vectors == 252
    late = index.vectors.where("vec_id >= 250")
    with pytest.raises(Exception):  # a key of the broken folder
        V.append_to_saved(spark, vectors(spark, [(3, 0, [2.0])]), path)
    assert late is not None


def test_filters_rule_out_most_and_lose_none(spark):
    from docvec.operators import keyfilter as K

    keys = ["doc_id", "chunk_id"]
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("chunk_id"))
    filters = {"a": (K.key_filter(rows, keys, K.key_filter_bits(20_000)), K.key_filter_bits(20_000))}
    narrow = rows.select(F.col("doc_id").cast("int"), F.col("chunk_id").cast("long"))
    for low in (0, 7, 19_999):
        assert K.folders_with_keys(narrow.where(F.col("doc_id") == low), keys, filters) == ["a"]
    others = [spark.range(1).select(F.lit(100_000 + i).alias("doc_id"), F.lit(0).alias("chunk_id")) for i in range(12)]
    assert sum(bool(K.folders_with_keys(o, keys, filters)) for o in others) <= 1


def test_appends_are_merged(spark, tmp_path):
    path = f"{tmp_path}/index"
    V.save_index(V.build_index(vectors(spark, [(i, 0, [float(i)]) for i in range(8)])), path)
    for i in range(6):
        index = V.append_to_saved(spark, vectors(spark, [(100 + i, 0, [1.0])]), path, max_folders=3)
        assert len(versions.latest(spark, path)[1]["folders"]) <= 3
    assert rows_of(index) == [*((i, i, 0) for i in range(8)), *((8 + i, 100 + i, 0) for i in range(6))]
    assert V.append_to_saved(spark, vectors(spark, [(104, 0, [1.0])]), path).n_vectors == 14
    assert V.compact(spark, path) == 1 and rows_of(V.open_index(spark, path)) == rows_of(index)


def test_positions_with_a_hot_key(spark, tmp_path):
    """A third of the rows have one key, a third are equal altogether; no range holds more than its share."""
    n = 6000
    key = F.when(F.col("id") % 3 < 2, F.lit(7)).otherwise(F.col("id"))
    vector = F.array(F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("id")).cast("float"))
    spark.range(n, numPartitions=8).select(key.alias("doc_id"), F.lit(0).alias("chunk_id"), vector.alias("embedding")).write.parquet(f"{tmp_path}/v")
    placed = V.index_positions(spark.read.parquet(f"{tmp_path}/v"), stored=True)
    assert sorted(r["vec_id"] for r in placed.collect()) == list(range(n))
    ranges = [f for f in placed.inputFiles() if "positions-" in f]
    sizes = [spark.read.parquet(f).count() for f in ranges]
    assert len(sizes) >= 6 and max(sizes) < 2 * n / len(sizes)


def test_lookup_reads_only_its_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PIECE_ROWS", 10)
    path = f"{tmp_path}/index"
    V.save_index(V.build_index(vectors(spark, [(i, 0, [float(i)]) for i in range(95)])), path)
    index = V.append_to_saved(spark, vectors(spark, [(200 + i, 0, [1.0]) for i in range(20)]), path)
    found = V.lookup(index, spark.createDataFrame([(3,), (97,), (97,), (400,)], "vec_id long"), ["doc_id"])
    assert sorted(tuple(r) for r in found.collect()) == [(3, 3), (97, 202)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_piece#" in plan and "PartitionFilters: [_piece" in plan.replace("isnotnull", "_piece")
    built = V.build_index(vectors(spark, [(5, 0, [1.0])]))
    assert V.lookup(built, spark.createDataFrame([(0,)], "vec_id long"), ["doc_id"]).collect()[0]["doc_id"] == 5


def test_repeated_and_null_keys_in_a_delta(spark):
    index = V.build_index(vectors(spark, [(1, 0, [1.0])]))
    delta = vectors(spark, [(2, 0, [5.0]), (2, 0, [4.0]), (None, 0, [7.0]), (None, 0, [6.0]), (1, 0, [9.0])])
    for _ in range(2):
        index = V.add_vectors(index, delta)
        assert {(r["doc_id"], r["embedding"][0]) for r in index.vectors.collect()} == {(1, 1.0), (2, 4.0), (None, 6.0)}
        assert sorted(r["vec_id"] for r in index.vectors.collect()) == [0, 1, 2]


def test_nothing_saved(spark, tmp_path):
    path = f"{tmp_path}/none"
    with pytest.raises(RuntimeError, match="build one first"):
        V.open_index(spark, path)
    with pytest.raises(ValueError, match="dimension"):
        V.load_index(spark, path)
    empty = V.load_index(spark, path, 2)
    assert (empty.dimension, empty.n_vectors, empty.vectors.count()) == (2, 0, 0)
    assert V.add_vectors(empty, vectors(spark, [(1, 0, [1.0, 2.0])])).n_vectors == 1
    with pytest.raises(RuntimeError):
        V.save_index(None, path)


def test_stored_vectors_and_listing(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    R.write_vectors(vectors(spark, [(1, 0, [1.0])]), path)
    R.write_vectors(vectors(spark, [(1, 1, [2.0])]), path)
    stored = R.read_vectors(spark, path)
    listing = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, chunk_id int")
    assert stored.count() == R.listed_vectors(listing, stored).count() == 2
    assert [tuple(r) for r in R.missing_vectors(listing, stored).collect()] == [(2, 0)]
