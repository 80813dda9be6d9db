import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docvec.functions.vectors import exact_l2, l2_squared
from docvec.operators import search as K
from docvec.operators.index import VectorIndex
from docvec.operators.topk import NearestRows


def brute_force(queries, ids, vectors, k):
    """Plain loops: distances added in index order, ties by id."""
    rows = []
    for q, query in enumerate(queries):
        hits = []
        for vec_id, vector in zip(ids, vectors):
            total = 0.0
            for a, b in zip(vector, query):
                diff = float(a) - float(b)
                total += diff * diff
            hits.append((total, int(vec_id)))
        rows += [(q, vec_id, distance) for distance, vec_id in sorted(hits)[:k]]
    return rows


def nearest(queries, batches, k):
    kept = NearestRows(np.asarray(queries, dtype=float), k)
    for ids, vectors in batches:
        kept.offer(np.asarray(ids), np.asarray(vectors, dtype=float))
    query, vec_id, distance = kept.rows()
    return list(zip(query.tolist(), vec_id.tolist(), distance.tolist()))


def make(seed, n, d, kind):
    rng = np.random.default_rng(seed)
    if kind == "whole":  # many ties
        return rng.integers(-2, 3, (n, d)).astype(float)
    if kind == "copies":  # a third is one vector
        x = rng.normal(size=(n, d)).astype(np.float32).astype(float)
        x[rng.random(n) < 0.34] = x[0]
        return x
    if kind == "far":  # close together, far from zero: estimates cancel
        return (1e4 + rng.normal(scale=1e-3, size=(n, d))).astype(np.float32).astype(float)
    return rng.normal(size=(n, d)).astype(np.float32).astype(float)


@settings(max_examples=60, deadline=None)
@given(
    st.integers(0, 10**6),
    st.sampled_from(["whole", "copies", "far", "normal"]),
    st.integers(1, 6),
    st.integers(1, 9),
    st.integers(1, 40),
)
def test_nearest_rows_are_exact(seed, kind, k, d, per_batch):
    x = make(seed, 60, d, kind)
    ids = np.random.default_rng(seed + 1).permutation(60)
    batches = [(ids[i : i + per_batch], x[i : i + per_batch]) for i in range(0, 60, per_batch)]
    queries = np.vstack([x[:10], make(seed + 2, 5, d, kind)])
    assert nearest(queries, batches, k) == brute_force(queries, ids, x, k)


def test_many_tied_candidates_stay_exact(monkeypatch):
    monkeypatch.setattr("docvec.operators.topk._PAIRS", 7)
    monkeypatch.setattr("docvec.operators.topk._BLOCK_CELLS", 50)
    x = make(3, 50, 2, "whole")
    assert nearest(x, [(np.arange(50), x)], 4) == brute_force(x, range(50), x, 4)


def index_of(spark, x, partitions=3):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(partitions)
    return VectorIndex(vectors, len(x[0]), len(x))


def queries_of(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "query_id long, embedding array<float>")


@pytest.mark.parametrize("kind", ["whole", "copies", "far"])
@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_bytes": 100}, {"broadcast_bytes": 0}])
def test_knn_join(spark, kind, sizes):
    x = make(1, 80, 5, kind)
    hits = K.knn_join(index_of(spark, x), queries_of(spark, x[:30]), 4, **sizes).orderBy("query_id", "rank")
    found = [(r["query_id"], r["vec_id"], r["distance"]) for r in hits.collect()]
    assert found == brute_force(x[:30], range(80), x, 4)


def test_cells_follow_queries_and_cores_not_the_index(spark):
    few = K.cells_of(spark, 10 << 20, 128 << 20)
    assert few == (1, 16) and K.cells_of(spark, 1 << 30, 128 << 20) == (8, 2) and K.cells_of(spark, 1 << 40, 128 << 20) == (8192, 1)
    x = make(3, 300, 4, "normal")
    for n in (20, 300):  # index rows
        plan = K.knn_join(index_of(spark, x[:n]), queries_of(spark, x[:50]), 2, broadcast_bytes=0, block_bytes=400)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in text and "Join" not in text and "shufflepartitionidpassthrough" in text.lower().replace("_", "")
        assert "cell" in text and ", 16)" in text or ", 16," in text


def test_vectors_stream_past_their_queries(spark):
    """Cells one after the other in a task, cut into batches anywhere."""
    x, q = make(4, 60, 3, "normal"), make(6, 10, 3, "normal")
    batches = []
    for cell in (3, 7):
        for is_vector, ids, m in ((False, np.arange(10) + 100 * cell, q), (True, np.arange(60), x)):
            for at in range(0, len(m), 7):
                part = m[at : at + 7].astype(np.float32)
                batches.append(
                    pa.RecordBatch.from_pydict(
                        {"cell": [cell] * len(part), "is_vector": [is_vector] * len(part), "id": ids[at : at + 7], "embedding": part.tolist()}
                    )
                )
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()
    for given in (batches, whole):
        rows = [r for b in K._nearest_in_cells(2)(iter(given)) for r in b.to_pylist()]
        assert len(rows) == 40 and {r["query_id"] // 100 for r in rows} == {3, 7}
        assert {(r["query_id"] % 100, r["vec_id"]) for r in rows if r["query_id"] < 700} == {(r["query_id"] % 100, r["vec_id"]) for r in rows if r["query_id"] >= 700}
    alone = [b for b in batches if b["is_vector"][0].as_py()]
    assert list(K._nearest_in_cells(2)(iter(alone))) == []


def test_search_is_a_knn_join_of_one(spark):
    x = make(5, 40, 6, "normal")
    index = index_of(spark, x)
    for i in range(3):
        one = [(r["vec_id"], r["distance"]) for r in K.search(index, x[i], 5).collect()]
        many = K.knn_join(index, queries_of(spark, x[i : i + 1]), 5).orderBy("rank").collect()
        assert one == [(r["vec_id"], r["distance"]) for r in many]
        assert [r["rank"] for r in many] == [1, 2, 3, 4, 5]


def test_distance(spark):
    pair = spark.range(1).select(l2_squared(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))))
    assert pair.first()[0] == 25.0
    a, b = make(1, 50, 64, "normal"), make(2, 50, 64, "normal")
    rows = [([float(v) for v in p], [float(v) for v in q]) for p, q in zip(a, b)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>").coalesce(1)
    assert [r[0] for r in df.select(l2_squared(F.col("a"), F.col("b"))).collect()] == exact_l2(a, b).tolist()


def test_fewer_vectors_than_asked(spark):
    assert K.search(index_of(spark, [[0.0, 1.0], [2.0, 3.0]]), [0.0, 1.0], 5).count() == 2


def test_ties_by_position(spark):
    index = index_of(spark, [[1.0], [2.0], [2.0], [2.0]])
    assert [r["vec_id"] for r in K.search(index, [2.0], 2).collect()] == [1, 2]


def test_self_query(spark):
    index = index_of(spark, [[5.0, 1.0], [0.0, 0.0], [5.0, 2.0]])
    assert [tuple(r) for r in K.self_query(index, 2).collect()] == [(0, 0.0), (2, 1.0)]


@pytest.mark.parametrize("query", [[[1.0, 2.0], [3.0, 4.0]], [1.0], [], [[[1.0, 2.0]]]])
def test_query_shape(spark, query):
    with pytest.raises(ValueError, match="expected one query"):
        K.search(index_of(spark, [[0.0, 1.0]]), query)


def test_query_rows(spark):
    index = index_of(spark, [[0.0, 1.0]])
    two = queries_of(spark, [[0.0, 1.0], [0.0, 2.0]])
    with pytest.raises(ValueError, match="expected one query"):
        K.search(index, two)
    with pytest.raises(ValueError, match="expected one query"):
        K.search(index, two.where("query_id > 5"))
    with pytest.raises(ValueError, match="width 3"):
        K.knn_join(index, queries_of(spark, [[0.0, 1.0, 2.0]]))
    assert K.search(index, two.where("query_id = 1")).first()["distance"] == 1.0
    assert K.knn_join(index, two.where("query_id > 5")).count() == 0


def test_a_scan_fails_on_other_widths(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    index = VectorIndex(vectors.coalesce(1), 2, 2)
    with pytest.raises(Exception, match="width 1 to 3"):
        K.search(index, [0.0, 1.0]).collect()
    with pytest.raises(Exception, match="vectors of width 1, query of width 2"):
        K.search(VectorIndex(vectors.where("vec_id = 0"), 2, 1), [0.0, 1.0]).collect()
    with pytest.raises(Exception, match="width 1 to 3"):
        K.knn_join(index, queries_of(spark, [[0.0, 1.0]])).collect()


def test_metadata(spark):
    hits = K.search(index_of(spark, [[0.0], [1.0], [2.0]]), [0.0], 3)
    meta = spark.createDataFrame([(0, "a", 1), (1, None, 2), (9, "c", 3)], "vec_id long, name string, doc int")
    found = {r["vec_id"]: tuple(r)[2:] for r in K.attach_metadata(hits, meta, ["name", "doc"]).collect()}
    assert found == {0: ("a", 1, True), 1: (None, 2, False), 2: (None, None, False)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    index_of(spark, make(1, 50, 4, "normal")).vectors.write.parquet(path)
    index = VectorIndex(spark.read.parquet(path).withColumn("note", F.lit("x")), 4, 50)
    one = plan_of(K.search(index, [0.0] * 4, 3))
    assert "TakeOrderedAndProject" in one and "Exchange" not in one
    many = plan_of(K.knn_join(index, queries_of(spark, [[0.0] * 4]), 3))
    assert many.count("Exchange") == 1 and many.count("WindowGroupLimit") == 2
    for plan in (one, many):
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_vectors_without_a_distance_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(100)] + [(100, [float("nan"), 1.0]), (101, [float("inf"), 0.0]), (102, [None, 1.0]), (103, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = VectorIndex(table, 2, 104)
    one = [(r["vec_id"], r["distance"]) for r in K.search(index, [3.0, 1.0]).collect()]
    queries = spark.createDataFrame([(7, [3.0, 1.0]), (8, [float("nan"), 0.0])], "query_id long, embedding array<float>")
    for sizes in ({}, {"broadcast_bytes": 0}):
        many = K.knn_join(index, queries, **sizes).orderBy("rank").collect()
        assert [(r["vec_id"], r["distance"]) for r in many] == one and len(one) == 5


def test_a_query_id_that_comes_twice_is_an_error(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    twice = spark.createDataFrame([(5, [1.0]), (5, [2.0])], "query_id long, embedding array<float>")
    with pytest.raises(ValueError, match="query_id"):
        K.knn_join(VectorIndex(table, 1, 2), twice)


def test_more_blocks_of_queries_do_not_multiply_the_vectors(spark, monkeypatch):
    """Vectors were copied to every block of queries in the shuffle; now each is stored in one pack, read by all cells."""
    monkeypatch.setattr(K, "PACK_BYTES", 200)
    x = make(9, 90, 4, "copies")
    wide = index_of(spark, x)
    for kind in ("float", "double"):
        index = VectorIndex(wide.vectors.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")), 4, 90)
        hits = K.knn_join(index, queries_of(spark, x[:60]), 3, broadcast_bytes=0, block_bytes=64)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan
        found = [(r["query_id"], r["vec_id"], r["distance"]) for r in hits.orderBy("query_id", "rank").collect()]
        assert found == brute_force(x[:60], range(90), x, 3)
    mixed = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="width"):
        K.knn_join(VectorIndex(mixed, 2, 2), queries_of(spark, [[0.0, 1.0]]), 1, broadcast_bytes=0).collect()


def test_a_worker_holds_little_beside_its_queries(spark):
    """Estimates and pairs to score again once took some hundred MB in each worker."""
    import tracemalloc

    x = np.random.default_rng(3).integers(0, 2, (6000, 64)).astype(np.float64)  # many near ties
    nearest = NearestRows(x[:2000], 5)
    tracemalloc.start()
    try:
        nearest.offer(np.arange(4000), x[2000:])
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
    assert K.BROADCAST_BYTES <= 16 << 20
