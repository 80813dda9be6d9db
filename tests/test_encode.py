import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docvec.operators.encode import encode_chunks, encode_windows, onnx_encoder


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, [f"w{j}" for j in range(i)]) for i in range(1, 80)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").withColumn("chunk_id", F.lit(0))


def hashed(tokens, dims):
    vector = [0.0] * dims
    for token in tokens:
        digest = hashlib.md5(token.encode()).hexdigest()
        vector[int(digest[:8], 16) % dims] += 1 if int(digest[8], 16) % 2 == 0 else -1
    return vector


@pytest.mark.parametrize("dims", [64, 7])
def test_hashing(chunks, dims):
    rows = encode_chunks(chunks, dims=dims).join(chunks.select("doc_id", "tokens"), "doc_id").collect()
    assert len(rows) == 79
    for row in rows:
        assert list(row["embedding"]) == hashed(row["tokens"], dims)


def test_hashing_moves_no_data(chunks):
    plan = encode_chunks(chunks).where("embedding is not null")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_hashing_over_many_batches(spark):
    """Slices of a column are read at their own place."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        chunks = spark.range(40).select("id", F.array(F.concat(F.lit("t"), "id")).alias("tokens"))
        for row in encode_chunks(chunks, dims=16).collect():
            assert list(row["embedding"]) == hashed([f"t{row['id']}"], 16)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_plugin_drops_only_failed_and_empty_chunks(spark, chunks):
    def counting_encoder():
        def encode(batch):
            assert 0 < len(batch) <= 32
            if any(len(chunk) % 10 == 0 for chunk in batch):
                raise ValueError("a chunk it cannot take")
            return np.array([[len(chunk), 1.0] for chunk in batch])

        return encode

    empty = spark.createDataFrame([(1000, [], 0), (1001, None, 0)], "doc_id long, tokens array<string>, chunk_id int")
    rows = encode_chunks(chunks.unionByName(empty), counting_encoder).collect()
    assert {r["doc_id"]: list(r["embedding"]) for r in rows} == {
        i: [float(i), 1.0] for i in range(1, 80) if i % 10
    }


def test_chunks_can_be_dealt_out(chunks):
    dealt = encode_chunks(chunks.coalesce(1), dims=8, tasks=5)
    assert dealt.select(F.spark_partition_id()).distinct().count() == 5
    assert sorted(dealt.collect()) == sorted(encode_chunks(chunks, dims=8).collect())


def test_an_encoder_that_loses_rows_is_an_error(chunks):
    """The batch fails and its chunks are tried alone."""
    vectors = encode_chunks(chunks, lambda: lambda batch: np.ones((1, 2)))
    assert vectors.count() == 79


# --- a model file, written field by field ------------------------------------------


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor_type(name, kind, rank):
    shape = b"".join(field(1, field(2, f"{name}{i}")) for i in range(rank))
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def summing_model(table):
    """last_hidden_state[:, 0] = sum of the table rows of all pieces."""
    int64, float32 = 7, 1
    gather = field(1, "table") + field(1, "input_ids") + field(2, "rows") + field(4, "Gather")
    axes = field(5, field(1, "axes") + field(8, 1) + field(20, 7))
    total = field(1, "rows") + field(2, "last_hidden_state") + field(4, "ReduceSum") + axes
    weights = b"".join(field(1, n) for n in table.shape) + field(2, float32) + field(8, "table")
    weights += field(9, table.astype("<f4").tobytes())
    graph = field(1, gather) + field(1, total) + field(2, "g") + field(5, weights)
    graph += field(11, tensor_type("input_ids", int64, 2)) + field(12, tensor_type("last_hidden_state", float32, 3))
    return field(1, 7) + field(7, graph) + field(8, field(2, 11))


VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "um", "dois", "tre", "##s", "acao"]


def test_onnx_encoder(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    pytest.importorskip("tokenizers")
    table = np.arange(len(VOCAB) * 3, dtype=float).reshape(-1, 3) ** 2
    table[0] = 0
    (tmp_path / "model.onnx").write_bytes(summing_model(table))
    (tmp_path / "vocab.txt").write_text("\n".join(VOCAB))
    rows = [(0, ["um", "dois"]), (1, ["tres", "xyz"]), (2, ["ação"]), (3, ["um"] * 600)]
    chunks = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    make = onnx_encoder(os.fspath(tmp_path / "model.onnx"), os.fspath(tmp_path / "vocab.txt"))
    found = {r["doc_id"]: np.array(r["embedding"]) for r in encode_chunks(chunks, make).collect()}
    marks = [2, 2, 3, 3]
    expected = {0: marks + [5, 6], 1: marks + [7, 8, 1], 2: marks + [9], 3: [2, 2, 3] + [5] * 509}
    for doc_id, pieces in expected.items():
        np.testing.assert_allclose(found[doc_id], table[pieces].sum(axis=0), rtol=1e-5)


def test_windows_of_a_row_are_joined_by_their_tokens(spark):
    def counting():
        def encode(batch):
            if any("bad" in w for w in batch):
                raise ValueError("bad")
            return np.array([[len(w), float(w[1][1:])] for w in batch])

        return encode

    rows = [(1, ["t5"]), (2, ["t1", "t2", "t3", "t4"]), (3, ["t1", "t1", "t1", "bad"]), (4, []), (5, None)]
    chunks = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    found = {r["doc_id"]: (r["n_windows"], r["n_failed"], r["embedding"]) for r in encode_windows(chunks, counting, 5).collect()}
    assert found == {1: (1, 0, [3.0, 5.0]), 2: (2, 0, [4.5, 1.75]), 3: (2, 1, None), 4: (0, 0, None), 5: (0, 0, None)}
    marked = encode_chunks(chunks, counting, marked=True)
    assert marked.columns == ["doc_id", "embedding"] and sorted(r["doc_id"] for r in marked.collect()) == [1, 2]
    plan = encode_windows(chunks, counting).where("embedding is not null")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_windows_become_python_lists_a_few_rows_at_once():
    """A batch of 10,000 texts was one list of lists before."""
    import pyarrow as pa

    from docvec.operators.encode import _few_at_once

    rows = [[["a"] * 30] * (i % 4) if i % 5 else None for i in range(200)] + [[["b"] * 30] * 40]
    column = pa.array(rows, pa.list_(pa.list_(pa.string())))
    parts = list(_few_at_once(column, 300))
    assert [w for part in parts for w in part] == [r or [] for r in rows]
    assert all(sum(len(w) for r in part for w in r) <= 300 or len(part) == 1 for part in parts)
    assert [w for part in _few_at_once(column.slice(7, 50), 300) for w in part] == [r or [] for r in rows[7:57]]
    assert list(_few_at_once(column.slice(0, 0), 300)) == []
