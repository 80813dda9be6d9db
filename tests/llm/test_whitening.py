"""Whitening against exact fractions and plain numpy."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docvec.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k=8):
    """(n, deviations by row, whitened by row, explained) by Python's own numbers."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, width = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(width)]
    y = [[n * r[i] - s[i] for i in range(width)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(width)] for i in range(width)])
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1], columns[:, ::-1]
    whitened = (np.array(y, dtype=float) / n) @ columns[:, :k] / np.sqrt(values[:k])
    return n, [sum(c * c for c in r) for r in y], whitened, values[:k] / values.sum()


def compare(found, rows):
    n, deviation, whitened, explained = plain(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(found) == len(rows) * whitened.shape[1]
    for (i, _), d, w in zip(rows, deviation, whitened, strict=True):
        assert {r["deviation"] for r in by_id[i].values()} == {d} and {r["n"] for r in by_id[i].values()} == {n}
        assert sorted(by_id[i]) == list(range(1, len(w) + 1))
    got = np.array([[by_id[i][c + 1]["whitened"] for c in range(whitened.shape[1])] for i, _ in rows])
    for c in range(whitened.shape[1]):
        sign = np.sign(got[:, c] @ whitened[:, c])
        assert np.allclose(got[:, c] * sign, whitened[:, c], atol=1e-8)
        assert by_id[rows[0][0]][c + 1]["explained"] == pytest.approx(explained[c], rel=1e-9)
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9


def test_query_against_plain_numbers(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    compare(queries.op11_polarised_whitening(spark, sf).collect(), rows)


def test_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=3)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0])]
    compare(whitening.whiten(table(spark, rows + odd)).collect(), rows)


def test_repeated_rows_and_null_ids_stay(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [3.0, 1.0])]
    found = whitening.whiten(table(spark, rows)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in found if r["component"] == 1) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert {r["n"] for r in found} == {4}


def test_no_vectors_and_no_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        found = whitening.whiten(table(spark, rows)).collect()
        assert {(r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in found} == {(0.0, 0, 0.0, 0.0)}
    line = whitening.whiten(table(spark, [(i, [float(i), float(2 * i)]) for i in range(6)])).collect()
    assert {r["whitened"] for r in line if r["component"] == 2} == {0.0} and line[0]["identity_error"] < 1e-9


def test_entries_of_any_size(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.5, 1e-30])]
    found = whitening.whiten(table(spark, rows)).collect()
    assert {(r["vec_id"], r["deviation"]) for r in found} == {(1, None), (2, None), (3, 1024**2 + 3072**2)}
    assert all(math.isfinite(r["whitened"]) for r in found)


def test_sums_are_exact_at_every_size():
    rng = np.random.default_rng(3)
    for bits in (5, 20, 21, 33, 44, 60):
        v = rng.integers(-(1 << bits), 1 << bits, size=(50, 4))
        assert whitening.squares(v) == [sum(int(x) ** 2 for x in v[:, j]) for j in range(4)]
    y = np.array([[2**31, 2**31], [3037000500, 0], [3037000499, 0]])
    assert whitening.deviations(y) == [None if s >= 2**63 else s for s in (2**63, 3037000500**2, 3037000499**2)]


def test_one_row_a_task_and_sum_meets(spark):
    good, width = whitening.usable(spark.range(64).select(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("e")), "e")
    assert whitening._added(good, whitening._plain_sums(width)) == {(-1, -1): 64, (0, 0): 64 * 100000 + 1024 * 2016, (1, 1): 64 * 101024}
