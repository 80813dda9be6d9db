import numpy as np
import pytest

from docvec.operators import pivots as P
from docvec.operators import search as K
from docvec.operators.index import VectorIndex


def index_of(spark, x, start=0):
    rows = [(start + i, None if v is None else [float(np.float32(c)) for c in v], f"n{i}") for i, v in enumerate(x)]
    return VectorIndex(spark.createDataFrame(rows, "vec_id long, embedding array<float>, name string"), 4, len(rows))


def groups(seed, n, around=12):
    """Vectors in well divided groups, a third of them copies of one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(around, 4)) * 100
    x = centres[rng.integers(around, size=n)] + rng.normal(size=(n, 4))
    x[::3] = x[0]
    return x


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_same_hits_from_fewer_pieces(spark, tmp_path):
    x = groups(1, 400)
    index = index_of(spark, x)
    layout = P.lay_out(index, f"{tmp_path}/layout", 24)
    assert layout.sizes.sum() == 400 and layout.vectors.count() == 400
    for q in (x[1], x[0], x[7] + 0.5, np.zeros(4), x[2] * 3):
        for k in (1, 5, 140):
            found = P.search_pruned(layout, q, k, ["name"])
            assert rows(found) == rows(K.search(index, q, k, ["name"]))
    pieces = int((layout.sizes > 0).sum())
    kept = [len(P.pieces_within(layout, x[i].astype(np.float32).astype(float), 9.0)) for i in range(1, 30)]
    assert np.mean(kept) < pieces / 2 and pieces > 6
    read = P.search_pruned(layout, x[1], 5).select("vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "_pivot" in read.split("PartitionFilters: [")[1].split("]")[0]  # other folders are not opened


def test_fewer_vectors_than_asked_and_odd_ones(spark, tmp_path):
    x = [[1.0, 2, 3, 4], None, [float("nan"), 0, 0, 0], [1.0, 2, 3, 4], [5.0, 6, 7, 8]]
    index = index_of(spark, x)
    layout = P.lay_out(index, f"{tmp_path}/layout", 3)
    assert rows(P.search_pruned(layout, [1.0, 2, 3, 4], 9)) == rows(K.search(index, [1.0, 2, 3, 4], 9))
    with pytest.raises(ValueError):
        P.search_pruned(layout, [1.0], 2)
    with pytest.raises(ValueError, match="no vectors"):
        P.lay_out(index_of(spark, [None]), f"{tmp_path}/none")
    with pytest.raises(RuntimeError, match="laid out"):
        P.open_layout(spark, f"{tmp_path}/nowhere")


def test_no_piece_is_left_out_wrongly():
    rng = np.random.default_rng(2)
    for _ in range(50):
        centres = rng.normal(size=(6, 3))
        x = rng.normal(size=(60, 3))
        near = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
        radii = np.array([max([np.linalg.norm(v - c) for v, n in zip(x, near) if n == i], default=0.0) for i, c in enumerate(centres)])
        layout = P.PivotLayout(None, 3, centres, radii, np.bincount(near, minlength=6))
        q = rng.normal(size=3)
        d = ((x - q) ** 2).sum(1)
        kth = np.sort(d)[4]
        assert set(near[d <= kth]) <= set(P.pieces_within(layout, q, kth))
