import pytest
from pyspark.sql import functions as F

from docvec.operators import chunks as C

SIZES = {0: 0, 1: 1, 49: 1, 50: 1, 51: 2, 100: 2, 101: 3}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, [f"t{i}" for i in range(n)]) for n in SIZES] + [(-1, None)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_chunk_count(docs):
    counts = {r[0]: r[1] for r in docs.select("doc_id", C.chunk_count(F.col("tokens"))).collect()}
    assert counts == {**SIZES, -1: 0}


def test_chunks_put_together_are_the_tokens(docs):
    rows = C.chunk_tokens(docs).orderBy("doc_id", "chunk_id").collect()
    found = {}
    for row in rows:
        assert row["chunk_id"] == len(found.setdefault(row["doc_id"], []))
        found[row["doc_id"]].append(row["tokens"])
    assert {d: len(c) for d, c in found.items()} == {d: n for d, n in SIZES.items() if n}
    for doc_id, chunks in found.items():
        assert sum(chunks, []) == [f"t{i}" for i in range(doc_id)]
        assert all(len(c) == 50 for c in chunks[:-1]) and 0 < len(chunks[-1]) <= 50


def test_tokens_are_split_once(spark):
    """No filter repeats the text expression below the chunks."""
    from docvec.functions.text import tokens_of

    texts = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    chunks = C.chunk_tokens(texts.select("doc_id", tokens_of(F.col("text")).alias("tokens")))
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan and "Exchange" not in plan


def test_label(spark):
    label = C.chunk_label(F.lit("report.v2.pdf"), F.lit(3))
    assert spark.range(1).select(label).first()[0] == "report.v2_part_3"


def test_encoder_input(spark):
    full = F.array(*[F.lit("t")] * 510)
    marked, longest = spark.range(1).select(C.encoder_input(F.array(F.lit("a"))), C.encoder_input(full)).first()
    assert marked == ["[CLS]", "a", "[SEP]"]
    assert len(longest) == 512 and longest[0] == "[CLS]" and longest[-1] == "[SEP]"
    more = spark.range(1).select(C.encoder_input(F.array(*[F.lit("t")] * 511))).first()[0]
    assert more == [*longest, "[CLS]", "t", "[SEP]"]  # no token is lost


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7])
def test_windows_hold_every_token_once(spark, n):
    tokens = spark.createDataFrame([([f"t{i}" for i in range(n)],), (None,)], "tokens array<string>")
    windows = [r[0] for r in tokens.select(C.input_windows(F.col("tokens"), 5)).collect()]
    assert windows[1] is None and (windows[0] is None) == (n == 0)
    inside = [w[1:-1] for w in windows[0] or []]
    assert sum(inside, []) == [f"t{i}" for i in range(n)] and all(len(w) <= 3 for w in inside)
    assert all((w[0], w[-1]) == ("[CLS]", "[SEP]") for w in windows[0] or [])


def test_label_collisions(spark):
    files = [("a.txt", 3), ("a.pdf", 1), ("a.docx", 3), ("b.txt", 9), ("c.txt", 0), ("c.pdf", 0), ("c.docx", 2), ("c.x", 1)]
    found = C.label_collisions(spark.createDataFrame(files, "file_name string, n_chunks long")).collect()
    assert sorted(tuple(r) for r in found) == [("a_part_0", 3), ("a_part_1", 2), ("a_part_2", 2), ("c_part_0", 2)]
