from docvec.operators.index import open_index
from docvec.operators.report import file_stats, run_report
from docvec.operators.search import search, self_query
from docvec.plans.document_search import chunk_vectors, document_search, index_files
from docvec.plans.tables import docx_bytes, xlsx_bytes
from docvec.sources.files import read_files


def test_stats(spark):
    rows = [(1, ["a"] * 51), (2, []), (3, None), (4, ["b"])]
    stats = file_stats(spark.createDataFrame(rows, "doc_id long, tokens array<string>"))
    assert {tuple(r) for r in stats.collect()} == {(1, 51, 2), (2, 0, 0), (3, 0, 0), (4, 1, 1)}


def test_report(spark):
    files = spark.range(4)
    chunks = [(0, 50, [1.0, 2.0]), (1, 1, None), (0, 1, [3.0, 4.0])]
    encoded = spark.createDataFrame(chunks, "chunk_id int, n_tokens long, embedding array<float>")
    assert run_report(files, encoded).first().asDict() == {
        "files": 4, "skipped": 2, "tokens": 52, "chunks": 3, "vectors": 2, "dimension": 2,
    }
    assert run_report(files, encoded.limit(0)).first().asDict() == {
        "files": 4, "skipped": 4, "tokens": 0, "chunks": 0, "vectors": 0, "dimension": None,
    }
    assert "NestedLoop" not in run_report(files, encoded)._jdf.queryExecution().executedPlan().toString()


def test_whole_way(spark):
    rows = [(1, "b.txt", "Um dois, três."), (0, "a.txt", "um DOIS três!"), (2, "c.txt", "..."), (3, "d.txt", "outra coisa")]
    documents = spark.createDataFrame(rows, "doc_id long, file_name string, text string")
    assert chunk_vectors(documents).count() == 3
    hits = document_search(documents, top_k=5).collect()
    assert [(r["vec_id"], r["file_name"], r["chunk_id"]) for r in hits][:2] == [(0, "a.txt", 0), (1, "b.txt", 0)]
    assert [r["distance"] for r in hits][:2] == [0.0, 0.0] and hits[2]["distance"] > 0 and len(hits) == 3


def test_files_to_a_stored_index(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(docx_bytes(["um dois", "três"]))
    (folder / "b.xlsx").write_bytes(xlsx_bytes(["um", "dois três"]))
    (folder / "c.txt").write_text(" ".join(f"w{i}" for i in range(120)))
    (folder / "d.csv").write_text("not read")
    index = index_files(read_files(spark, str(folder)), f"{tmp_path}/out")
    assert (index.n_vectors, index.dimension) == (5, 64)
    again = open_index(spark, f"{tmp_path}/out/index")
    hits = self_query(again, 2, ["file_name", "chunk_id"]).collect()
    assert [(r["file_name"], r["chunk_id"], r["distance"]) for r in hits] == [("a.docx", 0, 0.0), ("b.xlsx", 0, 0.0)]
    third = again.vectors.where("vec_id = 4").first()
    assert (third["file_name"], third["chunk_id"]) == ("c.txt", 2)
    assert search(again, third["embedding"], 1).first()["vec_id"] == 4
