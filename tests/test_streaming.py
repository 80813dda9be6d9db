from docvec.operators.index import build_index, open_index
from docvec.operators.search import self_query
from docvec.plans.document_search import file_vectors
from docvec.plans.tables import docx_bytes, pptx_bytes
from docvec.sources.files import read_files
from docvec.sources.vectors import read_vectors
from docvec.streaming.ingest import ingest, ingest_into_index, landing_files


def rows_of(df):
    return sorted((r["doc_id"], r["file_name"], r["chunk_id"], tuple(r["embedding"])) for r in df.collect())


def test_files_are_ingested_once(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def run():
        query = ingest(landing_files(spark, landing, files_per_batch=2), table, checkpoint)
        query.awaitTermination()
        return read_vectors(spark, table)

    for i in range(3):
        (tmp_path / "in" / f"a{i}.txt").write_text(" ".join(f"w{j}" for j in range(60 + i)))
    (tmp_path / "in" / "junk.docx").write_bytes(b"junk")
    assert run().count() == 6
    (tmp_path / "in" / "b.docx").write_bytes(docx_bytes(["um dois", "três"]))
    (tmp_path / "in" / "c.pptx").write_bytes(pptx_bytes(["um dois três"]))
    stored = run()
    assert stored.count() == 8
    assert run().count() == 8
    assert rows_of(stored) == rows_of(file_vectors(read_files(spark, landing)))

    index = build_index(stored, stored=True)
    hits = self_query(index, 2, ["file_name", "chunk_id"]).collect()
    assert (hits[0]["file_name"], hits[0]["chunk_id"], hits[0]["distance"]) == ("a0.txt", 0, 0.0)


def test_files_go_into_a_stored_index(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def run(checkpoint):
        files = landing_files(spark, str(landing), files_per_batch=1)
        ingest_into_index(files, f"{tmp_path}/index", f"{tmp_path}/{checkpoint}").awaitTermination()
        return open_index(spark, f"{tmp_path}/index")

    (landing / "a.txt").write_text(" ".join(f"w{j}" for j in range(120)))
    (landing / "b.docx").write_bytes(docx_bytes(["um dois"]))
    assert run("one").n_vectors == 4
    (landing / "c.txt").write_text("um dois")
    assert run("one").n_vectors == 5
    index = run("lost")  # every file is read again and nothing is added
    rows = index.vectors.orderBy("vec_id").collect()
    assert [r["vec_id"] for r in rows] == list(range(5)) and index.n_vectors == 5
    assert sorted((r["file_name"], r["chunk_id"]) for r in rows) == [
        ("a.txt", 0), ("a.txt", 1), ("a.txt", 2), ("b.docx", 0), ("c.txt", 0),
    ]
