import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docvec.plans import document_search as P
from docvec.sources import folders as D
from docvec.sources import listing as L

FILES = {
    "a.txt": "alpha beta", "empty.txt": "", "sub/b c%20d.txt": "gamma " * 120, "sub/deep/é ü.txt": "delta", "sub/deep/x.bin": "skip",
    "sub/bad.docx": "junk", "big.txt": "word " * 4000, "dots.txt": "...", "p.pdf": "paper text",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in FILES.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/tree/{name}"), exist_ok=True)
        with open(f"{tmp_path}/tree/{name}", "w") as f:
            f.write(text)
    os.makedirs(f"{tmp_path}/tree/nothing")
    return f"{tmp_path}/tree"


def test_list_a_tree(spark, tree):
    items = {r["id"].removeprefix(L.address(tree)): r for r in L.list_tree(spark, tree).collect()}
    files = {i: r for i, r in items.items() if r["mime_type"] != D.FOLDER_MIME_TYPE}
    assert sorted(r["name"] for r in files.values()) == sorted(n.split("/")[-1] for n in FILES)
    assert files["/sub/b%20c%2520d.txt"]["size"] == 720 and files["/empty.txt"]["size"] == 0
    assert {i for i in items if i not in files} == {"/sub", "/sub/deep", "/nothing"}
    assert items["/sub/deep"]["parent_id"] == f"{L.address(tree)}/sub"
    assert P.tree_files(spark, tree).count() == len(FILES)


def test_a_folder_that_can_not_be_listed(spark, tree):
    def lister(uri):
        if uri.endswith("deep"):
            raise PermissionError("closed")
        return L.list_folder_at(uri)

    rows = L.list_tree(spark, tree, lister).collect()
    assert [(r["id"], r["parent_id"].endswith("deep"), r["problem"]) for r in rows if r["problem"]] == [(None, True, "closed")]
    assert P.tree_files(spark, tree, lister).count() == len(FILES) - 2


def test_read_only_what_fits_and_has_a_reader(spark, tree, tmp_path):
    opened = f"{tmp_path}/opened"
    os.makedirs(opened)

    def opener(uri):
        name = uri.rsplit("/", 1)[1]
        open(f"{opened}/{name}", "a").write("x")
        if name == "a.txt":
            raise FileNotFoundError(name)
        if name == "dots.txt":
            raise OSError("broken")
        return L.read_at(uri)

    files = P.tree_files(spark, tree).withColumn("content_type", F.lit("kept"))
    found = {r["file_name"]: r for r in L.read_listed(files, 1000, opener).collect()}
    problems = {n: r["problem"] for n, r in found.items() if r["problem"]}
    assert problems == {"a.txt": "missing", "dots.txt": "unreadable", "big.txt": "too_large"}
    assert found["é ü.txt"]["content"] == b"delta" and found["empty.txt"]["content"] == b"" and found["x.bin"]["content"] is None
    assert {r["content_type"] for r in found.values()} == {"kept"} and len(found) == len(FILES)
    assert "big.txt" not in os.listdir(opened) and "x.bin" not in os.listdir(opened)


def test_a_run_tells_what_became_of_its_files_and_reads_texts_once(spark, tree, tmp_path):
    calls = f"{tmp_path}/calls"

    def paper(content):
        with open(calls, "a") as f:
            f.write("x")
        yield content.decode()

    def no_gamma():
        def encode(batch):
            if any("gamma" in chunk for chunk in batch):
                raise ValueError("no gamma")
            return np.ones((len(batch), 3))

        return encode

    run = P.store_tree(spark, tree, f"{tmp_path}/run", no_gamma, {"pdf": paper}, max_bytes=1000)
    assert open(calls).read() == "x"  # read once, also for the totals
    status = {r["file_name"]: (r["status"], r["n_tokens"], r["size"]) for r in run.file_status.collect()}
    assert status == {
        "a.txt": ("ok", 2, 10), "empty.txt": ("empty", 0, 0), "b c%20d.txt": ("ok", 120, 720), "é ü.txt": ("ok", 1, 5), "x.bin": ("unsupported", 0, 4),
        "bad.docx": ("error", 0, 4), "big.txt": ("too_large", 0, 20000), "dots.txt": ("ok", 0, 3), "p.pdf": ("ok", 2, 10),
    }
    (report,) = run.report().collect()
    assert report.asDict() == {
        "files": 9, "ok": 5, "empty": 1, "error": 1, "unsupported": 1, "no_parser": 0, "too_large": 1, "missing": 0, "unreadable": 0,
        "tokens": 125, "chunks": 6, "failed_chunks": 3, "vectors": 3, "dimension": 3,
    }
    assert sorted(r["chunk_id"] for r in run.failed_chunks.collect()) == [0, 1, 2]
    assert {r["file_name"] for r in run.vectors.collect()} == {"a.txt", "é ü.txt", "p.pdf"}


def test_an_empty_tree(spark, tmp_path):
    os.makedirs(f"{tmp_path}/none")
    run = P.store_tree(spark, f"{tmp_path}/none", f"{tmp_path}/run")
    assert run.file_status.count() == 0 and run.report().collect()[0]["dimension"] is None
    with pytest.raises(ValueError, match="no vectors"):
        P.index_tree(spark, f"{tmp_path}/none", f"{tmp_path}/other")


def test_a_local_folder_is_listed_entry_by_entry(tmp_path, monkeypatch):
    """The listing of a folder of a great many files was held whole."""
    from docvec.sources import listing as L

    (tmp_path / "sub").mkdir()
    (tmp_path / "a b.txt").write_bytes(b"xyz")
    (tmp_path / "empty").touch()
    (tmp_path / "broken").symlink_to(tmp_path / "nothing")
    given = {name: (folder, 0 if folder else size) for name, folder, size in L.list_folder_at(tmp_path.as_uri())}
    assert given == {"sub": (True, 0), "a b.txt": (False, 3), "empty": (False, 0), "broken": (False, 0)}

    def whole(*_, **__):
        raise AssertionError("listed whole")

    monkeypatch.setattr(L, "FileSelector", whole)
    assert len(list(L.list_folder_at(tmp_path.as_uri()))) == 4
