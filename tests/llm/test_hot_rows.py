"""Packing of rows that a third of the table repeats, and the pipeline on odd rows and empty tables."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docvec.llm import packing
from docvec.llm.common import table

SF = "/root/testdata/sf0.001"


def places(found):
    batches = collections.defaultdict(list)
    for r in found:
        batches[r["bucket"], r["batch"]].append(r["position"])
    return batches


def test_packing_of_repeated_rows(spark, docs_of, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    monkeypatch.setattr(packing, "SLICE_ROWS", 50)
    rows = [(None, None)] * 100 + [(5, "same words here")] * 60 + [(100 + i, "w " * (i % 23)) for i in range(140)]
    out = packing.pack(docs_of(rows), buckets=3, budget=60)
    found = out.collect()
    want = collections.Counter((i, len((t or "").split())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in found) == want
    sizes = collections.defaultdict(dict)
    for (bucket, batch), held in places(found).items():
        assert sorted(held) == list(range(len(held)))
        sizes[bucket][batch] = len(held)
    for bucket, by_batch in sizes.items():
        full = [by_batch[b] for b in range(len(by_batch))]  # numbered from 0 without gaps
        top = next(r["bucket_len"] for r in found if r["bucket"] == bucket)
        assert set(full[:-1]) <= {max(1, 60 // max(1, top))} and full[-1] <= max(1, 60 // max(1, top))
    again = packing.pack(docs_of(rows[::-1]), buckets=3, budget=60).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))  # the order of rows does not show


@pytest.fixture
def folder_of(spark, tmp_path):
    """A folder of the two tables that the pipeline reads, documents of the given rows."""

    def make(rows, labels=True):
        given = table(spark, SF, "documents")
        docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        filled = docs.select(*[c if c in ("doc_id", "text") else F.lit(None).cast(given.schema[c].dataType).alias(c) for c in given.columns])
        filled.write.parquet(f"{tmp_path}/documents.parquet")
        marks = table(spark, SF, "labels")
        (marks if labels else marks.limit(0)).write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return make


def test_pipeline_on_odd_rows(spark, folder_of, odd_rows):
    given = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").limit(150).collect()]
    odd = [(i if i is None else 10**12 + i, t) for i, t in odd_rows]
    found = corpus_pipeline.run(spark, folder_of(given + odd)).collect()
    kept = collections.Counter(r["doc_id"] for r in found)
    # null and empty texts are no duplicates of anything, of one id's repeated rows one stays
    assert all(kept[10**12 + i] == 1 for i in (1, 2, 3, 6, 7, 8)) and kept[None] == 2
    assert {r["n_tokens"] for r in found if r["doc_id"] in (10**12 + 1, 10**12 + 2, 10**12 + 3)} == {0}


@pytest.mark.parametrize("labels", [True, False])
def test_pipeline_on_an_empty_table(spark, folder_of, labels):
    assert corpus_pipeline.run(spark, folder_of([], labels)).count() == 0


def test_pipeline_without_labels_keeps_or_rejects_all_alike(spark, folder_of):
    found = corpus_pipeline.run(spark, folder_of([(1, "one text of some words here"), (2, "another text with other words"), (3, None)], False)).collect()
    assert len(found) in (0, 3)
