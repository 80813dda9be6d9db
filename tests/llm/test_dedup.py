"""Rows that repeat an id with other texts, or have no id."""

import numpy as np
import pytest

from docvec.llm import dedup

RNG = np.random.default_rng(11)
A, B, C, D = (" ".join(f"{name}{n}" for n in RNG.permutation(400)[:120]) for name in "abcd")


def near(text):
    return text.rsplit(" ", 1)[0] + " other"


# id 1 has two texts, each with a near copy of its own; 7 has an empty text besides; null ids have copies only of each other
ROWS = [
    (1, A), (1, B), (5, near(A)), (6, near(B)), (3, C), (7, near(C)), (7, ""), (None, D), (None, D), (None, near(D)), (9, "alone"), (9, "alone"),
    (None, None), (None, ""),
]


@pytest.mark.parametrize("turn", [1, -1])
def test_an_id_has_the_links_of_all_its_texts(docs_of, turn):
    found = dedup.near_duplicates(docs_of(ROWS[::turn])).collect()
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found))
    want = [(0, 0, True)] * 5 + [(1, 1, True)] * 2 + [(3, 3, True), (5, 1, False), (6, 1, False), (7, 3, False), (7, 3, False), (9, 9, True), (9, 9, True)]
    assert got == want


def test_one_row_of_each_component(docs_of):
    docs = docs_of(ROWS)
    kept = dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert [i for i, _ in found] == [0, 0, 0, 1, 3, 9] and found[3][1] in (A, B)
    assert [t for i, t in found[:2]] == ["", ""] and found[2][1] in (D, near(D))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in dedup.one_of_each(docs.repartition(5)).collect()) == found


def test_ids_of_any_size(docs_of):
    big = 1 << 62
    rows = [(big, A), (big + 5, A), (big + 9, near(A)), (-(1 << 63), C), (3, near(C)), (7, B), ((1 << 63) - 1, near(B)), (big + 2, ""), (big + 3, D), (None, D), (None, "solo text")]
    got = dedup.near_duplicates(docs_of(rows)).collect()
    found = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None)
    low = -(1 << 63)
    assert found == [
        (low, low, True), (3, low, False), (7, 7, True), (big, big, True), (big + 2, big + 2, True), (big + 3, big + 3, True), (big + 5, big, False),
        (big + 9, big, False), ((1 << 63) - 1, 7, False),
    ]
    without = [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None]
    assert sorted(without, key=str) == [(big + 3, False), (None, True)]
