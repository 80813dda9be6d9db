"""Lexical search against plain Python, on odd rows and with blocks of every size."""

import math
import re
from collections import Counter

import pytest

from docvec.llm import bitslices as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return Counter(TERM.findall(lower))


def plain(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if t in c
            )
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, item string, score long").repartition(3)
    q = spark.createDataFrame([(i, t, "x", 7) for i, t in items], "item_id long, text string, term string, weight long").repartition(2)
    rows = B.search(B.build(d), q, k).select("item_id", "rank", "doc_id", "score").collect()
    return sorted((tuple(r) for r in rows), key=str)


ITEMS = [
    (1, "one id here"), (2, None), (3, ""), (4, "the the THE same row"), (5, "nowhere zzz"), (6, "É 中文 ß 🙂"), (6, "words words few"), (None, "one"),
    (7, "a long text of many words and again a long text"),
]


def test_odd_rows(spark, odd_rows):
    assert found(spark, odd_rows, ITEMS) == plain(odd_rows, ITEMS)
    assert found(spark, odd_rows, ITEMS, 2) == plain(odd_rows, ITEMS, 2)


def test_empty_tables(spark, odd_rows):
    assert found(spark, [], ITEMS) == [] == found(spark, odd_rows, [])
    assert found(spark, [(1, None), (2, " !")], ITEMS) == []


@pytest.mark.parametrize("block", [1, 3, 512])
def test_blocks_of_documents_and_items(spark, odd_rows, monkeypatch, block):
    many = [(i, f"w{i % 7} w{i % 5} " + f"w{i % 3} " * (i % 11)) for i in range(100, 160)]
    items = [(i, f"w{i % 7} and w{i % 3}") for i in range(9)]
    monkeypatch.setattr(B, "BLOCK_DOCS", block)
    monkeypatch.setattr(B, "BLOCK_ITEMS", 2)
    assert found(spark, many + odd_rows, items) == plain(many + odd_rows, items)


def test_bounds_hold_and_exclude(spark):
    """No bound is below its real score, and most documents are excluded by it."""
    import numpy as np

    rng = np.random.default_rng(1)
    block = B._Block(8)
    for i in range(300):
        words = [b"t%d" % w for w in rng.zipf(1.3, size=80) % 2000]
        block.add(i, Counter(words))
    row = block.row()
    words = [b"t%d" % w for w in (3, 17, 101, 555, 1200)]
    weights = np.array([[900.0, 1500, 2500, 4000, 5000]])
    lengths = np.array(row["lengths"])
    m = 10 + (90 * lengths * 300) // lengths.sum()
    slices = np.frombuffer(row["slices"], dtype=np.uint8).reshape(row["bits"], -1)
    bound = B._bounds(weights, B._hashes(words), row["bits"], slices, lengths, m)[0]
    real = B._real(weights, {t: i for i, t in enumerate(words)}, row, np.arange(300), m)[0]
    assert (bound >= real).all() and real.max() > 0
    assert (bound < np.sort(real)[-10]).mean() > 0.8


def test_long_texts_are_counted_whole(monkeypatch):
    text = ("ab É x " * 50 + "y" * 40).encode()
    whole = B.term_counts(text)
    monkeypatch.setattr(B, "_PIECE", 7)
    assert B.term_counts(text) == whole and whole[b"ab"] == 50 and whole["É".encode()] == 50 and whole[b"y" * 40] == 1
