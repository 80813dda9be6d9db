"""Disclosing terms over whole documents, against counting all pairs in plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from docvec.llm import pii

VALUE = re.compile(r"[a-z]+@[a-z]+\.example")  # the only values of this corpus


def corpus(rng, n=240):
    common = [f"{a}{b}en" for a in ("ba", "ko", "mi", "ru", "ta") for b in ("lor", "ves", "dan", "pim")]
    rare = [f"{w}ix" for w in common]
    people = ["ann@corp.example", "bob@corp.example", "eve@home.example"]
    rows = []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(0, 40)) + rng.choices(rare, k=rng.randint(0, 2))
        who = rng.choice([*people, None, None, None])
        if who:
            name = who.split("@")[0].capitalize()
            words = [name + "son", *words, who] if rng.random() < 0.8 else [*words, who, "ann"]
        rows.append((i if i % 17 else None, " ".join(words) or None))
    return rows + [rows[1]] * 5 + [(1000 + i, rows[2][1]) for i in range(4)]


def plain_risks(rows, threshold, support):
    texts = [t or "" for _, t in rows]
    n, n_value, n_term, n_both, both_texts = len(texts), Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        values = {f"email:{v}" for v in VALUE.findall(t)}
        terms = {w.lower() for w in re.findall(r"[A-Za-z]{3,}", VALUE.sub("|", t))}
        n_value.update(values)
        n_term.update(terms)
        for pair in ((v, w) for v in values for w in terms):
            n_both[pair] += 1
            both_texts[pair].add(t)
    out = {}
    for (v, w), k in n_both.items():
        if len(both_texts[v, w]) >= support and n_value[v] < n:
            risk = math.log(k * n / (n_term[w] * n_value[v])) / math.log(n / n_value[v])
            if risk >= threshold:
                out[v, w] = risk
    return out


def plain_term_spans(text, terms):
    taken = [m.span() for m in VALUE.finditer(text)]
    places = [m for m in re.finditer(r"[A-Za-z]{3,}", text) if not any(s < m.end() and m.start() < e for s, e in taken)]
    return [f"term:{m.start()}:{m.end()}" for m in places if m[0].lower() in terms]


@pytest.mark.parametrize("threshold, support", [(0.7, 3), (0.3, 2), (0.95, 1)])
def test_risks_and_places_equal_the_formula(spark, docs_of, threshold, support):
    rows = corpus(random.Random(support))
    docs = docs_of(rows)
    want = plain_risks(rows, threshold, support)
    got = {(r["value"], r["term"]): r["risk"] for r in pii.disclosing_terms(docs, pii.find(docs), "text", threshold, support).collect()}
    assert want and got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    terms = {w for _, w in want}
    expected = Counter((i, ",".join(plain_term_spans(t or "", terms))) for i, t in rows)
    spans = pii.scan(docs, threshold=threshold, support=support).collect()
    assert expected == Counter((r["doc_id"], ",".join(x for x in r["spans"].split(",") if x.startswith("term"))) for r in spans)


def test_a_name_far_from_its_address_is_found_wherever_it_stands(spark, docs_of):
    filler = "the quick brown fox jumps over the lazy dog again and again until the night comes down over the field "
    rows = [(i, f"Zyxander {filler * 3}{i} boss@corp.example") for i in range(8)]
    rows += [(100 + i, f"{filler}{i}") for i in range(200)] + [(999, "here Zyxander stands alone")]
    found = {r["doc_id"]: r["spans"] for r in pii.scan(docs_of(rows)).collect()}
    assert all("term:0:8" in found[i].split(",") for i in range(8)) and found[999] == "term:5:13"
    assert not any(found[100 + i] for i in range(200))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_of(rows)).collect()}
    assert "zyxander" not in " ".join(clean.values()).lower() and all(clean[i] == t for i, t in rows[8:-1])


def test_a_value_in_every_document_tells_nothing(spark, docs_of):
    docs = docs_of([(i, f"zyxander {i} boss@corp.example") for i in range(6)])
    assert pii.disclosing_terms(docs, pii.find(docs)).count() == 0
    assert {r["text"] for r in pii.sanitise(docs).collect()} == {f"zyxander {i} [email]" for i in range(6)}


def test_columns_of_the_operators_own_names_stay(spark):
    names = ["_held", "_key", "_of_id", "_of_hash", "_of_terms", "_held_", "_id", "_hash", "terms", "__found", "text_hash"]
    rows = [(i, f"zyxander wrote {i} from boss@corp.example") for i in range(4)] + [(10 + i, f"nothing here {i}") for i in range(40)]
    docs = spark.createDataFrame([(i, t, *names) for i, t in rows], ["doc_id", "text", *names])
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows) and all(tuple(r)[2:] == tuple(names) for r in got)
    assert all("@" not in r["text"] and "zyxander" not in r["text"] for r in got)


def test_bitmaps_hold_their_keys(spark):
    keys = [f"key {i} é" for i in range(3000)]
    may = pii.MayHold(pii.bitmap(spark.createDataFrame([(k,) for k in keys], "k string"), "k"))
    assert all(map(may, keys)) and sum(may(f"other {i}") for i in range(3000)) < 30


def test_workers_remember_few_words():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from docvec.llm import pii, toxicity

    words = [f"word{i:x}" for i in range(190_000)]
    tracemalloc.start()
    try:
        may = pii.MayHold(bytes((1 << pii.BITS) // 8))
        assert not any(may(w) for w in words)
        held = tracemalloc.get_traced_memory()[0]
        model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), -1.0, 1.0, 0.0)
        model.text_margins([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)])
        batches = [pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(s, s + 500)) for s in range(0, 190_000, 500)])], ["t"])]
        sent = [dict(zip(*b.to_pydict().values(), strict=True)) for b in pii._word_counts(iter(batches))]
    finally:
        tracemalloc.stop()
    assert held < 8 << 20
    assert len(may.known) <= 50_001 and len(model.margins) < 100_000
    assert max(map(len, sent)) < 101_000 and sum(sum(x.values()) for x in sent) == 190_000
