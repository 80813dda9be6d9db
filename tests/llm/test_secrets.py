"""Secrets behind paths, names and sample words, and those of lower-case letters with digits."""

import pytest

from docvec.llm import secrets

KEY, LOWER = "Xk29fLq81ZpTr0vYw36BnHsd", "q7w2k9x4m1z8v5c3n6b0t2j4h7"
SLASHES = "aBc/dEfG/x93hTQ7kLmZ0v5RyWq28Nsd+J1uE6oP"
FOUND = [  # text, where the reported span begins, its kind
    (f"https://hooks.slack.com/services/T0AB1CD2E/B0FG3HI4J/{KEY}", "T0AB1CD2E", "entropy_mixed"),
    (f"GET /api/token/{KEY}", KEY, "entropy_mixed"),
    (f"key {SLASHES} end", SLASHES[9:], "entropy_mixed"),
    (f"sample_key={KEY}", KEY, "entropy_mixed"),
    (f"dummy/{KEY}", "dummy", "entropy_mixed"),
    (f"id {LOWER} end", LOWER, "entropy_lower"),
    (f"EXAMPLE_ID2={LOWER}", LOWER, "entropy_lower"),
]
ALLOWED = [
    "/usr/share/some/lib/path1A", "see /usr/lib/python3/dist-packages/Foo/Bar here", "Sample" + KEY, KEY + "EXAMPLEKEY", "src/Main/util/aFile2",
    "just_a_long_sample_name_12", "internationalisation and antidisestablishmentarianism", "aaaaaaaaaaaaaaaaaaaaaaaaa1",
]


@pytest.fixture(scope="module")
def spans(spark, docs_of):
    rows = list(enumerate([t for t, *_ in FOUND] + ALLOWED))
    return {rows[r["doc_id"]][1]: r["spans"] for r in secrets.scan(docs_of(rows)).collect()}


def test_words_around_a_key_do_not_hide_it(spans):
    for text, begin, kind in FOUND:
        at = text.index(begin)
        assert any(x.startswith(f"{kind}:{at}:") for x in spans[text].split(",")), (text, spans[text])


def test_whole_paths_and_samples_are_allowed(spans):
    assert {t: spans[t] for t in ALLOWED if "entropy" in spans[t]} == {}
