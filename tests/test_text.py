"""Cleaning and word splitting; the splitting rows are written by hand from the public word rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docvec.functions import text as X


def values(spark, column, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, text string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("text"))).collect()]


STRIPPED = {
    "foo.bar, baz!": "foobar baz",
    "Ação à mão": "Ação à mão",
    "Größe öl": "Gre l",
    "a b c\x1dd": "a b c\x1dd",
    "it's x-y_z": "it's x-yz",
    "日本 1 ½ ²": " 1  ",
    "": "",
}


def test_strip_special(spark):
    assert values(spark, X.strip_special, list(STRIPPED)) == list(STRIPPED.values())


def test_lowercase_keeps_the_accents(spark):
    assert values(spark, X.lowercase, ["AÇÃO À MÃO " + X.KEPT_UPPER]) == ["ação à mão " + X.KEPT_LOWER]


WORDS = {
    "a b": ["a", "b"],
    "don't it's we'll": ["do", "n't", "it", "'s", "we", "'ll"],
    "they've I'm you're he'd can't": ["they", "'ve", "i", "'m", "you", "'re", "he", "'d", "ca", "n't"],
    "cannot gonna": ["can", "not", "gon", "na"],
    "Gimme gotta lemme wanna": ["gim", "me", "got", "ta", "lem", "me", "wan", "na"],
    "d'ye more'n 'tis 'twas": ["d", "'ye", "more", "'n", "'t", "is", "'t", "was"],
    "a--b c-d": ["a", "--", "b", "c-d"],
    "a---b": ["a", "--", "-b"],
    "'a 'b' 'hello' dogs' x": ["'", "a", "'", "b", "'", "'hello", "'", "dogs", "'", "x"],
    "say ''hi'' ok": ["say", "``", "hi", "''", "ok"],
    "can't\nwon't\x1cit's": ["ca", "n't", "wo", "n't", "it", "'s"],
    "écannot cannot-y": ["écannot", "can", "not", "-y"],
    "rock'n'roll o'clock y'all": ["rock'n'roll", "o'clock", "y'all"],
    "wannabe Cannots": ["wannabe", "cannots"],
    "...!!!": [],
    " \n\t ": [],
    "": [],
}


def test_tokens(spark):
    assert values(spark, X.tokens_of, list(WORDS)) == list(WORDS.values())


def test_tokens_of_null(spark):
    assert values(spark, X.tokens_of, [None]) == [None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(exclude_characters="'", exclude_categories=["Cs"])), max_size=30))
def test_plain_texts_are_split_on_blanks(spark, texts):
    """Without apostrophes, dashes and split words the tokens are the cleaned words."""
    kept = re.compile(f"[^a-zA-Z0-9{X.KEPT_LOWER}{X.KEPT_UPPER}\\s'-]")
    texts = [t.replace("\0", "").replace("--", "") for t in texts]
    cleaned = [kept.sub("", t) for t in texts]
    plain = [t.lower().split() for t in cleaned if "--" not in t]
    assert values(spark, X.tokens_of, [t for t, c in zip(texts, cleaned) if "--" not in c]) == plain
    once = values(spark, X.strip_special, texts)
    assert once == cleaned == values(spark, X.strip_special, once)


@pytest.mark.parametrize(
    "name, stem",
    [("a.b.pdf", "a.b"), (".txt", ".txt"), ("a..txt", "a."), ("noext", "noext"), ("..x.y", "..x"), ("a.", "a")],
)
def test_file_stem(spark, name, stem):
    assert values(spark, X.file_stem, [name]) == [stem]


def by_the_rules(text):
    """The public Treebank word rules that can apply to cleaned text, one after the other."""
    text = re.sub(r"([ (\[{<])('{2})", r"\1 `` ", text)
    text = re.sub(r"(')(?!re|ve|ll|m|t|s|d|n)(\w)\b", r"\1 \2", text)
    text = re.sub(r"([^'])' ", r"\1 ' ", text)
    text = " " + re.sub(r"--", " -- ", text) + " "
    text = re.sub(r"\s+", " ", re.sub(r"''", " '' ", text))
    text = re.sub(r"([^' ])('s|'m|'d|') ", r"\1 \2 ", text)
    text = re.sub(r"([^' ])('ll|'re|'ve|n't) ", r"\1 \2 ", text)
    for first, last in [("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me")]:
        text = re.sub(rf"\b({first})({last})\b", r" \1 \2 ", text)
    text = re.sub(r"\b(more)('n)\b", r" \1 \2 ", text)
    text = re.sub(r"\b(wan)(na)(?=\s)", r" \1 \2 ", text)
    text = re.sub(r" ('t)(is)\b", r" \1 \2 ", text)
    return re.sub(r" ('t)(was)\b", r" \1 \2 ", text).split()


PIECES = ["'", "''", "-", "--", " ", "\n", "\xa0", "a", "s", "t", "n't", "'ll", "é", "1", "x", "dog", "can", "not", "cannot"]
PIECES += ["gonna", "wanna", "gimme", "d'ye", "more'n", "'tis", "'twas", "'s", "'re", "'ve", "'m", "'d", "lemme", "gotta"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=150))
def test_words_follow_the_rules(spark, texts):
    assert values(spark, X.split_words, texts) == [by_the_rules(t) for t in texts]


def test_base_name_and_preview(spark):
    assert values(spark, X.base_name, ["a/b/c.txt", "c.txt"]) == ["c.txt", "c.txt"]
    many = " ".join(f"w{i}" for i in range(30))
    preview = values(spark, lambda t: X.token_preview(X.tokens_of(t)), [many, "a b"])
    assert preview == [[f"w{i}" for i in range(20)], ["a", "b"]]
