"""Ten times the text takes at most fifteen times the seconds, and gives ten times the result."""

import random
import string
import time

import pytest
from pyspark.sql import functions as F

from docvec.llm import licenses, secrets

_LETTERS = string.ascii_letters + string.digits


def key(n, rng=random.Random(7)):
    return "".join(rng.choice(_LETTERS) for _ in range(n))


def timed(scan, docs_of, text):
    docs = docs_of([(1, text)])
    begin = time.perf_counter()
    row = scan(docs).collect()[0]
    return time.perf_counter() - begin, row


def test_many_secrets_in_one_text(spark, docs_of):
    keys = [key(24) for _ in range(30_000)]
    timed(secrets.scan, docs_of, keys[0])
    few, _ = timed(secrets.scan, docs_of, " ".join(keys[:3000]))
    many, row = timed(secrets.scan, docs_of, " ".join(keys))
    assert many <= 15 * few
    spans = [x.split(":") for x in row["spans"].split(",") if x.startswith("entropy")]
    assert len(spans) > 25_000 and all(int(s) % 25 == 0 and int(e) - int(s) == 24 for _, s, e in spans)


@pytest.mark.parametrize("n", [20, 255, 256, 257, 275, 276, 294, 295, 296, 1000])
def test_blocks_of_a_long_run_meet(spark, n):
    """The window of highest entropy may lie anywhere, across blocks too."""
    for at in {0, max(0, n // 2 - 10), n - 20}:
        text = "a" * at + string.ascii_letters[:20] + "a" * (n - at - 20)
        bits = spark.createDataFrame([(text,)], "t string").select(secrets.highest_entropy(F.col("t"))).collect()[0][0]
        assert bits == pytest.approx(4.321928095)


def test_one_long_run(spark, docs_of):
    few, _ = timed(secrets.scan, docs_of, key(30_000))
    many, row = timed(secrets.scan, docs_of, key(300_000))
    assert many <= 15 * few and row["spans"] == "entropy_mixed:0:300000"


def test_many_words_in_one_text(spark, docs_of):
    words = [key(4) for _ in range(400_000)]
    words[399_990:399_994] = "under the mit license".split()
    timed(licenses.scan, docs_of, words[0])
    few, _ = timed(licenses.scan, docs_of, " ".join(words[:40_000]))
    many, row = timed(licenses.scan, docs_of, " ".join(words))
    assert many <= 15 * few
    assert (row["n_words"], row["n_base"], row["first_word"]) == (400_000, 1, 399_990)
