"""The work on words that the toxicity scores take."""

import numpy as np

from docvec.llm import toxicity


def _model(phrases=None):
    codes = np.arange(0, toxicity._SPACE, 3)
    return toxicity.Model(codes, np.cos(codes), -1.0, 1.0, 0.0, phrases=phrases)


def test_a_bare_word_is_worked_on_once(monkeypatch):
    """Marks around a word don't count, nor does the bound of pairs; words that come again and again are not forgotten with the rest."""
    worked = []
    subsequences = toxicity.subsequences
    monkeypatch.setattr(toxicity, "subsequences", lambda words: worked.extend(words) or subsequences(words))
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 400)
    letters = "abcdefghijklmnopqrstuvwxyz"
    usual = [f"usual{a}{b}" for a in letters for b in "xyz"]
    rare = [f"rare{a}{b}{c}" for a in letters for b in letters for c in "uv"]
    marks = [w + m for w in usual for m in ("", ",", ".", "!")]
    # blocks of 64 texts, each with usual words and some that are its own
    texts = [" ".join([*marks[i::64], *(w for w in rare[i // 64 * 100 : i // 64 * 100 + 100][i % 64 :: 64])]) for i in range(64 * 12)]
    phrases = toxicity.Phrases([], [("bloody", "weasel")], np.ones(1))
    plain = _model(phrases).text_margins(texts)
    assert len([w for w in worked if w not in ("bloody", "weasel")]) == len(usual) + 1_200
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 50_000)
    assert plain == _model(phrases).text_margins(texts)


def test_words_of_any_script_are_read_as_before():
    signs = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
    for text in ("", "Idi0t", "ÀÉ 1d1ot İ 5traße", "日本 7語 $", "\U0001d5ba 3 ٣ x" * 9):
        assert toxicity.read(text)[0] == text.lower().translate(signs).split()
    of = lambda o: 0 if o == 0 else 1 if o == 1 else o - 95 if 97 <= o <= 122 else 28 + o % 14
    for text in ("\x01abc\x01\x00", "\x01straße\x01\x00", "\x01日本語\x01\x00\x01\U0001d5baz\x01\x00"):
        assert toxicity.signs(text).tolist() == [of(ord(c)) for c in text]


def test_subsequences_of_many_words_are_those_of_each():
    words = [f"w{i * 7919:x}é"[: i % 11] for i in range(3 * toxicity.TOGETHER)]
    word, code, value = toxicity.subsequences(words)
    assert (np.diff(word) >= 0).all()
    for i in (0, 5, toxicity.TOGETHER - 1, toxicity.TOGETHER, 2 * toxicity.TOGETHER + 3):
        _, own, weights = toxicity.subsequences([words[i]])
        assert code[word == i].tolist() == own.tolist() and value[word == i].tolist() == weights.tolist()


def test_long_and_short_words_beside_others():
    model = _model()
    long = "abcdefghij" * 12
    margins = model.word_margins(["ab", "", "weasel", long, "xyz"])
    assert margins[0] == margins[1] == model.bias
    assert margins[3] == max(model.word_margins(toxicity.parts(long)))
    assert margins[2] == model.word_margins(["weasel"])[0]
