"""Cleaning and word splitting as Column -> Column functions.

Everything here is a Catalyst expression: no Python worker is involved, so the
work stays next to the scan and moves no data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accented letters that survive cleaning, lower and upper case.
KEPT_LOWER = "áàâãéèêíïóôõúüçñ"
KEPT_UPPER = "ÁÀÂÃÉÈÊÍÏÓÔÕÚÜÇÑ"

# The four separator controls count as blanks although Java's Unicode \s leaves them out.
CONTROL_BLANKS = "\x1c\x1d\x1e\x1f"

# Every blank besides the space.
BLANKS = (
    "\t\n\x0b\x0c\r"
    + CONTROL_BLANKS
    + "\x85\xa0\u1680"
    + "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    + "\u2028\u2029\u202f\u205f\u3000"
)

# English words that are split in two (public Treebank word rules).
SPLIT_WORDS = [
    ("can", "not"),
    ("d", "'ye"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("more", "'n"),
]
SPLIT_BEFORE_BLANK = ("wan", "na")
SPLIT_AFTER_BLANK = [("'t", "is"), ("'t", "was")]

_UNICODE = "(?U)"
_WORD_CHARS = "a-z0-9" + KEPT_LOWER


def strip_special(text: Column) -> Column:
    """Delete every character that is not a kept letter, digit, blank, hyphen or apostrophe."""
    kept = "a-zA-Z0-9" + KEPT_LOWER + KEPT_UPPER + r"\s\x1c-\x1f\-'"
    return F.regexp_replace(text, f"{_UNICODE}[^{kept}]+", "")


def lowercase(text: Column) -> Column:
    return F.lower(text)


def _blanks_to_space(text: Column) -> Column:
    return F.translate(text, BLANKS, " " * len(BLANKS))


def _opening_apostrophes(text: Column) -> Column:
    """Quote pairs after a space open a quotation; a lone letter or a blank detaches its apostrophe."""
    text = F.replace(text, F.lit(" ''"), F.lit("  `` "))
    text = F.regexp_replace(text, rf"'(?![mtsdn])([{_WORD_CHARS}])(?![{_WORD_CHARS}])", "' $1")
    return F.regexp_replace(text, "([^'])' ", "$1 ' ")


def _closing_apostrophes(text: Column) -> Column:
    """Quote pairs close a quotation; endings such as 's or n't leave their word. Needs spaces all round."""
    text = F.replace(text, F.lit("''"), F.lit(" '' "))
    text = F.regexp_replace(_blanks_to_space(text), " +", " ")
    text = F.regexp_replace(text, "([^' ])('[smd]?) ", "$1 $2 ")
    return F.regexp_replace(text, "([^' ])('ll|'re|'ve|n't) ", "$1 $2 ")


def _dashes(text: Column) -> Column:
    return F.concat(F.lit(" "), F.replace(text, F.lit("--"), F.lit(" -- ")), F.lit(" "))


def _holds_split_word(text: Column) -> Column:
    """Whether a text without apostrophes has a word to split: far cheaper than the pattern."""
    found = F.lit(False)
    for a, b in [*SPLIT_WORDS, SPLIT_BEFORE_BLANK]:
        if "'" not in a + b:
            found = found | F.contains(text, F.lit(a + b))
    return found


def _split_words(text: Column) -> Column:
    pairs = "|".join(f"({a})({b})" for a, b in SPLIT_WORDS)
    last_a, last_b = SPLIT_BEFORE_BLANK
    pattern = rf"{_UNICODE}\b(?:(?:{pairs})\b|({last_a})({last_b})(?=\s))"
    n = 2 * (len(SPLIT_WORDS) + 1)
    heads = "".join(f"${i}" for i in range(1, n, 2))
    tails = "".join(f"${i}" for i in range(2, n + 1, 2))
    return F.regexp_replace(text, pattern, f" {heads} {tails} ")


def _split_after_blank(text: Column) -> Column:
    pairs = "|".join(f"({a})({b})" for a, b in SPLIT_AFTER_BLANK)
    return F.regexp_replace(text, rf"{_UNICODE} (?:{pairs})\b", " $1$3 $2$4 ")


def _on_blanks(text: Column) -> Column:
    return F.array_remove(F.split(_blanks_to_space(text), " "), "")


def split_words(cleaned: Column) -> Column:
    """Words of a cleaned, lowercased text.

    Cleaning leaves no sentence mark, so only the rules for apostrophes, double
    dashes and the split words can apply. The apostrophe rules run only on texts
    that hold one.
    """

    def rules(text: Column) -> Column:
        quoted = _split_after_blank(_split_words(_closing_apostrophes(_dashes(_opening_apostrophes(text)))))
        plain = _dashes(text)
        plain = F.when(_holds_split_word(text), _split_words(plain)).otherwise(plain)
        return _on_blanks(F.when(F.contains(text, F.lit("'")), quoted).otherwise(plain))

    # One array element keeps `cleaned` evaluated once although the rules name it three times.
    return F.transform(F.array(cleaned), rules)[0]


def tokens_of(text: Column) -> Column:
    """Clean, lowercase, split: the whole text treatment. Null in, null out."""
    return F.when(text.isNotNull(), split_words(lowercase(strip_special(text))))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(name: Column) -> Column:
    """File name without its last extension; leading dots do not start one."""
    stem = F.regexp_extract(name, r"^(\.*[^.].*)\.[^.]*$", 1)
    return F.when(stem == "", name).otherwise(stem)


def token_preview(tokens: Column, n: int = 20) -> Column:
    return F.slice(tokens, 1, n)
