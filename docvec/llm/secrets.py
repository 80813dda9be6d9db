"""Secrets in texts: fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a run of 20 or more characters of keys and encodings. Path parts of letters and a name with its equals
sign before 20 such characters are candidates of their own, so that what follows is judged without them. A window of 20 characters slides over it; the
counts of the character that leaves and of the one that enters give the next window's entropy from the last one's.
The candidate is a secret if its highest window passes the threshold of its character class, unless it fits the
allow list, which knows whole candidates only. Everything is a DataFrame expression on the row's own text: no shuffle, no Python.
Hits and long candidates are walked in blocks, so that the time follows a text's length and its number of hits.

Edge cases: null and empty texts have no spans. Positions count code points. Long candidates are slid over in
blocks that overlap by a window, so that nothing is cut. Repeated rows give equal rows, an empty table none; other
columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import whole

KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_upper", "entropy_mixed", "entropy_lower"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
_RUN = r"[A-Za-z0-9+/_=-]{20"
# the first two hold no digits beside letters of both cases, and so are in no class
CANDIDATE = rf"/?(?:[A-Za-z_-]+/){{2,}}+(?={_RUN}}})|(?:[A-Za-z_-]+|[a-z_-]+[0-9]{{1,4}}|[A-Z_-]+[0-9]{{1,4}})=(?={_RUN}}})|{_RUN},}}"
WINDOW = 20
BLOCK = 256  # characters of a candidate, or hits of a text, that are walked at once
# class: what a candidate must look like, and the bits per character that make it a secret
CLASSES = {
    "entropy_hex": (r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    "entropy_upper": (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", 3.3),
    "entropy_lower": (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", 3.5),
    "entropy_mixed": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).+$", 3.7),
}
# identifiers and samples that look random but are no secrets
ALLOWED = [
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[0-9_=/+-]+$",
    r"(?i)^(?:example|sample|placeholder|changeme|dummy)(?![_/=-])",
    r"(?i)(?:example|sample|placeholder|changeme|dummy)(?:key)?$",
    r"(?i)^[a-z_-]*(?:example|sample|placeholder|changeme|dummy)[a-z_-]*[0-9]{0,4}$",
    r"^/?(?:[A-Za-z_-]{0,19}[0-9]{0,4}/){2,}[A-Za-z_-]{0,15}[0-9]{0,4}[A-Za-z]?$",
]
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _once(value: Column, use) -> Column:
    """use(value), with the value made a single time however often it is used: the only element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _located(text: Column, pattern: str, kind, extra: Column | None = None) -> Column:
    """Spans of all matches, from left to right: the texts between them and their own lengths give the places.

    The kind is a column over a match, null where it is to be dropped. `extra` is zipped in, as kind's second argument.
    """
    zipped = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")]
    if extra is not None:
        zipped.append(extra.alias("extra"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        number = kind(x["hit"], x["extra"]) if extra is not None else kind(x["hit"])
        span = F.struct(start.alias("start"), number.cast("int").alias("kind"), end.alias("end"))
        more = F.when(number.isNotNull(), F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.when(x["hit"].isNull(), done).otherwise(F.struct(end.alias("at"), more.alias("spans")))

    def walked(block: Column, at: Column) -> Column:
        start = F.struct(at.cast("int").alias("at"), F.array().cast(_SPANS).alias("spans"))
        return F.aggregate(block, start, step, lambda done: done["spans"])

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))

    def in_blocks(xs: Column) -> Column:
        turns = F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))
        return F.transform(turns, lambda i: F.slice(xs, i, BLOCK))

    def begins(blocks: Column) -> Column:
        more = lambda done, block: F.concat(done, F.array(F.element_at(done, -1) + length(block)))
        return F.aggregate(blocks, F.array(F.lit(0)), more)

    def of_blocks(blocks: Column) -> Column:
        return F.flatten(_once(begins(blocks), lambda at: F.transform(blocks, lambda block, i: walked(block, F.element_at(at, i + 1)))))

    spans = _once(F.arrays_zip(*zipped), lambda xs: _once(in_blocks(xs), of_blocks))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def _weight(n: Column) -> Column:
    """n * log2(n) for a count in a window."""
    return F.element_at(F.array(*[F.lit(i * math.log2(i) if i else 0.0) for i in range(WINDOW + 1)]), n + 1)


def _count(window: Column, c: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, c, F.lit("")))


def highest_entropy(candidate: Column) -> Column:
    """Bits per character of the window of highest entropy; 0 for a string shorter than a window."""

    def block_least(block: Column) -> Column:
        first = F.substring(block, 1, WINDOW)
        begin = F.aggregate(
            F.array_distinct(F.split(first, "")),
            F.lit(0.0),
            lambda s, c: s + F.when(c == "", F.lit(0.0)).otherwise(_weight(_count(first, c))),
        )

        def slide(done: Column, i: Column) -> Column:
            window = F.substr(block, i, F.lit(WINDOW))
            out, enters = F.substr(block, i, F.lit(1)), F.substr(block, i + WINDOW, F.lit(1))
            left, came = _count(window, out), _count(window, enters)
            moved = done["s"] + _weight(left - 1) - _weight(left) + _weight(came + 1) - _weight(came)
            s = F.when(out == enters, done["s"]).otherwise(moved)
            return F.struct(s.alias("s"), F.least(done["least"], s).alias("least"))

        steps = F.length(block) - WINDOW
        turns = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        return _once(begin, lambda s: F.aggregate(turns, F.struct(s.alias("s"), s.alias("least")), slide, lambda done: done["least"]))

    # each block with the characters that its last windows reach into, cut in one run over the candidate
    cut = F.regexp_extract_all(candidate, F.lit(f"(?s)(?=(.{{1,{BLOCK + WINDOW - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    blocks = F.filter(cut, lambda block: F.length(block) >= WINDOW)
    least = F.array_min(F.transform(blocks, block_least))
    bits = F.round(F.lit(math.log2(WINDOW)) - least / WINDOW, 9)
    return F.when(F.length(candidate) >= WINDOW, bits).otherwise(F.lit(0.0))


def _entropy_kind(hit: Column, bits: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | hit.rlike(pattern)
    kind = F.lit(None).cast("int")
    for name, (shape, least) in reversed(CLASSES.items()):
        kind = F.when(hit.rlike(shape), F.when(bits >= least, F.lit(KINDS.index(name)))).otherwise(kind)
    return F.when(~allowed, kind)


def secret_spans(text: Column) -> tuple[Column, Column]:
    """Spans (start, kind, end) of the fixed patterns, and those that entropy adds; kinds are numbers of KINDS."""
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    fixed = F.concat(
        _located(text, ASSIGN, lambda hit, value: F.when(F.length(value) >= 6, F.lit(0)), extra=value),
        _located(text, ACCESS, lambda hit: F.lit(1)),
        _located(text, HEX, lambda hit: F.lit(2)),
    )
    bits = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), highest_entropy)
    return F.array_sort(fixed), _located(text, CANDIDATE, _entropy_kind, extra=bits)


def number_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the numbers of fixed spans, their digest, and all spans as a string."""
    fixed, added = secret_spans(F.col("_text"))
    found = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).select("doc_id", fixed.alias("_fixed"), added.alias("_added"))
    n = [number_of(F.col("_fixed"), k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id",
        *n,
        F.sha2(written(F.col("_fixed")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("_fixed", "_added"))).alias("spans"),
    )
