"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into the phrases of its own growing dictionary (LZ78): each phrase is the
longest one known so far and one more character. The set of phrases is hashed, and one minimum per slot of the
hash space is kept. Texts that a compressor would write with the same dictionary have equal slots.

Edge cases: a null text counts as empty; an empty text has the empty fingerprint, which is like another empty
one (1.0) and unlike all others (0.0). A null id sorts first. Rows that repeat an id are ordered by their text,
and each of them has a next one. The next document of the last one is the first; of a single one, itself. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import LOWEST_ID, partitions, run_hashes, whole

SLOTS = 128

FIELDS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def parse(text: str, start: int, seen: set[str], ends: list[int], stop: int | None = None) -> int:
    """Parse text[start:stop] on; phrases go to `seen`, their ends to `ends`.

    Returns where a last phrase begins that is known already, so unfinished; `stop` if there is none.
    """
    add, note = seen.add, ends.append
    at, phrase = start, ""
    for at, c in enumerate(text[start:stop], start + 1):  # noqa: B007
        phrase += c
        if phrase not in seen:
            add(phrase)
            note(at)
            phrase = ""
    return at - len(phrase)


def phrase_hashes(text: str, first: int, ends: list[int]) -> np.ndarray:
    """64-bit hashes of the phrases that begin at `first` and stop at `ends`."""
    if not ends:
        return np.empty(0, dtype=np.uint64)
    codes = np.frombuffer(text[first : ends[-1]].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    to = np.asarray(ends, dtype=np.int64) - first
    return run_hashes(codes, np.concatenate((np.zeros(1, dtype=np.int64), to[:-1])), to)


def signature(hashes: np.ndarray) -> np.ndarray | None:
    """Of the least hash in each of the slots 16 bits; an empty slot borrows from the next full one."""
    if not len(hashes):
        return None
    h = np.sort(hashes)
    slot = (h >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate((np.ones(1, dtype=bool), slot[1:] != slot[:-1])))
    full, value = slot[first], (h[first] & np.uint64(0xFFFF)).astype(np.int64)
    if len(full) == SLOTS:
        return value.astype(np.uint16)
    wanted = np.arange(SLOTS)
    at = np.searchsorted(full, wanted) % len(full)
    away = (full[at] - wanted) % SLOTS
    return ((value[at] + away * 40503) & 0xFFFF).astype(np.uint16)


def written(sig: np.ndarray | None) -> str:
    return "" if sig is None else sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal slots, which estimates the Jaccard likeness of the phrase sets."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.count_nonzero(a == b)) / SLOTS


def fingerprint(text: str) -> np.ndarray | None:
    ends: list[int] = []
    parse(text, 0, set(), ends)
    return signature(phrase_hashes(text, 0, ends))


def fingerprints(text: str, following: str) -> tuple[np.ndarray | None, str, np.ndarray | None]:
    """The fingerprint of a text, its edited text and that one's fingerprint.

    Both texts begin with the same characters, which are parsed once.
    """
    n = len(text)
    cut = n - n // 2
    edited = text[:cut] + following[: n // 2]
    seen: set[str] = set()
    ends: list[int] = []
    at = parse(text, 0, seen, ends, cut)
    common = phrase_hashes(text, 0, ends)
    both = []
    for whole_text, known in ((text, seen.copy()), (edited, seen)):
        more: list[int] = []
        parse(whole_text, at, known, more)
        both.append(signature(np.concatenate((common, phrase_hashes(whole_text, at, more)))))
    return both[0], edited, both[1]


def _ranges(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of id ranges of about equal size, and the least id found in each range.

    Both are one number per range, a few per shuffle partition.
    """
    n = 4 * partitions(docs.sparkSession)
    cuts = docs.approxQuantile("_key", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = np.unique(np.asarray(cuts, dtype=np.float64).astype(np.int64))
    place = _place(bounds)
    least = docs.groupBy(place("_key").alias("r")).agg(F.min("_key").alias("least")).orderBy("r").collect()
    return bounds, np.array([[x["r"], x["least"]] for x in least], dtype=np.int64).reshape(-1, 2)


def _place(bounds: np.ndarray):
    @F.arrow_udf("int")
    def place(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, key.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return place


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range in the order of ids, each range closed by the first row of the next one."""
    held = None  # range, id, text of the row that waits for its next one
    own = None  # its fingerprint, edited text and edited fingerprint are made when the next text is known
    for batch in batches:
        out = []
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for r, tail, doc_id, text in rows:
            text = text or ""
            if held is not None and held[0] == r:
                sig, edited, edited_sig = fingerprints(held[2], text)
                out.append((held, sig, edited, edited_sig, text))
            held = None if tail else (r, doc_id, text)
        # the fingerprint of a next text is mostly that of the row below
        rows_out = []
        for k, ((_, doc_id, text), sig, edited, edited_sig, following) in enumerate(out):
            if k + 1 < len(out) and out[k + 1][0][2] is following:
                own = out[k + 1][1]
            else:
                own = fingerprint(following)
            rows_out.append(
                (
                    doc_id,
                    len(text),
                    hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    written(sig),
                    written(edited_sig),
                    likeness(sig, edited_sig),
                    likeness(sig, own),
                )
            )
        if rows_out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_out, strict=True), _TYPES, strict=True)], _NAMES)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def phrase_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how near both and the next one's are.

    The edited text has its last half, floor(n_chars / 2) code points, replaced by as many from the start of the
    next document. The texts are shuffled once, by ranges of ids; the first row of a range goes to the one before
    it as well, so that every document meets its next one without a join.
    """
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST_ID)).alias("_key"),
        whole(text_col).alias("_text"),
    )
    bounds, least = _ranges(keyed.select("_key"))
    before = {int(k): int(least[i - 1][0]) for i, (_, k) in enumerate(least)}
    firsts, ranges = np.array(sorted(before), dtype=np.int64), np.array([before[k] for k in sorted(before)], dtype=np.int32)

    @F.arrow_udf("array<int>")
    def places(key: pa.Array) -> pa.Array:
        keys = key.to_numpy(zero_copy_only=False)
        home = np.searchsorted(bounds, keys, side="right")
        found = np.searchsorted(firsts, keys)
        lists = [[int(r)] for r in home]
        if len(firsts):
            found = np.minimum(found, len(firsts) - 1)
            for i in np.flatnonzero(firsts[found] == keys):
                lists[i].append(int(ranges[found[i]]))
        return pa.array(lists, pa.list_(pa.int32()))

    dealt = (
        keyed.select("*", F.posexplode(places("_key")).alias("_copy", "_range"))
        .repartition("_range")
        .sortWithinPartitions("_range", "_copy", "_key", "_text")
    )
    return dealt.select("_range", (F.col("_copy") > 0).alias("_tail"), "doc_id", "_text").mapInArrow(_neighbours, FIELDS)
