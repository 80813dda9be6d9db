"""Personal data: fixed patterns, and the terms that give the protected values away.

A protected value (an address, a number) is disclosed by a word of the same documents that stands hardly anywhere
else. Counted over whole documents, with e a value, t a term outside all values and both in one document:

    disclosure(t, e) = pointwise mutual information of t and e / information content of e
                     = log(n(t,e) n / (n(t) n(e))) / log(n / n(e)),

1 if the term never stands without the value. Terms of `threshold` or more that share `support` or more different
texts with the value are generalised wherever they stand, in documents without the value too; those of `remove` or
more are removed (Sanchez and Batet's disclosure risk). A pair in one or two texts tells nothing of the corpus, as
every rare word would disclose every value beside it; so `support` is 3 unless it is given.

Since n(t,e) <= n(e), a term passes only if n(t) <= n^(1-threshold) n(e)^threshold, and a value only if it stands in
`support` texts. Both are known before any pair is made; texts look them up in bitmaps of fixed size, which let a few
others through that later joins drop. So no pair is lost and no table goes to the tasks as a whole.

Edge cases: null and empty texts have no spans. Positions count code points. Documents count by rows, the support
by different texts, so that copies of one text disclose nothing. A value in every document tells nothing and has no
terms. Repeated rows get equal rows, null ids are kept, other columns stay as they are whatever their names; an
empty table gives no rows. Counts of hot values and terms are made distinct and added up before their shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import bounded_batches, strings, whole
from docvec.scratch import materialize, staged

KINDS = ["email", "ip", "card", "phone", "term"]
TERM = KINDS.index("term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# a run of digits matches from its first one on or not at all, so later starts need not be tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
THRESHOLD, REMOVE, SUPPORT = 0.7, 0.95, 3
BITS = 24  # a bitmap of keys has 2 ** BITS places, which are 2 MB, however many keys there are
KEPT_KEYS, COUNTED = 50_000, 100_000  # words that a worker remembers the answers of, and counts before it sends them; some 200 bytes each
_PIECE = 15  # in pieces of 2 ** _PIECE places, as Spark's bitmap functions make them

FOUND = "spans array<struct<start:int,kind:int,end:int>>, values array<string>"
PLACES = "array<struct<term:string,start:int,end:int>>"


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The name is the whole run of its characters before an @, back to the last address."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        done = found.end() if found else at + 1
        if found:
            yield begin, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def protected_value(text: str, kind: int) -> str:
    """One spelling for each value."""
    return f"{KINDS[kind]}:{text.lower() if kind < 2 else _digits(text)}"


def outside_words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word in lower case, start, end) of all words that no value overlaps."""
    i = reach = 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while i < len(spans) and spans[i][0] < b:
            reach = max(reach, spans[i][2])
            i += 1
        if reach <= a:
            yield m[0].lower(), a, b


def distinct_words(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    return {w for w, _, _ in outside_words(text, spans)} if spans else {w.lower() for w in set(_WORD.findall(text))}


def _find(column: pa.Array) -> pa.Array:
    rows = []
    for text in strings(column):
        spans = base_spans(text)
        values = sorted({protected_value(text[s:e], k) for s, k, e in spans})
        rows.append({"spans": [{"start": s, "kind": k, "end": e} for s, k, e in spans], "values": values})
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    return pa.array(rows, pa.struct([("spans", pa.list_(span)), ("values", pa.list_(pa.string()))]))


def _found(text: Column) -> Column:
    return F.arrow_udf(_find, FOUND)(text)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each word stands outside values, added up over the task as far as memory allows."""
    counts: Counter[str] = Counter()

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])

    for batch in batches:
        for text in strings(batch.column(0)):
            counts.update(distinct_words(text, base_spans(text)))
            if len(counts) > COUNTED:
                yield send()
                counts.clear()
    if counts:
        yield send()


def bitmap(keys: DataFrame, column: str) -> bytes:
    """Which of 2 ** BITS places, by a checksum, hold a key: at most 2 ** (BITS - _PIECE) rows of 4 KB come to the driver."""
    place = F.crc32(F.col(column).cast("binary")) % (1 << BITS)
    pieces = keys.select(F.shiftright(place, _PIECE).alias("piece"), (place % (1 << _PIECE)).alias("bit"))
    size = (1 << _PIECE) // 8
    bits = bytearray((1 << BITS) // 8)
    for row in pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[row["piece"] * size : (row["piece"] + 1) * size] = row["bits"]
    return bytes(bits)


class MayHold:
    """Whether a bitmap may hold a key; never wrong for one that it holds. Remembers the answers of frequent keys."""

    def __init__(self, bits: bytes):
        self.bits, self.known = bits, {}

    def __call__(self, key: str) -> bool:
        answer = self.known.get(key)
        if answer is None:
            place = zlib.crc32(key.encode("utf-8", "replace")) % (1 << BITS)
            answer = bool(self.bits[place >> 3] >> (place & 7) & 1)
            if len(self.known) > KEPT_KEYS:
                self.known.clear()
            self.known[key] = answer
        return answer


def _together(values: bytes, terms: bytes):
    """A function of batches (text, text_hash) to rows (value, text_hash, terms), for values and terms that bitmaps may hold."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, term = MayHold(values), MayHold(terms)
        rows: list[tuple[str, int, list[str]]] = []
        held = 0

        def send() -> pa.RecordBatch:
            columns = zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.list_(pa.string())], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["value", "text_hash", "terms"])

        for batch in batches:
            for text, text_hash in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                spans = base_spans(text)
                kept = [v for v in sorted({protected_value(text[s:e], k) for s, k, e in spans}) if value(v)]
                words = [w for w in distinct_words(text, spans) if term(w)] if kept else []
                for v in kept if words else []:
                    rows.append((v, text_hash, words))
                    held += len(words)
                    if held > 200_000:
                        yield send()
                        rows, held = [], 0
        if rows:
            yield send()

    return together


def _places(terms: bytes):
    """A function of texts to the places of words outside values that a bitmap may hold."""
    place = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    may = MayHold(terms)

    def places(column: pa.Array) -> pa.Array:
        rows = []
        for text in strings(column):
            some = any(may(w.lower()) for w in set(_WORD.findall(text)))
            hits = [x for x in outside_words(text, base_spans(text)) if may(x[0])] if some else []
            rows.append([{"term": w, "start": a, "end": b} for w, a, b in hits])
        return pa.array(rows, pa.list_(place))

    return places


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: text_hash, spans of the fixed patterns and its protected values."""
    bounded_batches(docs.sparkSession)
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), _found(text).alias("f"))
    return rows.select("doc_id", "text_hash", "f.spans", "f.values")


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """value, term, risk: the pairs whose disclosure passes the threshold, a stored table."""
    n = found.count()
    text = whole(text_col)
    by_text = found.where(F.size("values") > 0).select(F.explode("values").alias("value"), "text_hash").groupBy("value", "text_hash").count()
    by_value = by_text.groupBy("value").agg(F.sum("count").alias("n_value"), F.count("*").alias("texts"))
    shared = by_value.where((F.col("texts") >= support) & (F.col("n_value") < n)).select("value", "n_value")
    with staged(shared, "values") as values:
        most = values.agg(F.max("n_value")).first()[0] or 0
        bound = n ** (1 - threshold) * most**threshold * (1 + 1e-9)
        counted = docs.select(text.alias("t")).mapInArrow(_word_counts, "term string, n long")
        terms = counted.groupBy("term").agg(F.sum("n").alias("n_term")).where((F.col("n_term") >= support) & (F.col("n_term") <= bound))
        with staged(terms if most else terms.limit(0), "terms") as terms:
            together = _together(bitmap(values, "value"), bitmap(terms, "term"))
            rows = docs.select(text.alias("t"), F.xxhash64(text).alias("text_hash"))
            rows = rows.mapInArrow(together, "value string, text_hash long, terms array<string>") if most else rows.where(F.lit(False)).select(
                F.lit("").alias("value"), "text_hash", F.array(F.lit("")).alias("terms")
            )
            by_text = rows.select("value", "text_hash", F.explode("terms").alias("term")).groupBy("value", "term", "text_hash").count()
            pairs = by_text.groupBy("value", "term").agg(F.sum("count").alias("n_both"), F.count("*").alias("texts"))
            met = pairs.where(F.col("texts") >= support).join(values, "value").join(terms, "term")
            joint = F.log(F.col("n_both") * F.lit(float(n)) / (F.col("n_term") * F.col("n_value")))
            risk = joint / F.log(F.lit(float(n)) / F.col("n_value"))
            return materialize(met.select("value", "term", risk.alias("risk")).where(F.col("risk") >= threshold), "disclosing")


def term_spans(docs: DataFrame, disclosing: DataFrame, bits: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _hash, terms (start, kind, end, risk): all places of disclosing terms in all documents; `bits` is their bitmap."""
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), F.explode(F.arrow_udf(_places(bits), PLACES)(text)).alias("x"))
    risks = disclosing.groupBy("term").agg(F.max("risk").alias("risk"))
    hits = rows.select("_id", "_hash", "x.*").join(risks, "term").groupBy("_id", "_hash", "start", "end").agg(F.max("risk").alias("risk"))
    span = F.struct("start", F.lit(TERM).alias("kind"), "end", "risk")
    return hits.groupBy("_id", "_hash").agg(F.sort_array(F.collect_list(span)).alias("terms"))


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))


def number_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """Per document the numbers of fixed spans, their digest, and all spans, terms included, as a string."""
    found = materialize(find(docs, id_col, text_col), "found")
    disclosing = disclosing_terms(docs, found, text_col, threshold, support)
    terms = term_spans(docs, disclosing, bitmap(disclosing, "term"), id_col, text_col)
    plain = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    extra = F.coalesce(plain, F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    n = [number_of(F.col("spans"), k).alias(f"n_{KINDS[k]}") for k in range(TERM)]
    rows = found.select("doc_id", "text_hash", "spans").join(terms, _same(), "left")
    return rows.select(
        "doc_id",
        *n,
        F.sha2(written(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("spans", extra))).alias("spans"),
    )


def sanitised_text(text: str, terms: list[dict], remove: float = REMOVE) -> str:
    """Values become their kind in brackets; terms become [term], or nothing where they tell nearly all."""
    cuts = [(s, e, f"[{KINDS[k]}]") for s, k, e in base_spans(text)]
    cuts += [(t["start"], t["end"], "" if t["risk"] >= remove else "[term]") for t in terms]
    out, at = [], 0
    for s, e, name in sorted(cuts):
        if s < at:  # inside the last one, or beginning there
            at = max(at, e)
            continue
        out += [text[at:s], name]
        at = e
    return "".join([*out, text[at:]])


def _sanitise(remove: float):
    def sanitised(text: pa.Array, terms: pa.Array) -> pa.Array:
        return pa.array([sanitised_text(t or "", x or [], remove) for t, x in zip(text.to_pylist(), terms.to_pylist(), strict=True)], pa.string())

    return sanitised


def _unused(docs: DataFrame, names: list[str]) -> list[str]:
    """The names, made longer where the table has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    return [next(x for k in range(len(taken) + 1) if (x := name + "_" * k) not in taken) for name in names]


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, remove: float = REMOVE, support: int = SUPPORT
) -> DataFrame:
    """The same rows with sanitised texts; one without protected values and disclosing terms stays as it is, a null one null.

    Only rows that hold a value, or may hold a term, are shuffled, to meet their terms.
    """
    with staged(find(docs, id_col, text_col), "found") as found:
        disclosing = disclosing_terms(docs, found, text_col, threshold, support)
    bits = bitmap(disclosing, "term")
    held, key, of_id, of_hash, of_terms = _unused(docs, ["_held", "_key", "_of_id", "_of_hash", "_of_terms"])
    terms = term_spans(docs, disclosing, bits, id_col, text_col).withColumnsRenamed({"_id": of_id, "_hash": of_hash, "terms": of_terms})
    find_places = _places(bits)

    def touched(column: pa.Array) -> pa.Array:
        places = find_places(column)
        return pa.array([bool(len(x)) or bool(base_spans(t)) for t, x in zip(strings(column), places, strict=True)], pa.bool_())

    text = whole(text_col)
    marked = docs.withColumn(held, F.arrow_udf(touched, "boolean")(text))
    hashed = marked.where(F.col(held)).withColumn(key, F.xxhash64(text))
    met = hashed.join(terms, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_hash)), "left")
    clean = met.withColumn(text_col, F.arrow_udf(_sanitise(remove), "string")(F.col(text_col), F.col(of_terms))).select(docs.columns)
    return marked.where(~F.col(held)).select(docs.columns).unionByName(clean)
