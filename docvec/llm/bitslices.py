"""Ranked lexical search over bit-sliced Bloom signatures.

Index: documents of about as many distinct terms share a block. A document's signature is a Bloom filter of its
(term, level) pairs, where a term is there at every level whose number of occurrences it reaches. A block keeps its
signatures by slices: for each bit a bitmap with a place for each document. Beside them it keeps its terms and how often
each document holds them.

Search: of a term's slices the AND is a bitmap of the documents that may hold it, never too few. With the most
occurrences that a level stands for, the weighted sum over the slices of an item's terms is an upper bound of the score
of every document of the block. Documents whose bound is below the k-th best score known to the task can not be
among the k best; all others are scored again from their real numbers, in whole numbers. Tasks give k rows for each
item, and those are ranked.

The score: with N documents that have a term, L terms in all of them, df the documents that hold a term, n the terms of
a document, tf the occurrences of a term in it,

    w = floor(1000 ln((2 N + 2) / (2 df + 1)))      m = 10 + 90 n N div L
    score = sum over the item's terms, each once, of w ((1000000000 tf) div (1000 tf + 8 m))

Items are searched in blocks of bounded size, each sent to the tasks that read the index; all documents meet all items.

Edge cases: null and empty texts have no terms and are never found; an item without known terms gets no rows. Every row
is a document and an item of its own, rows with equal ids too; documents of equal score are ordered by id, null
ids last. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docvec.llm.common import bounded_batches, raw_bytes, table_of_terms, whole
from docvec.scratch import materialize

# Fixed values of the score.
UNIT, PER_TF, PER_M, FLOOR, SLOPE = 1_000_000_000, 1000, 8, 10, 90

TOP_K = 10
HASHES = 3
# A term that stands so often in a document reaches the level of that place.
LEVELS = np.array([1, 2, 3, 4, 5, 6, 8, 12, 16, 32, 64, 256, 1024])
BLOCK_DOCS = 512
BLOCK_ENTRIES = 1 << 17  # distinct terms of a block's documents, added up
BITS_PER_ENTRY = 8  # at least; at most twice as many
# Items in a block of queries, and their terms added up; one item may hold more.
BLOCK_ITEMS, BLOCK_TERMS = 256, 20_000

_PIECE = 1 << 20
_ABSENT = 255
_INDEX = (
    "ids array<long>, lengths array<long>, n_documents long, n_terms long, bits int, slices binary, "
    "terms array<binary>, df array<long>, starts binary, entries binary, counts binary"
)
_SEPARATORS = table_of_terms(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def term_counts(text: bytes) -> Counter[bytes]:
    """The terms of a UTF-8 text, A-Z lower-cased, with their occurrences; a long text a piece at a time."""
    if len(text) <= _PIECE:
        return Counter(text.translate(_SEPARATORS).split())
    counts: Counter[bytes] = Counter()
    rest = b""
    for at in range(0, len(text), _PIECE):
        piece = rest + text[at : at + _PIECE].translate(_SEPARATORS)
        end = piece.rfind(b" ") + 1
        rest = piece[end:]  # a term that may go on
        counts.update(piece[:end].split())
    counts.update(rest.split())
    return counts


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in terms], dtype=np.uint64)


def places(hashes: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """The bits of terms at a level; `bits` is a power of two."""
    h = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)]


class _Block:
    """Documents of one size class on their way to a row of the index."""

    def __init__(self, size_class: int) -> None:
        self.size_class = size_class
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.entries: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, counts: Counter[bytes]) -> None:
        number = self.numbers
        self.ids.append(doc_id)
        self.entries.append(np.array([number.setdefault(t, len(number)) for t in counts], dtype=np.int32))
        self.counts.append(np.fromiter(counts.values(), dtype=np.int32, count=len(counts)))
        self.lengths.append(counts.total())
        self.size += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.size >= BLOCK_ENTRIES

    def row(self) -> dict:
        n = len(self.ids)
        terms, entries, counts = list(self.numbers), np.concatenate(self.entries), np.concatenate(self.counts)
        sizes = [len(e) for e in self.entries]
        doc = np.repeat(np.arange(n), sizes)
        bits = BITS_PER_ENTRY << self.size_class
        signatures = np.zeros((bits, n), dtype=bool)
        hashes = _hashes(terms)
        for level, least in enumerate(LEVELS):
            there = np.flatnonzero(counts >= least)
            if not len(there):
                break
            for place in places(hashes[entries[there]], level, bits):
                signatures[place, doc[there]] = True
        return {
            "ids": self.ids, "lengths": self.lengths, "n_documents": n, "n_terms": sum(self.lengths), "bits": bits,
            "slices": np.packbits(signatures, axis=1).tobytes(), "terms": terms, "df": np.bincount(entries, minlength=len(terms)).tolist(),
            "starts": np.cumsum([0, *sizes]).astype(np.int64).tobytes(), "entries": entries.tobytes(),
            "counts": counts.tobytes(),
        }


def _entries_with_levels(counts: Counter[bytes]) -> int:
    """How many (term, level) pairs a document has, from the terms alone: repeated ones reach few levels more."""
    return len(counts) + sum(1 for c in counts.values() if c > 1)


_SCHEMA = pa.schema(
    [
        ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_documents", pa.int64()), ("n_terms", pa.int64()),
        ("bits", pa.int32()), ("slices", pa.binary()), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int64())),
        ("starts", pa.binary()), ("entries", pa.binary()), ("counts", pa.binary()),
    ]
)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of a task, by the bit length of their numbers of entries."""
    open_blocks: dict[int, _Block] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
            counts = term_counts(text)
            if not counts:
                continue
            size_class = _entries_with_levels(counts).bit_length()
            block = open_blocks.setdefault(size_class, _Block(size_class))
            block.add(doc_id, counts)
            if block.full():
                yield pa.RecordBatch.from_pylist([open_blocks.pop(size_class).row()], schema=_SCHEMA)
    for block in open_blocks.values():
        yield pa.RecordBatch.from_pylist([block.row()], schema=_SCHEMA)


@dataclass(frozen=True)
class LexicalIndex:
    """Blocks of signatures, and how many documents and terms there are in all."""

    blocks: DataFrame
    n_documents: int
    n_terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """Slice all documents; the texts are gone through once and not moved."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).cast("binary").alias("text"))
    blocks = materialize(rows.mapInArrow(_sliced, _INDEX), "slices")
    n, terms = blocks.agg(F.coalesce(F.sum("n_documents"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return LexicalIndex(blocks, n, terms)


@dataclass(frozen=True)
class Queries:
    """A block of items, the distinct terms of all, and the weight of each item's terms, by their places."""

    items: np.ndarray
    terms: list[bytes]
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def matrix(self) -> np.ndarray:
        """An item a row, a term a column; in doubles while all scores are whole numbers that fit them."""
        total = np.bincount(self.item, weights=self.weight).max(initial=0.0) * (UNIT / PER_TF)
        weights = np.zeros((len(self.items), len(self.terms)), dtype=np.float64 if total < 2.0**53 else np.int64)
        weights[self.item, self.term] = self.weight
        return weights


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (UNIT * tf) // (PER_TF * tf + PER_M * m)


class _Best:
    """The k best documents of each item, as far as a task has come."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.score = np.zeros((n_items, k), dtype=np.int64)  # 0: no document
        self.id = np.zeros((n_items, k), dtype=np.int64)
        self.no_id = np.ones((n_items, k), dtype=bool)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """New documents of items; those with equal scores and ids are all kept as far as there is room."""
        touched, row = np.unique(item, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), row])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        no_id = np.concatenate([self.no_id[touched].ravel(), no_id])
        order = np.lexsort((ids, no_id, -score, row))
        starts = np.searchsorted(row[order], np.arange(len(touched)))
        kept = order[(starts[:, None] + np.arange(self.k)).ravel()]
        shape = (len(touched), self.k)
        self.score[touched], self.id[touched] = score[kept].reshape(shape), ids[kept].reshape(shape)
        self.no_id[touched] = no_id[kept].reshape(shape)


def _bounds(weights: np.ndarray, hashes: np.ndarray, bits: int, slices: np.ndarray, lengths: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most that each document of a block can score for each item."""
    n = len(lengths)
    reached = np.full((len(hashes), n), _ABSENT, dtype=np.uint8)
    rows = np.arange(len(hashes))
    may: np.ndarray | None = None
    for level in range(len(LEVELS)):
        maps = np.bitwise_and.reduce([slices[p] for p in places(hashes[rows], level, bits)])
        maps = maps if may is None else maps & may  # a level is reached through those below
        some = maps.any(axis=1)
        rows, may = rows[some], maps[some]
        if not len(rows):
            break
        term, doc = np.nonzero(np.unpackbits(may, axis=1, count=n))
        reached[rows[term], doc] = level
    most = np.append(LEVELS[1:] - 1, np.iinfo(np.int32).max)
    table = np.zeros((_ABSENT + 1, n), dtype=weights.dtype)
    for level in range(len(LEVELS)):
        table[level] = contribution(np.minimum(most[level], lengths), m)
    return weights @ table[reached, np.arange(n)]


def _real(weights: np.ndarray, number: dict[bytes, int], row: dict, keep: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The scores of the documents `keep` of a block for every item, from their real counts."""
    starts = np.frombuffer(row["starts"], dtype=np.int64)
    of_block = np.array([number.get(t, -1) for t in row["terms"]], dtype=np.int64)
    place = np.full(len(starts) - 1, -1)
    place[keep] = np.arange(len(keep))
    doc = np.repeat(place, np.diff(starts))
    term = of_block[np.frombuffer(row["entries"], dtype=np.int32)]
    wanted = np.flatnonzero((term >= 0) & (doc >= 0))
    doc, term = doc[wanted], term[wanted]
    found = np.zeros((weights.shape[1], len(keep)), dtype=weights.dtype)
    found[term, doc] = contribution(np.frombuffer(row["counts"], dtype=np.int32)[wanted].astype(np.int64), m[keep[doc]])
    return (weights @ found).astype(np.int64)


def _searched(queries: Queries, n_documents: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hashes = queries.matrix(), _hashes(queries.terms)
        number = {t: i for i, t in enumerate(queries.terms)}
        best = _Best(len(queries.items), k)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                lengths = np.array(row["lengths"], dtype=np.int64)
                m = FLOOR + (SLOPE * lengths * n_documents) // n_terms
                slices = np.frombuffer(row["slices"], dtype=np.uint8).reshape(row["bits"], -1)
                bound = _bounds(weights, hashes, row["bits"], slices, lengths, m)
                no_id = np.array([i is None for i in row["ids"]])
                ids = np.array([i or 0 for i in row["ids"]], dtype=np.int64)
                # first the k of the highest bounds, which raise what the others have to reach
                first = np.argpartition(-bound, min(k, bound.shape[1]) - 1, axis=1)[:, :k]
                leading = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(leading, first, True, axis=1)
                for turn in (leading, ~leading):
                    item, doc = np.nonzero(turn & (bound > 0) & (bound >= best.worst()[:, None]))
                    if not len(item):
                        continue
                    keep, column = np.unique(doc, return_inverse=True)
                    score = _real(weights, number, row, keep, m)[item, column]
                    there = np.flatnonzero((score > 0) & (score >= best.worst()[item]))
                    best.offer(item[there], score[there], ids[doc[there]], no_id[doc[there]])
        item, place = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(queries.items[item], pa.int64()),
                pa.array(best.id[item, place], pa.int64(), mask=best.no_id[item, place]),
                pa.array(best.score[item, place], pa.int64()),
            ],
            ["item", "doc_id", "score"],
        )

    return run


def _asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number for each row), item_id, and the distinct terms of its text."""

    def terms(column: pa.Array) -> pa.Array:
        return pa.array([list(term_counts(t)) for t in raw_bytes(column)], pa.list_(pa.binary()))

    found = F.arrow_udf(terms, "array<binary>")(whole(text_col).cast("binary")).alias("terms")
    return materialize(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), found), "items")


def _weighted(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """item, term, weight of all terms that a document holds."""
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    held = index.blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select("x.terms", "x.df")
    df = held.withColumnRenamed("terms", "term").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.n_documents + 2) / (2.0 * F.col("df") + 1)))
    weights = df.select("term", weight.cast("long").alias("weight"))
    return asked.select("item", F.explode("terms").alias("term")).join(weights, "term").where("weight > 0")


def _blocks_of(weighted: DataFrame) -> Iterator[Queries]:
    """Items with their weights, a bounded block at a time."""
    items, terms = weighted.agg(F.count_distinct("item"), F.count("*")).first()
    n = max(1, -(-items // BLOCK_ITEMS), -(-terms // BLOCK_TERMS))
    for block in range(n):
        rows = weighted.where(F.pmod(F.xxhash64("item"), F.lit(n)) == block).toArrow()
        if not rows.num_rows:
            continue
        item = rows["item"].to_numpy()
        names, of_item = np.unique(item, return_inverse=True)
        words = rows["term"].combine_chunks().dictionary_encode()
        term = words.indices.to_numpy(zero_copy_only=False)
        yield Queries(names, words.dictionary.to_pylist(), of_item, term, rows["weight"].to_numpy())


def search(index: LexicalIndex, items: DataFrame, k: int = TOP_K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score, best first."""
    spark = items.sparkSession
    bounded_batches(spark)  # rows of the index are large
    asked = _asked(items, id_col, text_col)
    weighted = materialize(_weighted(index, asked), "weights")
    parts = [
        index.blocks.mapInArrow(_searched(q, index.n_documents, index.n_terms, k), "item long, doc_id long, score long")
        for q in _blocks_of(weighted)
    ]
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for part in parts if len(parts) == 1 else (materialize(p, "found") for p in parts):
        found = found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
