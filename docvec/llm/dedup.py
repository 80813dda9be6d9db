"""Near duplicates by MinHash bands and odd sketches, confirmed on whole shingle sets.

A document's set are its distinct runs of five words. Documents of equal sets form a class, and only one member of
each goes on. Its 250 minimum hashes make 50 bands of five; two sets of similarity 0.75 share no band once in 700,000
pairs, more alike ones far less. The minimum hashes are also folded into a bitmap of 512 bits, each toggling one: the
bits that differ between two such odd sketches tell how many samples do, precisely so for high similarity, and
rule out pairs that only share a band. A second odd sketch, of all shingles in 2048 bits, never has more differing
bits than two sets have differing shingles, and rules out pairs that are nearly similar enough without losing any.
What is left is decided on the whole sets.

No pair within a bucket is made that the result does not need. First every set is held against one other: the
first of the bucket that it shares most bands with. Confirmed links give components. Then only sets of different
components that share a bucket are compared, those outside a bucket's largest component with all others in it.

Edge cases: null and empty texts and texts of blanks have an empty set and stay alone; with fewer than five words the
whole sequence is the only shingle. Rows that repeat an id count as one document, which has the links of all their
texts, and stay or go together. So an id with several sets is a node of its own, linked to them all. A row without an id is linked like others; its component has the smallest id there is
in it, else null. Rows without ids are kept where no row of the component has one. Of such rows, and of those of a kept id,
`one_of_each` keeps one a component, that of the least text hash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import bounded_batches, mixed, raw_bytes, run_hashes, whole
from docvec.scratch import materialize

WORDS = 5
BANDS, ROWS = 50, 5
SAMPLES = BANDS * ROWS
BITS, WHOLE_BITS = 512, 2048
DIFFERENT_BITS = 160  # 99 are expected at similarity 0.75, with a deviation of 11
NO_ID = 1 << 62  # nodes of classes without an id below it lie above, and so never name a component that has one
FILTER_BITS = 1 << 25
_odd = mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
_FACTORS = (_odd[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TERMS = (_odd[SAMPLES:] >> np.uint64(32)).astype(np.uint32)
SUMMARY = "n_shingles long, set_id binary, bands array<long>, sketch array<long>, parity array<long>"


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    codes = np.frombuffer(line, dtype=np.uint8)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(lengths + 1) - 1
    begin = end - lengths
    if len(words) <= WORDS:
        return run_hashes(codes, begin[:1], end[-1:])
    return np.unique(run_hashes(codes, begin[: 1 - WORDS], end[WORDS - 1 :]))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for s in range(0, len(x), 512):
        np.minimum(least, (x[s : s + 512, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    places = mixed(least.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    return folded(places, BITS)


def folded(places: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount(places.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _summaries(column: pa.Array) -> pa.Array:
    n, ids, band, sketch, parity = [], [], [], [], []
    for text in raw_bytes(column):
        hashes = shingle_set(text)
        n.append(len(hashes))
        if len(hashes):
            least = samples(hashes)
            ids.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
            band.append(bands(least))
            sketch.append(odd_sketch(least))
            parity.append(folded(hashes % np.uint64(WHOLE_BITS), WHOLE_BITS))
        else:
            ids.append(None)
            band.append(None)
            sketch.append(None)
            parity.append(None)
    longs = pa.list_(pa.int64())
    columns = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(band, longs), pa.array(sketch, longs), pa.array(parity, longs)]
    return pa.StructArray.from_arrays(columns, ["n_shingles", "set_id", "bands", "sketch", "parity"])


def _shingles(column: pa.Array) -> pa.Array:
    return pa.array([shingle_set(t).view(np.int64) for t in raw_bytes(column)], pa.list_(pa.int64()))


def _summary(raw: Column) -> Column:
    return F.arrow_udf(_summaries, SUMMARY)(raw)


def _sets(raw: Column) -> Column:
    return F.arrow_udf(_shingles, "array<long>")(raw)


def connected(links: DataFrame) -> DataFrame:
    """node, root: the least node of the component of each node with a link (a, b).

    Large and small stars in turn (Kiveris et al.): every round points the neighbours of a node to its least one.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b"))
        edges = materialize(small.where("a > b").distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        state = now


def _differing(x: Column, y: Column) -> Column:
    """Bits that differ between two bitmaps. Written out, the many terms would be too long a method to be compiled."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, c: n + c)


def _alike() -> Column:
    """Whether the sets a and b can be similar enough, by their sizes and sketches.

    Of n + m shingles, at most a seventh may differ.
    """
    n, m = F.col("n_a"), F.col("n_b")
    sizes = 100 * F.least(n, m) >= 75 * F.greatest(n, m)
    sketches = _differing(F.col("sketch_a"), F.col("sketch_b")) <= DIFFERENT_BITS
    return sizes & sketches & (7 * _differing(F.col("parity_a"), F.col("parity_b")) <= n + m)


def _side(sketches: DataFrame, side: str) -> DataFrame:
    return sketches.withColumnsRenamed({"node": side, **{c: f"{c}_{side}" for c in ("n", "sketch", "parity")}})


def _may_be_among(nodes: DataFrame, id_col: Column) -> Column:
    """A filter that passes all given nodes and few others, from a bitmap of 4 MB at most.

    It only spares the shuffle of sets nobody asks for; the join after it decides.
    """
    place = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    bits = nodes.select((place / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    found = bits.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def among(place: pa.Array) -> pa.Array:
        p = place.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[p // 64] >> (p % 64)) & 1 == 1)

    return among(F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS)))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of 0.75 or more.

    texts: node and raw text, one row per node at least. Sets are made for the nodes of pairs only.
    """
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    asked = texts.where(_may_be_among(nodes, F.col("node"))).join(nodes, "node", "left_semi")
    sets = materialize(asked.select("node", _sets(F.col("raw")).alias("set")).dropDuplicates(["node"]), "sets")
    left, right = sets.withColumnsRenamed({"node": "a", "set": "x"}), sets.withColumnsRenamed({"node": "b", "set": "y"})
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("either"))
    return met.where(100 * F.col("both") >= 75 * F.col("either")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_shingles, component_id (smallest id reachable over links) and kept."""
    return components(docs, id_col, text_col).drop("text_hash", "root")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are kept, one document of each component, with all their columns.

    Only rows that may have to go meet the list of those that do; all others are passed on where they are read.
    """
    return _without(docs, components(docs, id_col, text_col).where(~F.col("kept")), None, id_col, text_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """without_near_duplicates with one row of each component, also where rows repeat an id or have none."""
    rows = materialize(components(docs, id_col, text_col), "components")
    kept = rows.where(F.col("kept") & F.col("root").isNotNull()).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    several = kept.groupBy("root").agg(F.min("text_hash").alias("least"), F.sum("n").alias("rows")).where("rows > 1")
    met = materialize(kept.join(several, "root"), "several")
    gone = rows.where(~F.col("kept")).select("doc_id", "text_hash").unionByName(met.where("text_hash != least").select("doc_id", "text_hash"))
    return _without(docs, gone, met.where("text_hash = least and n > 1"), id_col, text_col)


def _without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows `gone` by doc_id and text_hash, and with one of the rows of each that is `repeated`."""

    def listed(rows: DataFrame, label: str) -> DataFrame:
        return materialize(rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__of")).distinct(), label)

    gone = listed(gone, "gone")
    again = listed(repeated, "again") if repeated is not None else None
    nodes = (gone if again is None else gone.unionByName(again)).select(F.col("__of").alias("node"))
    text_hash = F.xxhash64(whole(text_col).cast("binary"))
    marked = docs.withColumn("__may_go", _may_be_among(nodes, text_hash))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__of"))
    asked = marked.where("__may_go").withColumn("__hash", text_hash).join(gone, same, "left_anti")
    out = marked.where("not __may_go").select(docs.columns)
    if again is None:
        return out.unionByName(asked.select(docs.columns))
    one = asked.join(again, same, "left_semi").dropDuplicates([id_col, "__hash"])
    return out.unionByName(asked.join(again, same, "left_anti").select(docs.columns)).unionByName(one.select(docs.columns))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates with the text_hash of each row, which tells rows of one id, or of none, apart, and the root of its component."""
    bounded_batches(docs.sparkSession)
    raw = whole(text_col).cast("binary")
    ids = F.col(id_col).cast("long")
    made = docs.select(ids.alias("doc_id"), F.xxhash64(raw).alias("text_hash"), _summary(raw).alias("s")).select("doc_id", "text_hash", "s.*")
    summaries = materialize(made, "summaries")
    of_id = F.coalesce(F.xxhash64("set_id"), F.lit(0))  # an empty set is one, too
    several = summaries.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(of_id).alias("lo"), F.max(of_id).alias("hi"))
    several = materialize(several.where("lo < hi").select("doc_id"), "several_sets")
    classes = summaries.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"))
    classes = classes.join(several.select(F.col("doc_id").alias("least"), F.lit(True).alias("shared")), "least", "left")
    # the least id names a class if all texts of that id are in it, else its set does
    unnamed = F.xxhash64("set_id").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    node = F.when(F.col("shared").isNull() & (F.col("least") < NO_ID), F.col("least"))
    classes = materialize(classes.select("set_id", "least", "text_hash", F.coalesce(node, unnamed).alias("node")), "classes")
    members = summaries.select("doc_id", "text_hash", "n_shingles", "set_id").join(classes.select("set_id", "node"), "set_id", "left")
    members = members.withColumn("node", F.coalesce("node", "doc_id"))
    of_ids = members.join(several, "doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).where("a != b").distinct()
    of_ids = materialize(of_ids, "id_links")
    one = summaries.drop("text_hash").join(classes, "set_id").where(F.col("doc_id").eqNullSafe(F.col("least")))
    one = one.select("node", "n_shingles", "bands", "sketch", "parity")
    sets = materialize(one.where(F.col("node") < NO_ID).unionByName(one.where(F.col("node") >= NO_ID).dropDuplicates(["node"])), "sets")

    entries = sets.select("node", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("band", "hub")
    live = materialize(entries.join(shared, "band"), "live")
    votes = live.where("node != hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    first = votes.groupBy(F.col("node").alias("a")).agg(F.max_by("hub", F.struct("n", F.bitwise_not("hub"))).alias("b"))
    sketches = sets.select("node", F.col("n_shingles").alias("n"), "sketch", "parity")
    met = first.join(_side(sketches, "a"), "a").join(_side(sketches, "b"), "b")
    pairs = materialize(met.where(_alike()).select("a", "b"), "pairs")

    # all texts of an id that names a class have its set; of any other class one text is found by its hash
    raws = docs.select(ids.alias("doc_id"), raw.alias("raw"))
    named = raws.select(F.col("doc_id").alias("node"), "raw").where(F.col("node").isNotNull())
    others = classes.where(F.col("node") >= NO_ID).select("node", "text_hash")
    hashed = raws.where(_may_be_among(others.select(F.col("text_hash").alias("node")), F.xxhash64("raw"))).select(F.xxhash64("raw").alias("text_hash"), "raw")
    texts = named.unionByName(hashed.dropDuplicates(["text_hash"]).join(others, "text_hash").select("node", "raw"))
    links = materialize(_confirmed(pairs, texts).unionByName(of_ids), "links")
    roots = materialize(connected(links), "roots")

    placed = live.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed_up = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    placed = placed.join(mixed_up, "band")
    largest = placed.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = materialize(placed.join(largest, "band").join(sketches, "node"), "rest")
    outside = _side(rest.where("root != main").drop("main"), "a").withColumnRenamed("root", "root_a")
    others = _side(rest.withColumn("is_main", F.col("root") == F.col("main")).drop("main"), "b").withColumnRenamed("root", "root_b")
    apart = outside.join(others, "band").where((F.col("root_a") != F.col("root_b")) & (F.col("is_main") | (F.col("a") < F.col("b"))) & _alike())
    late = materialize(apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "late")
    if not late.isEmpty():
        links = links.unionByName(_confirmed(late, texts))
        roots = connected(links)

    root = F.coalesce("root", "node")
    rows = members.join(roots, "node", "left").select("doc_id", "text_hash", "n_shingles", root.alias("root"))
    rows = _with_component(rows, summaries)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return rows.select("doc_id", "text_hash", "n_shingles", "component_id", kept.alias("kept"), "root")


def _with_component(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """component_id: the root where it is an id, the least id of the root's rows where all ids are as large as other nodes, else null."""
    named = F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id")
    if (summaries.agg(F.max("doc_id")).first()[0] or 0) < NO_ID:
        return rows.select("*", named)
    high = rows.where(F.col("root") >= NO_ID)
    least = materialize(high.groupBy("root").agg(F.min("doc_id").alias("component_id")), "large_ids")
    low = rows.where(F.col("root").isNull() | (F.col("root") < NO_ID)).select("*", named)
    return low.unionByName(high.join(least, "root").select(low.columns))
