"""Packing into optimal length buckets.

A batch of texts is padded to one length. Buckets of lengths are chosen so that the padding of all texts is least:
dynamic programming over the histogram of lengths, counted over all documents, finds the upper bounds of at most
`buckets` buckets. Inside a bucket, batches hold as many texts as fit a budget of tokens at the bucket's length.

The histogram has one class per length up to 1,024 and 1,024 classes per doubling beyond, so it has under 60,000
rows however many documents or tokens there are; a class is as long as its longest text, and nothing is cut.

Edge cases: a null or empty text has length 0 and goes to the first bucket, as do all texts if there is one length
only. A text longer than the budget is a batch of its own. Documents of one length are dealt by a hash of id and
text; rows repeated as a whole are alike, so their order does not show: they travel as one row with their number, and
get their places piece by piece. Null ids are kept. An empty table gives no rows.

Beyond 1,024 the cuts lie between classes of lengths, so the padding is least among those cuts only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvec.llm.common import partitions, whole
from docvec.scratch import materialize

FINE = 1024
SLICE_ROWS = 100_000
COPIES = 10_000  # of one row, that are given their places at once
FIELDS = ["doc_id", "n_tokens", "bucket", "bucket_len", "batch", "position", "padding"]


def word_count(text: str = "text") -> Column:
    """Number of runs without ASCII blanks."""
    blank = "[\\x20\\x09-\\x0D]+"
    bare = F.regexp_replace(whole(text), f"^{blank}|{blank}$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, blank))).cast("long")


def length_class(n: Column) -> Column:
    """The length itself up to FINE, beyond it one of FINE steps of its doubling: never falls as lengths rise."""
    power = F.floor(F.log2(n.cast("double") / FINE))
    power = F.when(F.pow(F.lit(2.0), power) * FINE > n, power - 1).otherwise(power)  # a rounded logarithm
    step = F.floor(n / (F.pow(F.lit(2.0), power)))
    return F.when(n <= FINE, n).otherwise((power * FINE + step).cast("long"))


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padded total, by dynamic programming.

    cost(j) is the least total of padded lengths of the first j classes; a bucket over classes i .. j-1 costs
    their number of texts times the longest. Rows of the table are computed by divide and conquer, since the best
    cut never moves back as j grows.
    """
    m = len(lengths)
    total = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    tops = lengths.astype(np.float64)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    choice = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        new[0] = 0.0
        work = [(1, m, 0, m - 1)]
        while work:
            lo, hi, first, last = work.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            c = cost[i] + (total[j] - total[i]) * tops[j - 1]
            best = int(np.argmin(c))
            new[j], cut[j] = c[best], i[best]
            work += [(lo, j - 1, first, int(i[best])), (j + 1, hi, int(i[best]), last)]
        choice.append(cut)
        cost = new
    bounds, j = [], m
    for cut in reversed(choice):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pack(
    docs: DataFrame, buckets: int = 16, budget: int = 16_384, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None
) -> DataFrame:
    """One row per document: its length, bucket, bucket_len (padded length), batch, position in it, and padding.

    Batches are numbered from 0 in each bucket. Only ids, lengths and a hash are shuffled. A bucket may hold any
    share of the documents: it is dealt to slices of about 100,000 rows, numbered by themselves, and the few
    counts of the slices give the place where each one's numbers begin.
    """
    n = word_count(text_col) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    rows = materialize(
        docs.select(F.col(id_col).alias("doc_id"), n.alias("n_tokens"), F.xxhash64(F.col(id_col), whole(text_col)).alias("_hash")), "lengths"
    )
    histogram = rows.groupBy(length_class(F.col("n_tokens")).alias("c")).agg(F.max("n_tokens").alias("top"), F.count("*").alias("n")).orderBy("c")
    found = histogram.collect()
    bounds = bucket_bounds(np.array([r["top"] for r in found], dtype=np.int64), np.array([r["n"] for r in found]), buckets) if found else [0]
    slices = max(1, -(-sum(r["n"] for r in found) // SLICE_ROWS))
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    dealt = rows.withColumn("bucket", bucket).withColumn("_slice", F.pmod("_hash", F.lit(slices)))
    alike = dealt.groupBy("doc_id", "n_tokens", "_hash", "bucket", "_slice").agg(F.count("*").alias("_copies"))
    counts = dealt.groupBy("bucket", "_slice").count()
    before = Window.partitionBy("bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("bucket", "_slice").orderBy("_hash", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(
        alike.withColumn("_until", F.sum("_copies").over(inside)).join(starts, ["bucket", "_slice"])
        .select("doc_id", "n_tokens", "bucket", (F.col("_start") + F.col("_until") - F.col("_copies")).alias("_first"), "_copies"),
        "places",
    )
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long"))).alias("_from")
    hot = placed.where(F.col("_copies") > COPIES).select("*", piece).repartition(partitions(docs.sparkSession), "doc_id", "bucket", "_first", "_from")
    pieces = hot.select(
        "doc_id", "n_tokens", "bucket", (F.col("_first") + F.col("_from")).alias("_first"), F.least(F.lit(COPIES), F.col("_copies") - F.col("_from")).alias("_copies")
    )
    rest = placed.where(F.col("_copies") <= COPIES)
    place = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias("_place")
    top = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(top, F.lit(1))))
    return (
        rest.unionByName(pieces)
        .select("doc_id", "n_tokens", "bucket", top.alias("bucket_len"), per_batch.alias("_size"), place)
        .select(
            "doc_id", "n_tokens", "bucket", "bucket_len",
            F.floor(F.col("_place") / F.col("_size")).alias("batch"),
            (F.col("_place") % F.col("_size")).alias("position"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )
