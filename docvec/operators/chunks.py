"""Runs of tokens: one row per chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvec.functions.text import file_stem

# Fixed value: tokens in a chunk.
CHUNK_SIZE = 50
# Marks around an encoder's input and the most tokens it may hold.
START_MARK = "[CLS]"
END_MARK = "[SEP]"
MAX_INPUT = 512


def chunk_count(tokens: Column, size: int = CHUNK_SIZE) -> Column:
    """Chunks a token list makes; 0 for none and for null."""
    n = F.coalesce(F.size(tokens), F.lit(0))
    return F.ceil(F.greatest(n, F.lit(0)) / size)


def chunk_tokens(docs: DataFrame, size: int = CHUNK_SIZE, outer: bool = False) -> DataFrame:
    """Replace `tokens` by (chunk_id, tokens): runs of `size`, the last one shorter.

    Rows without tokens make no chunk, or with `outer` one row of nulls; that is said inside the expression, because a
    filter would be pushed below the tokens and split every text twice. Each document is
    cut where it lies, so a very long one costs no more than its own row.
    """
    others = [c for c in docs.columns if c != "tokens"]
    tokens = F.col("tokens")
    starts = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(size))
    runs = F.transform(starts, lambda start: F.slice(tokens, start + 1, size))
    exploded = F.posexplode_outer if outer else F.posexplode
    return docs.select(*others, exploded(F.when(F.size(tokens) > 0, runs)).alias("chunk_id", "tokens"))


def _label(stem: Column, chunk_id: Column) -> Column:
    return F.concat(stem, F.lit("_part_"), chunk_id.cast("string"))


def chunk_label(file_name: Column, chunk_id: Column) -> Column:
    return _label(file_stem(file_name), chunk_id)


def input_windows(tokens: Column, most: int = MAX_INPUT) -> Column:
    """What an encoder is given for a token list: runs between the two marks, of at most `most` tokens with them.

    Every token stands in one window and their order is that of the tokens; a list that fits is one window, an empty one
    or null has none.
    """
    room = most - 2
    starts = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(room))
    start, end = F.array(F.lit(START_MARK)), F.array(F.lit(END_MARK))
    windows = F.transform(starts, lambda at: F.concat(start, F.slice(tokens, at + 1, room), end))
    return F.when(F.size(tokens) > 0, windows)


def encoder_input(tokens: Column, most: int = MAX_INPUT) -> Column:
    """Tokens between the two marks; more than the longest input holds are window after window, each with its marks."""
    return F.flatten(input_windows(tokens, most))


def label_collisions(files: DataFrame) -> DataFrame:
    """Labels that chunks of several files(file_name, n_chunks) share, with their number.

    Chunk i of a stem is there once per file of more than i chunks, so files are counted
    by stem and length and no chunk is shuffled. A stem that most files share is one row
    per length and task.
    """
    stem = file_stem(F.col("file_name")).alias("stem")
    lengths = files.groupBy(stem, "n_chunks").agg(F.count("*").alias("files"))
    longest_first = Window.partitionBy("stem").orderBy(F.desc("n_chunks"))
    shorter = F.coalesce(F.lead("n_chunks").over(longest_first), F.lit(0))
    reach = lengths.select(
        "stem", "n_chunks", shorter.alias("shorter"), F.sum("files").over(longest_first).alias("n")
    )
    ids = F.explode(F.sequence(F.col("shorter"), F.col("n_chunks") - 1)).alias("chunk_id")
    shared = reach.where("n > 1 AND n_chunks > 0").select("stem", "n", ids)
    return shared.select(_label(F.col("stem"), F.col("chunk_id")).alias("label"), "n")
