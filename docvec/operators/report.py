"""What a run did: per file and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvec.operators.chunks import CHUNK_SIZE, chunk_count


def file_stats(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Tokens and chunks of every file; a file is one row, so nothing has to be grouped."""
    n_tokens = F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)).cast("long")
    return docs.select(
        "doc_id", n_tokens.alias("n_tokens"), chunk_count(F.col("tokens"), size).alias("n_chunks")
    )


def run_report(files: DataFrame, encoded: DataFrame) -> DataFrame:
    """One row: files, files skipped, tokens, chunks, vectors and their width.

    `files` is the listing, of which only the rows are counted; `encoded` holds chunk_id,
    n_tokens and embedding (null where encoding failed) of every chunk. The texts are
    gone through once.
    """
    listed = files.agg(F.count("*").alias("files")).scalar()
    made = encoded.agg(
        F.count_if(F.col("chunk_id") == 0).alias("filled"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
        F.count("*").alias("chunks"),
        F.count("embedding").alias("vectors"),
        F.max(F.size("embedding")).alias("dimension"),
    ).withColumn("files", listed)
    skipped = (F.col("files") - F.col("filled")).alias("skipped")
    return made.select("files", skipped, "tokens", "chunks", "vectors", "dimension")
