"""Files as they land: each one goes through the same operators once, into the vector table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docvec.operators.encode import Encoder
from docvec.operators.index import append_to_saved, build_index, open_index, save_index
from docvec.plans.document_search import file_vectors
from docvec.scratch import staged
from docvec.sources.files import Parser

_FILE = "path string, modificationTime timestamp, length long, content binary"


def landing_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the files under a path, new ones as they come."""
    reader = spark.readStream.format("binaryFile").schema(_FILE)
    return reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)


def ingest(
    files: DataFrame,
    table: str,
    checkpoint: str,
    make_encoder: Callable[[], Encoder] | None = None,
    parsers: dict[str, Parser] | None = None,
) -> StreamingQuery:
    """Write the vectors of all files that have landed and were not yet read, then stop.

    The file source remembers what it read and the Parquet sink what it committed, so a
    run that is lost and started again stores every chunk once. Build an index from the
    table with `build_index(read_vectors(...), stored=True)`.
    """
    writer = file_vectors(files, make_encoder, parsers).writeStream.format("parquet")
    writer = writer.option("path", table).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def ingest_into_index(
    files: DataFrame,
    path: str,
    checkpoint: str,
    make_encoder: Callable[[], Encoder] | None = None,
    parsers: dict[str, Parser] | None = None,
) -> StreamingQuery:
    """Put the vectors of all files that have landed into the index stored at `path`, then stop.

    The first batch makes the index. A batch that is run again after a loss adds nothing,
    since keys already indexed are left out.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        with staged(batch, "batch") as table:
            try:
                open_index(spark, path)
            except RuntimeError:
                if not table.isEmpty():
                    save_index(build_index(table, stored=True), path)
            else:
                append_to_saved(spark, table, path, stored=True)

    writer = file_vectors(files, make_encoder, parsers).writeStream.foreachBatch(add)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
