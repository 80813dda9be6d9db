"""The whole way: texts to tokens, chunks, vectors, an index, and its nearest chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docvec.functions.text import base_name, tokens_of
from docvec.functions.vectors import HASH_DIMS
from docvec.operators.chunks import CHUNK_SIZE, chunk_tokens
from docvec.operators.encode import Encoder, encode_chunks, with_vectors
from docvec.operators.index import VectorIndex, build_index, open_index, save_index
from docvec.operators.search import self_query
from docvec.sources.files import Parser, extract_text, tokenize_files
from docvec.sources.folders import valid_file_refs, walk_folders
from docvec.sources.listing import MAX_ROW_BYTES, Lister, Opener, address, list_folder_at, list_tree, read_at, read_listed

# Fixed value: neighbours the closing self query shows.
SHOWN = 3


def chunk_vectors(
    documents: DataFrame,
    make_encoder: Callable[[], Encoder] | None = None,
    size: int = CHUNK_SIZE,
    dims: int = HASH_DIMS,
    tasks: int | None = None,
) -> DataFrame:
    """One vector per chunk of documents(doc_id, ..., text); other columns stay.

    No shuffle, unless `tasks` asks to deal the chunks out to a slow encoder.
    """
    others = [c for c in documents.columns if c != "text"]
    tokens = documents.select(*others, tokens_of(F.col("text")).alias("tokens"))
    return encode_chunks(chunk_tokens(tokens, size), make_encoder, dims=dims, tasks=tasks)


def index_documents(documents: DataFrame, make_encoder: Callable[[], Encoder] | None = None) -> VectorIndex:
    return build_index(chunk_vectors(documents, make_encoder))


def file_vectors(
    files: DataFrame,
    make_encoder: Callable[[], Encoder] | None = None,
    parsers: dict[str, Parser] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """doc_id (the path), file_name, chunk_id, embedding of every chunk of files(path, content)."""
    texts = extract_text(files.select("path", "content"), parsers)
    texts = texts.select(F.col("path").alias("doc_id"), "path", "text")
    return encode_chunks(chunk_tokens(tokenize_files(texts)), make_encoder, tasks=tasks)


# What can become of a file.
STATUSES = ["ok", "empty", "error", "unsupported", "no_parser", "too_large", "missing", "unreadable"]


@dataclass(frozen=True)
class FileRun:
    """What a run over files has stored: a row for each chunk, and one for each file that makes none."""

    rows: DataFrame
    totals: dict[str, int]

    @property
    def vectors(self) -> DataFrame:
        """doc_id, file_name, chunk_id, embedding of the chunks that have a vector."""
        return self.rows.where("embedding is not null").select("doc_id", "file_name", "chunk_id", "embedding")

    @property
    def file_status(self) -> DataFrame:
        """What became of each file: doc_id, file_name, size, status, tokens; of the stored table only these columns are read."""
        return self.rows.where("coalesce(chunk_id, 0) = 0").select("doc_id", "file_name", "size", "status", "n_tokens")

    @property
    def failed_chunks(self) -> DataFrame:
        return self.rows.where("chunk_id is not null and embedding is null").select("doc_id", "file_name", "chunk_id")

    def report(self) -> DataFrame:
        """One row: files by status, tokens, chunks, chunks that failed, vectors and their width (null without any)."""
        schema = ", ".join(f"{name} {'int' if name == 'dimension' else 'long'}" for name in self.totals)
        return self.rows.sparkSession.createDataFrame([tuple(self.totals.values())], schema)


def store_run(
    files: DataFrame,
    path: str,
    make_encoder: Callable[[], Encoder] | None = None,
    parsers: dict[str, Parser] | None = None,
    tasks: int | None = None,
) -> FileRun:
    """Text, tokens, chunks and vectors of files(path, content), written to `path` in one pass.

    The totals are observed in that pass, on the files before they become chunks and on the chunks, so no text is read
    twice. Columns file_name, size and problem are used where there are any; a problem is the status of its file.
    Only with `tasks`, which deals the chunks out, are files met in another stage than their chunks.
    """
    spark = files.sparkSession
    given = {c: F.col(c) for c in ("file_name", "size", "problem") if c in files.columns}
    rows = files.select("path", "content", *given.values())
    rows = rows.withColumns(
        {"file_name": given.get("file_name", base_name(F.col("path"))), "size": given.get("size", F.length("content")).cast("long")}
        | ({} if "problem" in given else {"problem": F.lit(None).cast("string")})
    )
    texts = extract_text(rows, parsers).withColumn("status", F.coalesce("problem", "status"))
    texts = texts.withColumn("tokens", F.when(F.col("text") != "", tokens_of(F.col("text"))))
    texts = texts.select(
        F.col("path").alias("doc_id"), "file_name", "size", "status",
        F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"), "tokens",
    )
    of_files, of_chunks = Observation(), Observation()
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    texts = texts.observe(of_files, F.count("*").alias("files"), *counts, F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    chunks = with_vectors(chunk_tokens(texts, outer=True), make_encoder, tasks=tasks, keep_empty=True)
    chunks = chunks.observe(
        of_chunks,
        F.count("chunk_id").alias("chunks"),
        F.count_if(F.col("chunk_id").isNotNull() & F.col("embedding").isNull()).alias("failed_chunks"),
        F.count("embedding").alias("vectors"),
        F.max(F.size("embedding")).alias("dimension"),
    )
    chunks.write.mode("overwrite").parquet(path)
    totals = {**of_files.get, **of_chunks.get}
    totals["dimension"] = totals["dimension"] if totals["vectors"] else None
    return FileRun(spark.read.schema(chunks.schema).parquet(path), totals)


def index_files(
    files: DataFrame,
    path: str,
    make_encoder: Callable[[], Encoder] | None = None,
    parsers: dict[str, Parser] | None = None,
    tasks: int | None = None,
) -> VectorIndex:
    """The full run over files(path, content): text, tokens, chunks, vectors, index.

    The rows of the run are kept under `path`/chunks and the index under `path`/index; a run
    replaces what an earlier one left there.
    """
    return _indexed(store_run(files, f"{path}/chunks", make_encoder, parsers, tasks), path)


def _indexed(run: FileRun, path: str) -> VectorIndex:
    spark = run.rows.sparkSession
    save_index(build_index(run.vectors, stored=True), f"{path}/index")
    return open_index(spark, f"{path}/index")


def tree_files(spark: SparkSession, root: str, lister: Lister = list_folder_at) -> DataFrame:
    """path, file_name, size of all files that a walk from `root` reaches and that have an id and a name."""
    items = list_tree(spark, root, lister)
    refs = valid_file_refs(walk_folders(items, address(root)))
    return items.join(refs.select("id"), "id", "left_semi").select(F.col("id").alias("path"), F.col("name").alias("file_name"), "size")


def store_tree(
    spark: SparkSession,
    root: str,
    path: str,
    make_encoder: Callable[[], Encoder] | None = None,
    parsers: dict[str, Parser] | None = None,
    lister: Lister = list_folder_at,
    opener: Opener = read_at,
    max_bytes: int = MAX_ROW_BYTES,
) -> FileRun:
    """From a folder to stored vectors: list it, walk it, read its files, make their vectors."""
    files = read_listed(tree_files(spark, root, lister), max_bytes, opener)
    return store_run(files, path, make_encoder, parsers)


def index_tree(
    spark: SparkSession,
    root: str,
    path: str,
    make_encoder: Callable[[], Encoder] | None = None,
    parsers: dict[str, Parser] | None = None,
) -> tuple[VectorIndex, FileRun]:
    """The full run from a folder to an index, and what became of its files; kept as by `index_files`.

    A tree without any vector makes no index: that is an error, as for `build_index`.
    """
    run = store_tree(spark, root, f"{path}/chunks", make_encoder, parsers)
    return _indexed(run, path), run


def document_search(
    documents: DataFrame, make_encoder: Callable[[], Encoder] | None = None, top_k: int = SHOWN
) -> DataFrame:
    """Index documents(doc_id, file_name, text) and show the chunks nearest to the first one."""
    index = index_documents(documents, make_encoder)
    return self_query(index, top_k, ["doc_id", "file_name", "chunk_id"])
