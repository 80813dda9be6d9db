"""Files in bulk: bytes, route by extension, text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvec.functions.text import base_name, tokens_of
from docvec.session import small_batches
from docvec.sources.parsers import PARSERS, pdf_parser

# Extensions with a reader, matched with case; .ppt goes to the .pptx reader.
ROUTES = {
    ".pdf": "pdf",
    ".docx": "docx",
    ".txt": "txt",
    ".xlsx": "xlsx",
    ".pptx": "pptx",
    ".ppt": "pptx",
}

Parser = Callable[[bytes], Iterable[str]]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a path: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def route_of(path: Column) -> Column:
    route = F.lit("unsupported")
    for extension, name in ROUTES.items():
        route = F.when(F.endswith(path, F.lit(extension)), name).otherwise(route)
    return route


def _txt_text(content: Column) -> Column:
    """Strict UTF-8 with every line end as a newline; null when a byte is wrong."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "\r\n?", "\n")


def _read_one(parse: Parser | None, content: bytes | None) -> tuple[str, str]:
    """Text of one file; what came before an error is kept."""
    if parse is None:
        return "", "no_parser"
    pieces: list[str] = []
    try:
        for piece in parse(content):
            pieces.append(piece)
        status = "ok"
    except Exception:
        status = "error"
    text = "".join(pieces)
    return text, "empty" if status == "ok" and not text else status


def _parsed(extra: dict[str, Parser]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("text string, status string")
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        parsers = {"pdf": pdf_parser(), **PARSERS, **extra}
        for routes, contents in batches:
            # A null route is a file that needs no parser; its bytes stay in the JVM.
            rows = [
                (None, None) if route is None else _read_one(parsers.get(route), content)
                for route, content in zip(routes, contents)
            ]
            yield pd.DataFrame(rows, columns=["text", "status"])

    # So marked, a filter on the text stays above it and no file is parsed twice.
    return parsed.asNondeterministic()


def extract_text(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Add route, text and status to (path, content) rows in one pass, without a shuffle.

    status: ok, empty, error, unsupported or no_parser. A file never fails the job.
    `parsers` maps a route to a function from bytes to pieces of text.
    """
    small_batches(files.sparkSession)
    to_parse = ~F.col("route").isin("txt", "unsupported")
    routed = files.withColumn("route", route_of(F.col("path")))
    routed = routed.withColumn(
        "_parsed",
        _parsed(parsers or {})(F.when(to_parse, F.col("route")), F.when(to_parse, F.col("content"))),
    )
    routed = routed.withColumn("_txt", F.when(F.col("route") == "txt", _txt_text(F.col("content"))))
    txt_status = (
        F.when(F.col("_txt").isNull(), "error").when(F.col("_txt") == "", "empty").otherwise("ok")
    )
    text = F.when(to_parse, F.col("_parsed.text")).otherwise(F.col("_txt"))
    status = (
        F.when(F.col("route") == "unsupported", "unsupported")
        .when(F.col("route") == "txt", txt_status)
        .otherwise(F.col("_parsed.status"))
    )
    kept = [c for c in files.columns if c != "content"]
    return routed.select(
        *kept, "route", F.coalesce(text, F.lit("")).alias("text"), status.alias("status")
    )


def nonempty_text(texts: DataFrame) -> DataFrame:
    return texts.where("text <> ''")


def tokenize_files(texts: DataFrame) -> DataFrame:
    """File name and tokens per (path, text); tokens are null where there is no text."""
    text = F.col("text")
    return (
        texts.withColumn("file_name", base_name(F.col("path")))
        .withColumn("tokens", F.when(text != "", tokens_of(text)))
        .drop("path", "text")
    )
