"""Inputs the registered queries derive from the given tables, row for row."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from docvec.functions.text import tokens_of
from docvec.operators.chunks import chunk_tokens
from docvec.operators.index import VectorIndex
from docvec.plans.document_search import chunk_vectors
from docvec.session import small_batches, spread
from docvec.sources.folders import FOLDER_MIME_TYPE

EXTENSIONS = [".txt", ".pdf", ".docx", ".xlsx", ".pptx", ".ppt", ".PDF", ".csv"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tokens_of(F.col("text")).alias("tokens"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_tokens(document_tokens(spark, sf_dir))


def document_vectors(spark: SparkSession, sf_dir: str, of: Column | None = None) -> DataFrame:
    """Vectors of the chunks of all documents, or of some, whose ids are told before their texts are encoded."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return chunk_vectors(docs if of is None else docs.where(of))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder listing: root, a folder per language, one per language and source, a file per document."""
    docs = table(spark, sf_dir, "documents")
    lang_id = F.concat(F.lit("f:"), "lang")
    source_id = F.concat(F.lit("f:"), "lang", F.lit("/"), "source")
    folder = F.lit(FOLDER_MIME_TYPE).alias("mime_type")
    langs = docs.select("lang").distinct()
    langs = langs.select(lang_id.alias("id"), F.col("lang").alias("name"), folder, F.lit("root").alias("parent_id"))
    sources = docs.select("lang", "source").distinct()
    sources = sources.select(
        source_id.alias("id"), F.col("source").alias("name"), folder, lang_id.alias("parent_id")
    )
    files = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("name"),
        F.lit("text/plain").alias("mime_type"),
        source_id.alias("parent_id"),
    )
    return langs.unionByName(sources).unionByName(files)


def file_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference per document; documents without a label have no id."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    names = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("_"), "doc_id").alias("name"))
    return names.join(labels, "doc_id", "left").select("id", "name")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once per extension."""
    extension = F.explode(F.array(*[F.lit(e) for e in EXTENSIONS])).alias("extension")
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text", extension)
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), "doc_id", "extension")
    return docs.select(path.alias("path"), "extension", "text")


# --- office files around a text ---------------------------------------------------

_OFFICE = "http://schemas.openxmlformats.org"
_RELATIONS = f"{_OFFICE}/officeDocument/2006/relationships"


def _package(main: str, parts: dict[str, str]) -> bytes:
    """A zip package with a main part and the parts it points to."""

    def relations(targets: dict[str, tuple[str, str]]) -> str:
        rows = "".join(
            f'<Relationship Id="{key}" Type="{_RELATIONS}/{kind}" Target="{target}"/>'
            for key, (kind, target) in targets.items()
        )
        return f'<Relationships xmlns="{_OFFICE}/package/2006/relationships">{rows}</Relationships>'

    folder, name = main.split("/")
    linked = {
        f"r{i}": ("worksheet" if folder == "xl" else "slide", part.split("/", 1)[1])
        for i, part in enumerate(p for p in parts if p != main)
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("_rels/.rels", relations({"r0": ("officeDocument", main)}))
        package.writestr(f"{folder}/_rels/{name}.rels", relations(linked))
        for part, xml in parts.items():
            package.writestr(part, xml)
    return out.getvalue()


def docx_bytes(paragraphs: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    xml = f'<w:document xmlns:w="{_OFFICE}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    return _package("word/document.xml", {"word/document.xml": xml})


def xlsx_bytes(rows: list[str]) -> bytes:
    cells = "".join(f'<row><c t="inlineStr"><is><t>{escape(r)}</t></is></c></row>' for r in rows)
    spreadsheet = f"{_OFFICE}/spreadsheetml/2006/main"
    book = (
        f'<workbook xmlns="{spreadsheet}" xmlns:r="{_RELATIONS}">'
        '<sheets><sheet name="s" sheetId="1" r:id="r0"/></sheets></workbook>'
    )
    sheet = f'<worksheet xmlns="{spreadsheet}"><sheetData>{cells}</sheetData></worksheet>'
    return _package("xl/workbook.xml", {"xl/workbook.xml": book, "xl/worksheets/s.xml": sheet})


def pptx_bytes(shapes: list[str]) -> bytes:
    drawn = "".join(
        f"<p:sp><p:txBody><a:p><a:r><a:t>{escape(s)}</a:t></a:r></a:p></p:txBody></p:sp>" for s in shapes
    )
    spaces = (
        f'xmlns:p="{_OFFICE}/presentationml/2006/main" xmlns:a="{_OFFICE}/drawingml/2006/main" '
        f'xmlns:r="{_RELATIONS}"'
    )
    deck = f'<p:presentation {spaces}><p:sldIdLst><p:sldId id="256" r:id="r0"/></p:sldIdLst></p:presentation>'
    slide = f"<p:sld {spaces}><p:cSld><p:spTree>{drawn}</p:spTree></p:cSld></p:sld>"
    return _package("ppt/presentation.xml", {"ppt/presentation.xml": deck, "ppt/slides/s.xml": slide})


def _file_bytes(extension: str, text: str) -> bytes:
    """The text as a file of its kind: a line is a paragraph, a row or a shape."""
    writers = {".docx": docx_bytes, ".xlsx": xlsx_bytes, ".pptx": pptx_bytes}
    if extension in writers:
        return writers[extension](text.split("\n"))
    return text.encode()


@F.pandas_udf(BinaryType())
def _packed(extension: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([_file_bytes(e, t) for e, t in zip(extension, text)], dtype=object)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of every document in every format."""
    small_batches(spark)
    content: Column = _packed("extension", "text")
    return paths(spark, sf_dir).select("path", content.alias("content"))


def write_tree(spark: SparkSession, sf_dir: str, root: str) -> None:
    """A file for every document, of the format its id says, written under its language and source by the tasks."""
    small_batches(spark)
    extension = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    docs = documents(spark, sf_dir).withColumn("extension", extension)
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), "doc_id", "extension")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        for batch in batches:
            for name, content in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                fs.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(content)
            yield batch.select([0])

    rows = docs.select(path.alias("path"), _packed("extension", "text").alias("content"))
    rows.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


# --- vectors ----------------------------------------------------------------------


def embedding_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The given vectors, which bring their positions, as an index.

    The first one gives the width; a scan fails on any other.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    width = vectors.select(F.size("embedding")).first()[0]
    return VectorIndex(spread(vectors), width, vectors.count())


def embedding_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query per chunk of every benchmark text; query_id holds the item above 32 bits and the chunk in them."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    query_id = (F.shiftleft("doc_id", 32) + F.col("chunk_id")).alias("query_id")
    return chunk_vectors(items).select(query_id, "embedding")
