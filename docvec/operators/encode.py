"""Vectors from chunks: a pluggable encoder, and feature hashing as the default."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.functions.vectors import HASH_DIMS, hashing_vector
from docvec.operators.chunks import MAX_INPUT, input_windows
from docvec.session import small_batches

# Fixed value: chunks per model call.
BATCH_SIZE = 32

Encoder = Callable[[list[list[str]]], np.ndarray]


def _encode_batch(encoder: Encoder, batch: list[list[str]]) -> list[np.ndarray | None]:
    """One vector per chunk. When a batch fails its chunks are tried alone, so only bad ones are lost."""
    try:
        vectors = np.asarray(encoder(batch), dtype=np.float32)
        if vectors.ndim != 2 or len(vectors) != len(batch):
            raise ValueError(f"{len(batch)} chunks gave vectors of shape {vectors.shape}")
        return list(vectors)
    except Exception:
        if len(batch) == 1:
            return [None]
        return [vector for chunk in batch for vector in _encode_batch(encoder, [chunk])]


def _encode_all(encoder: Encoder, chunks: list[list[str]], batch_size: int) -> list[np.ndarray | None]:
    """Vectors of filled chunks, so many to a call."""
    starts = range(0, len(chunks), batch_size)
    return [vector for start in starts for vector in _encode_batch(encoder, chunks[start : start + batch_size])]


_encoders: dict[str, Encoder] = {}


def _kept(key: str, make_encoder: Callable[[], Encoder]) -> Encoder:
    """The encoder of this worker process; the last one only, since models are large."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = make_encoder()
    return _encoders[key]


def encoded(make_encoder: Callable[[], Encoder], batch_size: int = BATCH_SIZE) -> Callable[[Column], Column]:
    """Column function tokens -> vector; null for an empty chunk or a failed one.

    `make_encoder` returns a function from a list of token lists to a matrix with one row each. It runs once
    per worker process, which Spark keeps for its next tasks.
    """
    key = uuid.uuid4().hex

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _kept(key, make_encoder)
        for tokens in batches:
            chunks = tokens.to_pylist()
            filled = [i for i, chunk in enumerate(chunks) if chunk]
            vectors: list[np.ndarray | None] = [None] * len(chunks)
            for i, vector in zip(filled, _encode_all(encoder, [chunks[i] for i in filled], batch_size), strict=True):
                vectors[i] = vector
            yield pa.array(vectors, type=pa.list_(pa.float32()))

    # So marked, a filter on the vector stays above it and no chunk is encoded twice.
    return encode.asNondeterministic()


_WINDOWED = "struct<embedding:array<float>,n_failed:int>"


def _joined(vectors: list[np.ndarray | None], sizes: list[int]) -> np.ndarray | None:
    """The mean of the windows' vectors by their tokens; none if a window has none, or there are several widths."""
    if not vectors or any(v is None for v in vectors) or len({len(v) for v in vectors}) > 1:
        return None
    return np.average(np.asarray(vectors, dtype=np.float64), axis=0, weights=sizes).astype(np.float32)


def _few_at_once(column: pa.Array, n_tokens: int) -> Iterator[list[list[list[str]]]]:
    """The windows of each row as Python lists, of rows with about so many tokens together, since these take many times the room of the column."""
    per_row = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = np.cumsum(pc.list_value_length(column.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)
    upto = np.concatenate(([0], tokens))[np.cumsum(per_row)] if len(per_row) else np.zeros(0, np.int64)
    begin = 0
    while begin < len(column):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + n_tokens, side="right")))
        yield [windows or [] for windows in column.slice(begin, end - begin).to_pylist()]
        begin = end


def _encoded_windows(make_encoder: Callable[[], Encoder], most: int, batch_size: int) -> Callable[[Column], Column]:
    """Column function marked windows -> vector of them all, and how many of them failed."""
    key = uuid.uuid4().hex

    @F.arrow_udf(_WINDOWED)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _kept(key, make_encoder)
        for column in batches:
            joined, failed = [], []
            for rows in _few_at_once(column, most * batch_size):
                vectors = iter(_encode_all(encoder, [w for windows in rows for w in windows], batch_size))
                of_rows = [[next(vectors) for _ in windows] for windows in rows]
                sizes = [[len(w) - 2 for w in windows] for windows in rows]  # without the marks
                joined += [_joined(v, n) for v, n in zip(of_rows, sizes, strict=True)]
                failed += [sum(v is None for v in some) for some in of_rows]
            yield pa.StructArray.from_arrays(
                [pa.array(joined, type=pa.list_(pa.float32())), pa.array(failed, type=pa.int32())], ["embedding", "n_failed"]
            )

    return encode.asNondeterministic()


def encode_windows(
    chunks: DataFrame,
    make_encoder: Callable[[], Encoder],
    most: int = MAX_INPUT,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Replace `tokens`, of any number, by n_windows, n_failed and embedding.

    The encoder gets marked windows of at most `most` tokens; the windows of a row are joined again where they lie, by
    the mean weighted by their tokens. A row of which a window failed has a null embedding and says how many; one without
    tokens has no windows. Nothing is cut off and nothing is shuffled.
    """
    small_batches(chunks.sparkSession)
    others = [c for c in chunks.columns if c != "tokens"]
    windows = input_windows(F.col("tokens"), most)
    made = chunks.withColumn("_windows", windows).withColumn("_made", _encoded_windows(make_encoder, most, batch_size)(F.col("_windows")))
    n_windows = F.greatest(F.coalesce(F.size("_windows"), F.lit(0)), F.lit(0)).alias("n_windows")
    return made.select(*others, n_windows, "_made.n_failed", "_made.embedding")


def with_vectors(
    chunks: DataFrame,
    make_encoder: Callable[[], Encoder] | None = None,
    batch_size: int = BATCH_SIZE,
    dims: int = HASH_DIMS,
    tasks: int | None = None,
    keep_empty: bool = False,
    marked: bool = False,
) -> DataFrame:
    """Replace `tokens` by `embedding`, null where the encoding failed.

    With `marked` the encoder gets its tokens between marks, in windows where they are too many for one input.

    Rows without tokens are dropped, or kept without a vector with `keep_empty`.

    Without an encoder the vector is signed feature hashing of the bare tokens: a
    lexical stand-in, not a language model. All chunks of a document start in the task
    that read it; for an encoder slower than a shuffle, `tasks` deals them out first.
    """
    small_batches(chunks.sparkSession)
    others = [c for c in chunks.columns if c != "tokens"]
    chunks = chunks if keep_empty else chunks.where(F.size("tokens") > 0)
    chunks = chunks.repartition(tasks) if tasks else chunks
    if marked and make_encoder is not None:
        return encode_windows(chunks, make_encoder, batch_size=batch_size).drop("n_windows", "n_failed")
    tokens = F.col("tokens")
    vector = hashing_vector(tokens, dims) if make_encoder is None else encoded(make_encoder, batch_size)(tokens)
    vector = F.when(F.size("tokens") > 0, vector) if keep_empty else vector
    return chunks.select(*others, vector.alias("embedding"))


def encode_chunks(
    chunks: DataFrame,
    make_encoder: Callable[[], Encoder] | None = None,
    batch_size: int = BATCH_SIZE,
    dims: int = HASH_DIMS,
    tasks: int | None = None,
    marked: bool = False,
) -> DataFrame:
    """`with_vectors` without the chunks whose encoding failed."""
    vectors = with_vectors(chunks, make_encoder, batch_size, dims, tasks, marked=marked)
    return vectors if make_encoder is None else vectors.where("embedding is not null")


def onnx_encoder(model_path: str, vocab_path: str, max_pieces: int = 512) -> Callable[[], Encoder]:
    """Encoder over an exported BERT-style model and its word-piece vocabulary.

    Both files must be readable on the executors. The vector is the last hidden state
    of the first piece. The chunk is given between its two marks and the tokenizer adds
    its own pair around that, as the whole-word input of such tokenizers does.
    """

    def make_encoder() -> Encoder:
        import onnxruntime
        from tokenizers import BertWordPieceTokenizer

        from docvec.operators.chunks import END_MARK, START_MARK

        pieces = BertWordPieceTokenizer(vocab_path, lowercase=True)
        pieces.enable_truncation(max_pieces)
        pieces.enable_padding(pad_id=pieces.token_to_id("[PAD]"))
        model = onnxruntime.InferenceSession(model_path, providers=onnxruntime.get_available_providers())
        names = [node.name for node in model.get_inputs()]

        def encode(batch: Sequence[Sequence[str]]) -> np.ndarray:
            marked = [[START_MARK, *chunk, END_MARK] for chunk in batch]
            encodings = pieces.encode_batch(marked, is_pretokenized=True)
            columns = {
                "input_ids": [e.ids for e in encodings],
                "attention_mask": [e.attention_mask for e in encodings],
                "token_type_ids": [e.type_ids for e in encodings],
            }
            feed = {name: np.asarray(columns[name], dtype=np.int64) for name in names}
            return model.run(None, feed)[0][:, 0, :]

        return encode

    return make_encoder
