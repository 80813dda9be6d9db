"""Byte-pair encoding and decoding by forced boundaries.

Two neighbouring bytes that stand side by side in no token of the vocabulary are never joined by any merge, so
there is a certain cut between them. A piece of text is cut there first, and its fragments, which repeat more
than whole pieces do, are encoded each on its own; the ids of a piece are theirs, one after the other.

Edge cases: null and empty texts have no ids and decode to the empty text. The strings of special tokens are
found in a text and get their ids, as the library does it. Pieces of any length are merged with a heap, in
n log n steps. Other columns are not looked at, an empty table gives no rows, repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import bounded_batches, strings, whole

END = "</w>"  # fixed value: the mark of a word's last byte in the vocabulary
LATIN = 0x300  # below it no character joins with another one when composed
KEPT_PIECES = 300_000
FIELDS = "n_tokens long, ids string, decoded string"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it is printable in Latin-1, else the next free letter from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _latin_pattern() -> re.Pattern:
    kinds = {chr(c): unicodedata.category(chr(c))[0] for c in range(LATIN)}
    blank = "\t\n\x0b\x0c\r \x85\xa0"
    letters = re.escape("".join(c for c, k in kinds.items() if k == "L"))
    digits = re.escape("".join(c for c, k in kinds.items() if k == "N"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{re.escape(blank)}{letters}{digits}]+")


class ForcedBoundaryEncoder:
    """Encodes with a vocabulary and its merges, from a tokenizer file with byte letters and word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.inside = {t[i : i + 2] for t in map(self._without_end, self.ids) for i in range(len(t) - 1)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pattern = _latin_pattern()
        self.beyond_latin = re.compile(f"[{chr(LATIN)}-\U0010ffff]")
        self.library = None
        self.fragments: dict[tuple[str, bool], list[str]] = {}
        self.piece_ids: dict[str, str] = {}
        self.piece_text: dict[str, str] = {}

    @staticmethod
    def _without_end(token: str) -> str:
        return token.removesuffix(END)

    def cut(self, letters: str) -> list[str]:
        """The fragments of a piece between its certain cuts."""
        inside, out, begin = self.inside, [], 0
        for i in range(1, len(letters)):
            if letters[i - 1 : i + 1] not in inside:
                out.append(letters[begin:i])
                begin = i
        out.append(letters[begin:])
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Join the pair of the lowest rank, of equal ones the leftmost, as long as there is one."""
        rank, n = self.rank, len(symbols)
        if n < 2:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        live: list[str | None] = list(symbols)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j >= n or live[j] != b:
                continue
            live[i], live[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((a + b, live[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, live[k]))
            if (p := before[i]) >= 0 and (r := rank.get((live[p], a + b))) is not None:
                heapq.heappush(heap, (r, p, live[p], a + b))
        return [s for s in live if s is not None]

    def fragment(self, letters: str, last: bool) -> list[str]:
        found = self.fragments.get((letters, last))
        if found is None:
            symbols = list(letters)
            if last:
                symbols[-1] += END
            found = self.merge(symbols)
            if len(letters) <= 40:
                if len(self.fragments) >= KEPT_PIECES:
                    self.fragments.clear()
                self.fragments[(letters, last)] = found
        return found

    def piece_tokens(self, piece: str) -> list[str]:
        table = self.letters
        letters = piece if piece.isascii() and piece.isalnum() else "".join([table[b] for b in piece.encode("utf-8", "replace")])
        parts = self.cut(letters)
        tokens: list[str] = []
        for part in parts[:-1]:
            tokens += self.fragment(part, False)
        return tokens + self.fragment(parts[-1], True)

    def pieces(self, text: str) -> list[str]:
        """Cut a text without special tokens into lower-case pieces, as the file's normalizer and splitter do."""
        if not self.beyond_latin.search(text):
            return self.pattern.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        plain = self.library.normalizer.normalize_str(text)
        cuts = self.library.pre_tokenizer.pre_tokenize_str(plain)
        return [bytes(self.bytes_of[c] for c in p).decode("utf-8", "replace") for p, _ in cuts]

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, their ids joined by a space, and the text they decode to."""
        if "<|" in text and self.special_pattern.search(text):
            done = [
                (1, str(self.special[part]), part) if part in self.special else self.encode(part)
                for part in self.special_pattern.split(text)
            ]
            done = [x for x in done if x[0]]
            return sum(x[0] for x in done), " ".join(x[1] for x in done), " ".join(x[2] for x in done)
        pieces = self.pieces(text)
        if not pieces:
            return 0, "", ""
        ids, texts = self.piece_ids, self.piece_text
        if len(ids) >= KEPT_PIECES:
            ids.clear()
            texts.clear()
        long = []
        for p in set(pieces).difference(ids):
            tokens = self.piece_tokens(p)
            ids[p] = " ".join([str(self.ids[t]) for t in tokens])
            texts[p] = " ".join(tokens)
            if len(p) > 40:
                long.append(p)
        joined = " ".join(map(ids.__getitem__, pieces))
        decoded = " ".join(map(texts.__getitem__, pieces))
        for p in long:
            del ids[p], texts[p]
        return joined.count(" ") + 1, joined, decoded


_encoders: dict[str, ForcedBoundaryEncoder] = {}


def encoder(path: str) -> ForcedBoundaryEncoder:
    """The encoder of a file, made once per worker process."""
    if path not in _encoders:
        _encoders[path] = ForcedBoundaryEncoder(path)
    return _encoders[path]


def encoded(text: Column, path: str) -> Column:
    """Struct of n_tokens, ids (joined by a space) and decoded for a text column."""

    @F.arrow_udf(FIELDS)
    def encode(column: pa.Array) -> pa.Array:
        run = encoder(path).encode
        n, ids, decoded = zip(*[run(t) for t in strings(column)], strict=True) if len(column) else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids", "decoded"]
        )

    return encode(text)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of tokens and the hashes of its ids and of the decoded text.

    The hashes are made beside the encoder, so that ids and decoded texts do not travel.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(column: pa.Array) -> pa.Array:
        run, out = encoder(path).encode, ([], [], [])
        for t in strings(column):
            n, ids, decoded = run(t)
            out[0].append(n)
            out[1].append(hashlib.sha256(ids.encode()).hexdigest())
            out[2].append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(whole(text_col)).alias("r"))
    return rows.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
