"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file is read on the driver and broadcast (its size is checked), so executors need no copy
of it.  Each text is encoded whole: the split pattern cuts it into matches and every match is
merged on its own, exactly as the library does for the whole text.

Two things keep very long texts safe without changing a single id:

* A text is handed over in pieces that end between a visible character and the white space after it.
  No match of the pattern holds such a place inside, and the pattern looks at nothing to the left,
  so the pieces give the matches of the whole text.
* The look-ahead of ``\\s+(?!\\S)`` overflows the library's regex stack on huge runs of white space.
  Those runs are cut out by the pattern's own rule (all but the last character before a visible
  one, the whole run at the end of the text) and merged as the single match that they are.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows each get
their own result; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: Bytes that a rank file may have; it is broadcast.
MAX_RANK_BYTES = 64 << 20
#: Characters handed to the library at once, and the white-space run that is merged directly.
PIECE_CHARS = 1 << 18
LONG_RUN = 1 << 14

# White space of the split pattern (Unicode White_Space), which differs from Python's own \s.
_WS = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{_WS}]{{{LONG_RUN},}}")
_EDGE = re.compile(f"[^{_WS}][{_WS}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        blob = f.read(MAX_RANK_BYTES + 1)
    if len(blob) > MAX_RANK_BYTES:
        raise ValueError(f"rank file {path} is larger than {MAX_RANK_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


class Codec:
    """Encoder and decoder for one rank file under ``public_tokenizers.PATTERN``."""

    def __init__(self, ranks: dict[bytes, int]):
        self._enc = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is one match, piece) in order; the pieces joined are the text."""
        at = 0
        for run in _RUN.finditer(text):
            a, b = run.span()
            yield from ((False, p) for p in _cut(text, at, a))
            at = b if b == len(text) else b - 1
            yield True, text[a:at]
        yield from ((False, p) for p in _cut(text, at, len(text)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= LONG_RUN:
            return self._enc.encode_ordinary(text)
        ids: list[int] = []
        for whole, piece in self.pieces(text):
            ids += (self._enc._core_bpe.encode_single_piece(piece.encode()) if whole
                    else self._enc.encode_ordinary(piece))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of the ids, valid UTF-8 or not."""
        return self._enc.decode_bytes(ids)


def _cut(text: str, start: int, end: int) -> Iterator[str]:
    while end - start > PIECE_CHARS:
        m = _EDGE.search(text, start + PIECE_CHARS, end)
        if not m:
            break
        yield text[start:m.start() + 1]
        start = m.start() + 1
    if end > start:
        yield text[start:end]


def _codec(df: DataFrame, ranks_path: str | None):
    ranks = read_ranks(ranks_path or public_tokenizers.path(DEFAULT_RANKS))
    return df.sparkSession.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           ranks_path: str | None = None) -> DataFrame:
    """(``id_col``, ids array<int>) of every whole text."""
    ranks = _codec(docs, ranks_path)

    def make():
        codec = Codec(ranks.value)
        return lambda b: {"id": b.column(0), "ids": [codec.encode(t) for t in b.column(1).to_pylist()]}

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.select(id_col, text_col), make, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
           ranks_path: str | None = None) -> DataFrame:
    """(``id_col``, bytes binary) of every row of ids; null ids decode to no bytes."""
    ranks = _codec(tokens, ranks_path)

    def make():
        codec = Codec(ranks.value)
        return lambda b: {"id": b.column(0), "bytes": [codec.decode(x or []) for x in b.column(1).to_pylist()]}

    kind = tokens.schema[id_col].dataType.simpleString()
    out = map_rows(tokens.select(id_col, ids_col), make, f"id {kind}, bytes binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document: encoded, decoded and hashed in one
    narrow pass, without a shuffle and without carrying the ids out of the task."""
    ranks = _codec(docs, ranks_path)

    def make():
        codec = Codec(ranks.value)

        def f(b):
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": a, "decoded_sha256": d}
        return f

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(src, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
