"""Token counts of whole texts under a unigram model, by dynamic programming over a trie.

Texts are split at white space; each word starts with the mark that the vocabulary uses for a
space.  A word's segmentation is the one with the highest sum of piece scores.  The distinct words
of a slice form a trie, and the forward score of a node (the best segmentation of the prefix it
stands for) is computed once, so words share the work of their common prefixes.  A word's token
count is that of its last node and is stored; a text's count is the sum over its words.

Piece scores are log probabilities of a Zipf law over the vocabulary's ranks.  A character that no
piece covers costs one token for each of its UTF-8 bytes, as byte fallback does.

The vocabulary is read on the driver and broadcast (its size is checked).  A task keeps the counts of
words it has seen and starts anew at ``MAX_TERMINALS``; that changes the time, never a count.

Defined results: a null or empty text, or one of white space only, has 0 tokens and words; repeated
rows each get their own count; ties between segmentations go to fewer tokens, so they never depend on
order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

DEFAULT_MODEL = "piece_bpe_32k.model"
#: Pieces that a vocabulary may have; it is broadcast.
MAX_PIECES = 1_000_000
MAX_TERMINALS = 500_000
SPACE = "▁"  # fixed value: the mark of a space in sentencepiece vocabularies
#: Score of a byte of a character that no piece covers, below any piece.
BYTE_SCORE = -20.0


def read_pieces(path: str) -> dict[str, float]:
    """Score of each ordinary piece."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"{path} has more than {MAX_PIECES} pieces")
    plain = [sp.id_to_piece(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    norm = math.log(sum(1 / (r + 2) for r in range(len(plain))))
    return {p: -math.log(r + 2) - norm for r, p in enumerate(plain)}


class Trie:
    """Token counts of words.

    Sorted distinct words are the leaves of a trie in depth-first order, so the trie needs no
    storage of its own: the walk holds the nodes of the current path, enters each node of the
    trie once, and computes its forward score from its parent's on entering."""

    def __init__(self, pieces: dict[str, float]):
        # the pieces' own trie: state * 2 ** 21 + code point -> state, and the score of a state that is a piece
        self.step: dict[int, int] = {}
        self.score: list[float | None] = [None]
        for p, score in pieces.items():
            state = 0
            for c in p:
                at = state << 21 | ord(c)
                state = self.step.setdefault(at, len(self.score))
                if state == len(self.score):
                    self.score.append(None)
            self.score[state] = score
        self.terminal: dict[str, int] = {}

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Token count of each word."""
        if len(self.terminal) > MAX_TERMINALS:
            self.terminal = {}
        terminal, step, piece_score = self.terminal, self.step.get, self.score
        words = list(words)
        path = [(0.0, 0, ())]   # of each prefix: best score, its tokens, pieces that may still end later
        before = ""
        for w in sorted(w for w in words if w not in terminal):
            shared, most = 0, min(len(before), len(w))
            while shared < most and before[shared] == w[shared]:
                shared += 1
            del path[shared + 1:]
            best, tokens, alive = path[-1]
            for c in w[shared:]:
                code = ord(c)
                top, fewest, grown = -math.inf, 0, []
                for state, score, n in (*alive, (0, best, tokens)):
                    state = step(state << 21 | code)
                    if state is not None:
                        grown.append((state, score, n))
                        own = piece_score[state]
                        if own is not None:
                            own += score
                            if own > top or own == top and n < fewest - 1:
                                top, fewest = own, n + 1
                if not fewest:
                    size = len(c.encode("utf-8", "surrogatepass"))
                    top, fewest = best + BYTE_SCORE * size, tokens + size
                best, tokens, alive = top, fewest, grown
                path.append((best, tokens, alive))
            terminal[w] = tokens
            before = w
        return {w: terminal[w] for w in words}


def token_counts(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, n_tokens) of every whole text."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path or public_tokenizers.path(DEFAULT_MODEL)))

    def make():
        trie = Trie(pieces.value)

        def f(b: pa.RecordBatch) -> dict:
            split = [t.split() if t else [] for t in b.column(1).to_pylist()]
            words = set().union(*split)
            get = dict(zip(words, trie.counts(SPACE + w for w in words).values())).__getitem__
            return {"id": b.column(0), "n_words": [len(w) for w in split], "n_tokens": [sum(map(get, w)) for w in split]}
        return f

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.select(id_col, F.col(text_col).cast("string").alias("text")), make, f"id {kind}, n_words long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
