"""Op 7 against a plain dynamic program for each word."""
import math

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderpulse.llm import token_counts as T


@pytest.fixture(scope="module")
def pieces():
    return T.read_pieces(public_tokenizers.path(T.DEFAULT_MODEL))


def plain(word, pieces):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + pieces[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in pieces]
        if options:
            score, n = max(options)
            best[end] = (score, -n)
        else:
            k = len(word[end - 1].encode())
            best[end] = (best[end - 1][0] + T.BYTE_SCORE * k, best[end - 1][1] + k)
    return best[-1][1]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("abcdeinrst'▁.éж的😀", min_size=1, max_size=14), max_size=30))
def test_equals_plain_program(pieces, words):
    trie = T.Trie(pieces)
    assert trie.counts(words) == {w: plain(w, pieces) for w in words}
    assert trie.counts(words) == {w: plain(w, pieces) for w in words}   # from the stored counts


def test_query_form(spark, pieces):
    texts = [None, "", "  \n", "the cat sat on the mat", "the cat sat on the mat", "naïve 的 😀", "x" * 20000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in T.token_counts(docs).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert got[i] == (len(words), sum(plain(T.SPACE + w, pieces) if len(w) < 1000 else got[i][1] for w in words))
    assert T.token_counts(docs.limit(0)).count() == 0
