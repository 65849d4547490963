"""Op 1 against the library on whole texts, exact round trips, and texts that the library cannot take."""
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from orderpulse.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path(bpe.DEFAULT_RANKS)))


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.DEFAULT_RANKS))
    return tiktoken.Encoding("lib", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from([*"ab Z'st\n\t\x1c1٣é的😀-_.\u00a0\u2003", "'re", "   ", "\r\n"]), max_size=60).map("".join))
def test_pieces_give_the_ids_of_the_whole(codec, library, text):
    was = bpe.PIECE_CHARS, bpe.LONG_RUN, bpe._RUN
    try:
        import re
        bpe.PIECE_CHARS, bpe.LONG_RUN, bpe._RUN = 5, 3, re.compile(f"[{bpe._WS}]{{3,}}")
        ids = codec.encode(text)
    finally:
        bpe.PIECE_CHARS, bpe.LONG_RUN, bpe._RUN = was
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["x" + " " * 1_200_000 + "y", "\n" * 1_100_000, "word " * 300_000, "ab" * 200_000])
def test_very_long(codec, text):
    assert codec.decode(codec.encode(text)) == text.encode()


def test_long_run_is_one_match(codec, library):
    run = " " * (bpe.LONG_RUN * 2)
    for text in (f"a{run}b", f"a{run}", f"{run}\nb", run):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_digests_and_codec_frames(spark, codec, library):
    texts = [None, "", "Hello  world's 12\n", "Hello  world's 12\n", "naïve 的 😀<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(struct.pack("<I", x) for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.digests(docs.limit(0)).count() == 0


def test_bytes_that_are_not_utf8(codec):
    assert codec.decode([codec._enc.encode_single_token(b"\xc3")]) == b"\xc3"
