"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeframe.llm import bpe

from .odd_rows import ODD

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.table.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(own, other, text):
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 3001, "aaab" * 500, "the" * 700, "é" * 999, "abab" * 60, "q", "\n" * 77])
def test_long_pieces_by_both_queues(own, other, piece):
    raw = piece.encode()
    one = bpe.encode_piece(raw, own.table.byte_ids, own.table.pairs)
    many = bpe.encode_pieces([b"xyz", raw, b"hello"], own.table)
    assert one == np.frombuffer(many[1], "<u4").tolist()
    assert one == other._encode_single_piece(piece)


def test_pieces_do_not_touch(own):
    alone = [bpe.encode_pieces([p], own.table)[0] for p in (b"th", b"e", b"re")]
    assert bpe.encode_pieces([b"th", b"e", b"re"], own.table) == alone


def test_cache_may_be_forgotten(own):
    small = bpe.Codec(PATH, P.PATTERN, cache_entries=3)
    texts = ["some words that differ", "other words entirely", "some words again"]
    for t in texts * 2:
        assert small.encode(t) == own.encode(t)


def test_table(own, other, odd, none):
    rows = bpe.digests(odd, PATH, P.PATTERN).collect()
    assert len(rows) == len(ODD)
    want = sorted(((i, hashlib.sha256(np.array(other.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD), key=repr)
    assert sorted(((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in rows), key=repr) == want
    assert bpe.digests(none, PATH, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(odd, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in ODD)
