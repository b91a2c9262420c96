import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeframe.llm import suffixes
from tapeframe.llm.suffixes import RepeatConfig

from .odd_rows import ODD

SMALL = RepeatConfig(length=12, gram=4, piece=64, bucket=8)


def plain(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept) with every string of every text in one table."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k + 1:k + 1 + length] = True
        own = gone[1:-1]
        out.append((i, len(t), int(own.sum()), int((np.diff(gone.astype(np.int8)) == 1).sum()), bytes(b for b, g in zip(t, own, strict=True) if not g)))
    return out


def same(got, expected):
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)


def rows_of(docs, config):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(docs, config).collect()]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=200).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5), st.integers(5, 80))
def test_every_string_has_one_sampled_position(texts, piece):
    config = RepeatConfig(length=12, gram=4, piece=piece)
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, place, first, last, _ = suffixes.sampled(raw, at, config)
    offsets, covered = {}, []
    for t, p, a, b in zip(text, place, first, last, strict=True):
        for i in range(a, b + 1):
            assert at[t] <= i and i + config.length <= at[t + 1] and i <= p <= i + config.reach
            assert offsets.setdefault(raw[i:i + 12].tobytes(), p - i) == p - i
            covered.append(i)
    starts = [int(at[k]) + i for k, t in enumerate(texts) for i in range(len(t) - 11)]
    assert covered == starts and len(set(place.tolist())) == len(place)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=8), st.binary(min_size=4, max_size=12)), min_size=1, max_size=12), st.integers(1, 3))
def test_pairs_of_names_are_strings(parts, letters):
    """Sorted prefixes name strings exactly, zero bytes and clipped ends included."""
    parts = [(bytes(x % letters for x in a), bytes(x % letters for x in b)) for a, b in parts]
    left = suffixes._matrix([a[::-1] for a, _ in parts], 8)
    right = suffixes._matrix([b for _, b in parts], 12)
    a, b = np.array([len(x) for x, _ in parts]), np.array([len(x) for _, x in parts])
    least, back = np.maximum(0, 12 - b), a
    got = suffixes.repeated_starts(left, a, right, b, least, back, 12)
    strings = {(k, d): x[len(x) - d:] + y[:12 - d] for k, (x, y) in enumerate(parts) for d in range(least[k], back[k] + 1)}
    seen = Counter((d, s) for (_, d), s in strings.items())
    for (k, d), s in strings.items():
        assert got[k, d] == (seen[d, s] > 1)


def random_rows(seed):
    """Texts over few letters, with copies, shared passages at other places, one passage in a third of all texts, and periods."""
    rng = np.random.default_rng(seed)
    word = lambda n, letters="abcdefghij": "".join(rng.choice(list(letters), n))
    shared, hot = [word(int(rng.integers(8, 40))) for _ in range(6)], word(14)
    rows = []
    for i in range(90):
        kind = i % 6
        body = word(int(rng.integers(0, 60)))
        if kind == 1:
            body = word(5) + hot + word(5)
        elif kind == 2:
            body = word(3) + shared[i % len(shared)] + word(4) + shared[(i + 1) % len(shared)]
        elif kind == 3:
            body = rows[int(rng.integers(len(rows)))][1]
        elif kind == 4:
            body = word(3) + word(2) * int(rng.integers(0, 20))
        elif kind == 5:
            body = "é漢\x00" * int(rng.integers(0, 7)) + word(9)
        rows.append((i, body))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_removed_are_the_plain_ones(docs_of, seed):
    rows = random_rows(seed)
    same(rows_of(docs_of(rows), SMALL), plain(rows, SMALL.length))


def test_small_table_against_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 200)
    got = suffixes.digest(docs).collect()
    same(got, [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in expected])
    assert sum(r.n_removed for r in got) > 0


def test_odd_rows_and_empty_table(odd, none):
    own = [(i, t) for i, t in ODD if t is None or len(t) < 10_000]
    short = odd.where("text is null or length(text) < 10000")
    same(rows_of(short, RepeatConfig()), plain(own, 200))
    assert {(r[1], r[2]) for r in rows_of(odd, RepeatConfig()) if r[0] == 6} == {(500_000, 500_000)}
    assert rows_of(none, RepeatConfig()) == []


def test_piece_seams_do_not_change_names():
    raw = np.frombuffer(("abc" * 50 + "xyz" * 70).encode(), np.uint8)
    at = np.array([0, 150, len(raw)])
    whole = suffixes.sampled(raw, at, RepeatConfig(length=20, gram=5))
    for piece in (1, 7, 64):
        for a, b in zip(whole, suffixes.sampled(raw, at, RepeatConfig(length=20, gram=5, piece=piece)), strict=True):
            assert (a == b).all()
