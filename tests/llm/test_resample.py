import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeframe.llm import resample

from .odd_rows import ODD

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = WORD.findall((text or "").translate(UPPER))
    return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]], len(w)


def plain(docs, target, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank) by the definition, one text at a time."""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in plain_features(x)[0]:
                counts[b] += 1
    rows = []
    for doc_id, text in docs:
        own, words = plain_features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in own]
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def order(r):
    return tuple((x is not None, x or 0) for x in r)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB09 .\n\x00é漢😀", max_size=60), min_size=1, max_size=6), st.integers(1, 4))
def test_features_are_those_of_each_text_alone(texts, n):
    owner, bucket, words = resample.features([t.translate(UPPER).encode() for t in texts], resample.ResampleConfig(n=n))
    expected = []
    for k, t in enumerate(texts):
        w = WORD.findall(t.translate(UPPER))
        assert words[k] == len(w)
        expected += [(k, zlib.crc32(" ".join(w[i:i + size]).encode()) % 10_000) for size in range(1, n + 1) for i in range(len(w) - size + 1)]
    assert sorted(zip(owner.tolist(), bucket.tolist(), strict=True)) == sorted(expected)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=20), st.binary(max_size=300))
def test_checksums_are_put_together(a, b):
    got = resample.append_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert got[0] == zlib.crc32(a + b)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "river stone and river moss"), (2, None), (3, "")], "item_id long, text string")


def test_draw_is_the_plain_draw(spark, docs_of, target):
    rng = np.random.default_rng(3)
    words = ["river", "stone", "moss", "cloud", "Sand", "été", "x1", "tree"]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(5, 60))))) for k in range(200)] + [(5, "cloud " * 30), (5, "cloud " * 30), (None, "moss " * 25)]
    got = resample.resample(docs_of(rows), target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=order) == sorted(plain(rows, ["river stone and river moss"]), key=order)


def test_odd_rows_and_empty_tables(odd, none, target, spark):
    got = resample.resample(odd, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=order) == sorted(plain(ODD, ["river stone and river moss"]), key=order)
    assert resample.resample(none, target).collect() == []
    no_target = resample.resample(odd, target.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, no_target), key=order) == sorted(plain(ODD, []), key=order)
