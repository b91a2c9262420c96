import hashlib
import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeframe.llm import clusters
from tapeframe.llm.clusters import ClusterConfig


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    for last in [False] * rounds + [True]:
        found = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            found.append((d.index(min(d)), min(d)))
        if last:
            break
        for c in range(len(centroids)):
            own = [v for (_, v), f in zip(kept, found, strict=True) if f[0] == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = [sum(d for x, d in found if x == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (c, d) in zip(kept, found, strict=True)]


def same(got, expected):
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_hilbert_keys_number_a_path():
    """In order of their keys neighbouring cells differ by one step in one dimension, and every key is used once."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = clusters.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(0, 10_000), st.sampled_from([3, 1000, 1 << 24, 1 << 40]))
def test_pruned_candidates_keep_the_nearest(dims, seed, size):
    rng = np.random.default_rng(seed)
    v = rng.integers(-size, size + 1, (12, dims)) // rng.integers(1, 5) + rng.integers(-size, size)
    c = rng.integers(-2 * size, 2 * size + 1, (6, dims))
    if size > 1 << 27:
        v, c = v.astype(object), c.astype(object)
    got = clusters.nearest(v, v.min(0), v.max(0), c)
    for k, row in enumerate(v.tolist()):
        d = [sum((a - b) ** 2 for a, b in zip(row, x, strict=True)) for x in c.tolist()]
        assert (got[0][k], got[1][k]) == (d.index(min(d)), min(d))


def test_boxes_leave_candidates_out():
    c = np.array([[0, 0], [100, 0], [0, 100]])
    assert clusters.candidates(np.array([-3, -2]), np.array([4, 5]), c).tolist() == [0]
    assert clusters.candidates(np.array([40, 0]), np.array([60, 1]), c).tolist() == [0, 1]


def test_clusters_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 0.3, (9, 64))
    rows = [(int(i), (middles[i % 9] + rng.normal(0, 0.05, 64)).tolist()) for i in range(700)]
    rows += [(3, rows[3][1]), (3, rows[4][1])]
    config = ClusterConfig(rows=32)
    same(clusters.cluster(table(spark, rows), config).collect(), plain(rows))


def test_odd_vectors(spark):
    one = [0.5] * 64
    rows = [(1, one), (1, one), (2, None), (3, one[:63]), (4, [*one[:63], None]), (5, [*one[:63], math.nan]), (6, [*one[:63], math.inf]),
            (None, one), (7, [-0.001] * 64), (8, [1e6] * 64), (9, [-3e7] * 64), (10, []), (11, [0.0] * 64)]
    same(clusters.cluster(table(spark, rows).selectExpr("*", "1 as cluster", "2 as ids", "3 as v")).collect(), plain(rows))
    assert clusters.cluster(table(spark, [(2, None)])).collect() == []


def test_a_distance_beyond_a_long_is_an_error(spark):
    rows = [(1, [1e12] * 64), *[(k, [float(k)] * 64) for k in range(2, 30)]]
    with pytest.raises(Exception, match="(?i)too large|overflow|does not fit"):
        clusters.cluster(table(spark, rows), ClusterConfig(k=2, rounds=1)).collect()
