"""Bit-sliced search against plain sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeframe.llm.bitslice import Cell, SearchConfig, add, at_least, kth_largest, top_k


def plain(ids, vectors, query, own, k):
    s = [(int(v @ query), int(i)) for i, v in zip(ids, vectors, strict=True) if i != own]
    return sorted(s, key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("n,dims,high,slices", [(1, 3, 9, 6), (5, 4, 1, 6), (64, 2, 1000, 3), (777, 16, 2, 2), (1500, 8, 100_000, 6), (200, 0, 1, 6)])
def test_cell(n, dims, high, slices):
    random = np.random.default_rng(n)
    vectors = random.integers(-high, high + 1, (n, dims))
    ids = random.permutation(n) * 3
    cell = Cell(ids, vectors, SearchConfig(slices=slices))
    for q in range(0, n, max(1, n // 7)):
        assert [(s, int(ids[i])) for s, i in cell.search(vectors[q], ids[q])] == plain(ids, vectors, vectors[q], ids[q], 10)


def test_slices_add_and_select():
    random = np.random.default_rng(1)
    values, total = np.zeros(128, np.int64), []
    for at in (0, 3, 1, 9, 0):
        x = random.integers(0, 16, 128)
        part = np.stack([np.packbits((x >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(4)])
        add(total, part, at)
        values += x << at
    alive = np.full(2, ~np.uint64(0))
    for k in (1, 5, 128):
        assert kth_largest(total, alive, k) == sorted(values)[-k]
    assert kth_largest(total, alive, 129) == 0
    for bound in (-1, 0, 1, int(values.max()), int(values.max()) + 1, 1 << 40):
        got = np.unpackbits(at_least(total, alive, bound).view(np.uint8), bitorder="little").astype(bool)
        assert (got == (values >= bound)).all()


def plain_table(rows, k=10):
    """(query id, rank, id, score) with every row its own, by Python integers."""
    clean = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(clean):
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, (j, w) in enumerate(clean) if m != n and len(w) == len(v))
            out += [(i, rank + 1, j, -x) for rank, (x, j) in enumerate(s[:k])]
    return sorted(out)


def test_table(spark):
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=6).round(2).tolist()) for i in range(230)]
    rows += [(300 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(400, None), (500, [1.0, None] * 3), (600, [float("nan")] * 6), (700, [float("inf")] * 6), (None, rows[0][1]),
             (800, [1.0, 2.0]), (801, [1.0, 0.5]), (801, [1.0, 0.5]), rows[100], (100, rows[3][1]), (900, [2.0 ** 21] * 6), (901, [-2.0 ** 25] * 6),
             (1000, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    df = df.withColumns({"score": F.lit(1), "rank": F.lit(1), "v": F.lit("x"), "row": F.lit(2)}).repartition(5)
    for config in (SearchConfig(cell_bytes=64 * 48, queries=2), SearchConfig()):
        got = top_k(df, F.col("vec_id") % 100 == 0, config).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_table(rows)
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_wide_scores_are_exact_or_an_error(spark):
    """Sums beyond 64 bits on the way are exact; a score that fits no long stops the job."""
    wide = [(0, [2.0 ** 45, 2.0 ** 45, 3.0]), (1, [2.0 ** 45, -2.0 ** 45, 5.0]), (2, [-2.0 ** 44, 2.0 ** 44, 7.0]), (3, [0.5, -0.5, 1e-9])]
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(table(wide), F.col("vec_id") == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_table(wide)
    with pytest.raises(Exception, match="(?i)too large|overflow"):
        top_k(table([(0, [1e6] * 16), (1, [1e6] * 16)]), F.col("vec_id") == 0).collect()
