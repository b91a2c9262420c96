"""Prefix aggregates and bounded look-back against plain Python, with a hot key and tied clocks."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeframe.operators import scan
from tapeframe.operators.asof import asof


def _rows(seed, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 1 if rng.random() < 0.6 else rng.randint(2, 5)  # one key holds most rows
        ts = rng.choice([rng.randint(0, 1000), 500, -rng.randint(0, 50)])
        out.append((key, ts, i, rng.choice([None, rng.randint(-9, 9)]), rng.random() < 0.5))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k long, ts long, seq long, v long, flag boolean")


def _ordered(rows, descending=False):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2]), reverse=descending):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("descending", [False, True])
def test_running_matches_loop(spark, both_plans, descending):
    rows = _rows(3)
    out = scan.running(
        _frame(spark, rows), ["k"], ["ts", "seq"], descending,
        total=scan.running_sum("v"), before=scan.running_sum("v", False),
        n=scan.running_count(), top=scan.running_max("v", False), low=scan.running_min("v"),
        last=scan.running_last("v"), prev=scan.running_last("v", False),
    ).collect()
    want = {}
    for group in _ordered(rows, descending).values():
        seen = []
        for r in group:
            earlier = [x for x in seen if x is not None]
            now = earlier + ([r[3]] if r[3] is not None else [])
            want[r[2]] = (
                sum(now) if now else None, sum(earlier) if earlier else None, len(seen) + 1,
                max(earlier, default=None), min(now, default=None),
                now[-1] if now else None, earlier[-1] if earlier else None,
            )
            seen.append(r[3])
    got = {r.seq: (r.total, r.before, r.n, r.top, r.low, r.last, r.prev) for r in out}
    assert got == want


def test_running_without_key(spark, both_plans):
    rows = _rows(4)
    out = scan.running(_frame(spark, rows), [], ["ts", "seq"], n=scan.running_count()).collect()
    order = [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert {r.seq: r.n for r in out} == {s: i + 1 for i, s in enumerate(order)}


@pytest.mark.parametrize("n", [1, 3, 20])
def test_history_matches_loop(spark, both_plans, n):
    rows = _rows(5)
    df = _frame(spark, rows).withColumn("v", F.coalesce("v", F.lit(0)))
    line = scan.history(df, ["k", "flag"], ["ts", "seq"], n, only=F.col("flag"))
    w = line.window().rowsBetween(-n, 0)
    out = line.result(line.df.withColumn("s", F.sum("v").over(w))).where("flag").collect()
    want = {}
    for group in _ordered([r for r in rows if r[4]]).values():
        values = [r[3] or 0 for r in group]
        for i, r in enumerate(group):
            want[r[2]] = sum(values[max(0, i - n): i + 1])
    assert {r.seq: r.s for r in out} == want


def test_chunks_bound_a_hot_key(spark, chunked):
    df = spark.range(1000).selectExpr("1L k", "id ts", "id seq")
    width = scan.chunk_width(df, ["k"], "ts")
    assert width is not None
    biggest = df.groupBy(F.floor(F.col("ts") / width)).count().agg(F.max("count")).first()[0]
    assert biggest <= 4 * chunked


def test_small_input_needs_no_job(spark):
    df = spark.sql("select * from values (1L, 1L), (1L, 2L) as t(k, ts)")
    assert scan.chunk_width(df, ["k"], "ts") is None


@settings(max_examples=6, deadline=None)
@given(
    left=st.lists(st.tuples(st.integers(1, 2), st.integers(0, 20)), min_size=1, max_size=15),
    right=st.lists(st.tuples(st.integers(1, 2), st.integers(0, 20)), min_size=1, max_size=15),
    forward=st.booleans(),
)
def test_asof_matches_search(spark, left, right, forward):
    lhs = [(k, t, i) for i, (k, t) in enumerate(left)]
    rhs = [(k, t, i) for i, (k, t) in enumerate(right)]
    out = asof(
        spark.createDataFrame(lhs, "k long, t long, i long"),
        spark.createDataFrame(rhs, "k long, rt long, j long"),
        ["k"], "t", "rt", ["i"], ["j"], ["j"], forward=forward,
    ).collect()
    want = {}
    for k, t, i in lhs:
        side = sorted((rt, j) for rk, rt, j in rhs if rk == k)
        if forward:
            hits = [j for rt, j in side if rt >= t]
            want[i] = hits[0] if hits else None
        else:
            hits = [j for rt, j in side if rt <= t]
            want[i] = hits[-1] if hits else None
    assert {r.i: r.j for r in out} == want


def test_asof_staleness(spark, both_plans):
    lhs = spark.createDataFrame([(1, t, t) for t in range(0, 100, 7)], "k long, t long, i long")
    rhs = spark.createDataFrame([(1, t, t) for t in range(0, 100, 20)], "k long, rt long, j long")
    out = asof(lhs, rhs, ["k"], "t", "rt", ["i"], ["j"], ["j"], max_staleness=8).collect()
    assert {r.i: r.j for r in out} == {
        t: (t // 20 * 20 if t % 20 <= 8 else None) for t in range(0, 100, 7)
    }


def test_a_key_is_cut_before_its_sorts_fill_a_task(spark):
    """Several sorts of one task hold the rows at once; half a million rows of a key are a chunk."""
    one_key = spark.range(600_000).selectExpr("0L k", "id t")
    width = scan.chunk_width(one_key, ["k"], "t")
    assert width is not None and width <= 600_000
    assert scan.chunk_width(one_key.where("t < 400000"), ["k"], "t") is None


def test_a_plan_is_run_once_and_sorted_once(spark, chunked):
    """Measuring a plan must not run it again, and no join may sort the rows beside the window."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    df = spark.range(100, numPartitions=2).selectExpr("id % 2 k", "id t").mapInPandas(counted, "k long, t long")
    out = scan.running(df, ["k"], ["t"], n=scan.running_count())
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.agg(F.sum("n")).first()[0] == 2 * sum(range(1, 51))
    assert seen.value == 100
