"""Split goldens, tie handling and triple-barrier labels against a loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeframe.operators import labels
from tapeframe.operators import splits as ops


def _line(spark, n=100, step=10):
    return spark.range(n).selectExpr(f"id * {step} ts", "id row_id")


def test_holdout_purge(spark):
    out = ops.holdout(_line(spark), "ts", "row_id", 0.7, 0.0, 0.3, 50)
    roles = {r.row_id: r.role for r in out.collect()}
    assert [i for i in range(70) if roles[i] == "purged"] == [65, 66, 67, 68, 69]
    assert all(roles[i] == "test" for i in range(70, 100))


def test_embargo(spark):
    out = ops.purged_k_fold(_line(spark), "ts", "row_id", 5, 0, ops.PurgeConfig(0, 30))
    fold = {r.row_id: r.role for r in out.where("split_index = 1").collect()}
    assert [i for i in range(100) if fold[i] == "embargoed"] == [40, 41, 42]
    assert fold[43] == "train" and all(fold[i] == "train" for i in range(20))
    assert all(fold[i] == "test" for i in range(20, 40))


def _slow_cut(ts, target, left, right):
    n = len(ts)
    if target <= 0 or target >= n or ts[target - 1] != ts[target]:
        return target
    s, e = ts.index(ts[target]), n - ts[::-1].index(ts[target])
    ok = [c for c in (e, s) if c >= left and n - c >= right]
    return min(ok, key=lambda c: abs(c - target)) if ok else None


def test_safe_cut_with_ties(spark):
    rng = random.Random(1)
    ts = sorted(rng.randint(0, 12) for _ in range(60))
    df = spark.createDataFrame([(t, i) for i, t in enumerate(ts)], "ts long, row_id long")
    axis = ops.TimeAxis(df, "ts", "row_id")
    axis.prefetch(range(60))
    for target in range(61):
        want = _slow_cut(ts, target, 1, 1)
        if want is None:
            with pytest.raises(ValueError):
                axis.safe_cut(target)
        else:
            assert axis.safe_cut(target) == want
    assert [axis.ts_at(i) for i in range(60)] == ts
    assert [axis.tie_at(i) for i in (3, 20, 41)] == [3, 20, 41]


def test_all_equal_timestamps_cannot_be_split(spark):
    df = spark.range(10).selectExpr("5L ts", "id row_id")
    with pytest.raises(ValueError):
        ops.holdout(df, "ts", "row_id", 0.7, 0.0, 0.3)


def test_walk_forward_needs_enough_rows(spark):
    with pytest.raises(ValueError):
        ops.walk_forward(_line(spark, 10), "ts", "row_id", 3, 5, 5)


def test_manifest_seal(spark):
    axis = ops.TimeAxis(_line(spark), "ts", "row_id")
    folds = [ops.Fold(i, (b,), None, None) for i, b in enumerate(ops.contiguous_blocks(axis, 4))]
    table = ops.fold_table(spark, folds)
    m = ops.split_manifest(table, "purged_k_fold", "d", "h", axis.total, ops.PurgeConfig())
    assert ops.verify_split_manifest(m).first().is_sealed
    bad = m.withColumn("total_records", F.lit(7).cast("long"))
    assert not ops.verify_split_manifest(bad).first().is_sealed


def test_compliance_finds_overlap_and_duplicates(spark):
    axis = ops.TimeAxis(_line(spark), "ts", "row_id")
    folds = [ops.Fold(0, (axis.block(50, 70),), None, None)]
    good = ops.membership(_line(spark), "ts", "row_id", folds, 0, ops.PurgeConfig(0, 30))
    table = ops.fold_table(spark, folds)
    clean = ops.split_compliance(good, table, "row_id", "ts", ops.PurgeConfig(0, 30)).first()
    assert sum(clean[c] for c in clean.asDict() if c != "split_index") == 0
    extra = good.where("row_id = 3").union(good.where("row_id = 55").withColumn("role", F.lit("train")))
    r = ops.split_compliance(good.union(extra), table, "row_id", "ts", ops.PurgeConfig(0, 30)).first()
    assert (r.in_both, r.duplicate_train, r.unpurged) == (1, 1, 1)


def _barrier_loop(rows, up, down, hold):
    out = {}
    for i, (ts, tie, p) in enumerate(rows):
        hit = None
        for t, _, q in rows[i + 1:]:
            ret = (q - p) / p
            if t >= ts + hold:
                hit = ("vertical", t, q)
            elif ret >= up:
                hit = ("upper", t, q)
            elif ret <= -down:
                hit = ("lower", t, q)
            if hit:
                break
        out[tie] = hit or ("censored", rows[-1][0], rows[-1][2])
    return out


def test_triple_barrier_matches_loop(spark, both_plans):
    rng = random.Random(7)
    rows, ts, p = [], 0, 1000
    for i in range(220):
        ts += rng.choice([0, 0, 1, 3, 40])
        p = max(10, p + rng.randint(-40, 40))
        rows.append((ts, i, p))
    df = spark.createDataFrame([(1, *r) for r in rows],
                               "instrument_id long, ts long, seq long, price long")
    got = labels.triple_barrier(df, "ts", "price", "seq", 0.05, 0.04, 30).collect()
    name = {}
    for r in got:
        kind = ("upper" if r.hit_upper else "lower" if r.hit_lower
                else "vertical" if r.hit_vertical else "censored")
        name[r.seq] = (kind, r.exit_timestamp_ns, r.exit_price)
        assert r.is_valid == (kind != "censored") and (r.return_value is None) == (kind == "censored")
    assert name == _barrier_loop(rows, 0.05, 0.04, 30)


def test_forward_return_beyond_the_series_is_invalid(spark):
    df = spark.createDataFrame([(1, 0, 1, 100), (1, 10, 2, 110)],
                               "instrument_id long, ts long, seq long, price long")
    a, b = labels.forward_returns(df, "ts", "price", "seq", 10).orderBy("seq").collect()
    assert (a.has_forward_target, a.forward_return) == (True, pytest.approx(0.1))
    assert (b.has_forward_target, b.forward_return, b.label_end_ns) == (False, None, 20)


def test_barrier_search_holds_a_few_numbers_per_price():
    """The blocks of all levels together are as long as the prices, not as long once per level."""
    import tracemalloc

    prices = np.random.default_rng(3).integers(100, 160, 200_000).astype("float64")
    prices[::97] = np.nan
    own = np.arange(0, len(prices), 2)
    tracemalloc.start()
    at = labels._first_exit(prices, 0.35, 0.25, own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * len(prices)
    for i in own[:: 997]:
        ret = (prices[i + 1:] - prices[i]) / prices[i]
        out = np.flatnonzero(~((ret < 0.35) & (ret > -0.25)))
        assert at[i // 2] == (i + 1 + out[0] if len(out) else len(prices))
