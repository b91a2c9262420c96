"""Packed roles of combinatorial folds against a row per fold."""

import random

import pytest
from pyspark.sql import functions as F
from tapeframe.operators import packed
from tapeframe.operators import splits as ops


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(i, rng.randrange(400), rng.choice([0, 3, 60])) for i in range(300)], "row_id long, ts long, h long")


@pytest.mark.parametrize("n, k, embargo", [(4, 1, 0), (5, 2, 9), (7, 3, 20), (8, 4, 5)])
def test_packed_roles_are_the_members(spark, samples, n, k, embargo):
    purge = ops.PurgeConfig(embargo_ns=embargo)
    blocks = ops.contiguous_blocks(ops.TimeAxis(samples, "ts", "row_id"), n)
    folds = ops.combinatorial_folds(blocks, k)
    want = {(r.row_id, r.split_index): r.role for r in ops.membership(samples, "ts", "row_id", folds, "h", purge).collect()}
    rows = packed.packed_membership(samples, "ts", blocks, folds, "h", purge)
    assert rows.count() == 300 and "Generate" not in rows._jdf.queryExecution().executedPlan().toString()
    opened = packed.open_roles(rows, len(folds)).collect()
    assert len(opened) == len(want) and all(want[r.row_id, r.split_index] == r.role for r in opened)
    for i in {0, len(folds) // 2, len(folds) - 1}:
        for role in packed.CODES:
            one = packed.take_packed(rows, len(folds), i, role)
            assert "Generate" not in one._jdf.queryExecution().executedPlan().toString()
            assert {r.row_id for r in one.collect()} == {r for (r, f), x in want.items() if f == i and x == role}
    counts = {r.split_index: r for r in packed.packed_counts(rows, len(folds)).collect()}
    for i in range(len(folds)):
        assert counts[i].train_rows == sum(f == i and x == "train" for (_, f), x in want.items())
    with pytest.raises(ValueError):
        packed.take_packed(rows, len(folds), len(folds), "train")


def test_bad_horizons_stay_visible(samples):
    blocks = ops.contiguous_blocks(ops.TimeAxis(samples, "ts", "row_id"), 4)
    rows = packed.packed_membership(samples.withColumn("h", F.lit(-1)), "ts", blocks, ops.combinatorial_folds(blocks, 2), "h", ops.PurgeConfig())
    assert all(r.is_bad_horizon and r.label_end_ns is None for r in rows.collect())


def test_reading_a_fold_works_each_row_out_once(samples):
    """The filter on the roles is pushed to the scan; it holds every block's conditions once."""
    blocks = ops.contiguous_blocks(ops.TimeAxis(samples, "ts", "row_id"), 6)
    folds = ops.combinatorial_folds(blocks, 2)
    rows = packed.packed_membership(samples, "ts", blocks, folds, 5, ops.PurgeConfig(embargo_ns=7))
    plan = packed.take_packed(rows, len(folds), 7, "train").select("row_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") == 6
