"""Role audits against pairs, and splits that are sealed, checked and read back."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tapeframe.operators import sealed, tape
from tapeframe.operators import splits as ops

PURGE = ops.PurgeConfig(purge_horizon_ns=5, embargo_ns=7)


def _members(spark, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), rng.randrange(60), rng.choice(["train", "train", "validation", "test", "purged"]), t, t + rng.choice([0, 3, 40]))
            for t in (rng.randrange(200) for _ in range(160))]
    blocks = [(s, r, a, a + rng.choice([0, 5, 30])) for s in (0, 1) for r in ("validation", "test") for a in (rng.randrange(200) for _ in range(4))]
    return (rows, blocks, spark.createDataFrame(rows, "split_index long, row_id long, role string, ts long, label_end_ns long"),
            spark.createDataFrame(blocks, "split_index long, role string, block_start long, block_stop long"))


def test_leaks_between_all_roles_match_pairs(spark, both_plans):
    rows, blocks, members, block_table = _members(spark)
    want = {}
    for a, b in sealed.PAIRS:
        for s in (0, 1):
            ids = [{r[1] for r in rows if r[0] == s and r[2] == role} for role in (a, b)]
            labels = sum(any(x[0] == s and x[1] == b and r[3] < x[3] and r[4] >= x[2] and x[2] < x[3] for x in blocks)
                         for r in rows if r[0] == s and r[2] == a)
            if ids[0] & ids[1] or labels:
                want[s, a, b] = (len(ids[0] & ids[1]), labels)
    got = sealed.role_audit(members, block_table, "row_id", "ts").collect()
    assert {(r.split_index, r.earlier, r.later): (r.in_both, r.label_leaks) for r in got} == want
    assert sealed.role_audit(members.limit(0), block_table, "row_id", "ts").collect() == []


def test_a_planted_leak_of_each_pair_is_found(spark):
    blocks = spark.createDataFrame([(0, "validation", 100, 200), (0, "test", 200, 300)],
                                   "split_index long, role string, block_start long, block_stop long")
    clean = [(0, 1, "train", 10, 20), (0, 2, "validation", 110, 150), (0, 3, "test", 210, 400)]
    schema = "split_index long, row_id long, role string, ts long, label_end_ns long"
    assert sealed.role_audit(spark.createDataFrame(clean, schema), blocks, "row_id", "ts").collect() == []
    planted = {("train", "validation"): (0, 4, "train", 90, 100), ("train", "test"): (0, 5, "train", 250, 250), ("validation", "test"): (0, 6, "validation", 199, 200)}
    for pair, row in planted.items():
        got = sealed.role_audit(spark.createDataFrame([*clean, row], schema), blocks, "row_id", "ts").collect()
        assert [((r.earlier, r.later), r.in_both, r.label_leaks) for r in got] == [(pair, 0, 1)]
    twice = spark.createDataFrame([*clean, (0, 1, "train", 10, 20), (0, 3, "test", 210, 400), (0, 3, "test", 210, 400)], schema)
    assert sorted((r.role, r.n_rows) for r in sealed.repeated_in_role(twice, "row_id").collect()) == [("test", 1), ("train", 1)]


@pytest.fixture(scope="module")
def split(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.randrange(500), rng.random()) for i in range(400)], "row_id long, ts long, x double")
    folds = [ops.Fold(i, (b,), None, None) for i, b in enumerate(ops.contiguous_blocks(ops.TimeAxis(df, "ts", "row_id"), 4))]
    members = ops.membership(df, "ts", "row_id", folds, 5, PURGE)
    d = tape.content_digest(df).first()
    parent = f"{d.n_rows}:{d.digest_xor}:{d.digest_sum}"
    seal = sealed.seal_split(members, ops.fold_table(spark, folds), "ts", "purged_k_fold", "d", parent, {"n_splits": 4}, PURGE)
    row = seal.first()
    return df, members, parent, spark.createDataFrame([(row.body, row.content_hash)], "body string, content_hash string")


def test_seal_holds_settings_bounds_and_counts(split):
    df, members, parent, seal = split
    row = sealed.is_sealed(seal).first()
    body = json.loads(row.body)
    assert row.is_sealed and row.body == json.dumps(body, sort_keys=True, separators=(",", ":"))
    assert body["dataset_hash"] == parent and body["config"] == {"embargo_ns": 7, "n_splits": 4, "purge_horizon_ns": 5, "timestamp_column": "ts"}
    counts = {r.split_index: r for r in ops.split_counts(members).collect()}
    for s in body["splits"]:
        c = counts[s["split_index"]]
        assert (s["train_rows"], s["test_rows"], s["purged_rows"], s["embargoed_rows"]) == (c.train_rows, c.test_rows, c.purged_rows, c.embargoed_rows)


def test_a_changed_byte_is_found(split, spark):
    df, _, parent, seal = split
    for old, new in (('"embargo_ns":7', '"embargo_ns":8'), (parent, "0:0:0"), ('"d"', '"e"')):
        changed = seal.withColumn("body", F.replace("body", F.lit(old), F.lit(new)))
        assert not sealed.is_sealed(changed).first().is_sealed
        with pytest.raises(ValueError):
            sealed.read_partition(df, changed, 0, "train", 5)
    with pytest.raises(ValueError):
        sealed.read_partition(df, seal, 0, "train", 5, "other data")


def test_read_back_equals_the_partition(split, spark, tmp_path):
    df, members, parent, seal = split
    for k in range(4):
        for role in ("train", "test", "purged", "embargoed"):
            want = sorted(r.row_id for r in ops.take_partition(members, k, role).collect())
            assert sorted(r.row_id for r in sealed.read_partition(df, seal, k, role, 5, parent).collect()) == want
    df.write.parquet(str(tmp_path / "d"))
    plan = sealed.read_partition(spark.read.parquet(str(tmp_path / "d")), seal, 1, "test", 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_digest_parts_its_values(spark):
    a = spark.createDataFrame([("a|b", "c"), ("\\", None)], "x string, y string")
    for other in ([("a", "b|c"), ("\\", None)], [("a|b", "c"), (None, "\\")], [("a\\|b", "c"), ("\\", None)]):
        b = spark.createDataFrame(other, "x string, y string")
        assert tape.content_digest(a).first() != tape.content_digest(b).first()
