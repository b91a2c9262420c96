"""Datasets on disk and interrupted streams."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tapeframe import contracts
from tapeframe.operators import tape
from tapeframe.session import fresh_folder
from tapeframe.sources import lake, views
from tapeframe.streaming import streams

from conftest import SF


@pytest.fixture(scope="module")
def stored(spark):
    root = fresh_folder(spark, "test-lake")
    lake.write_dataset(views.trades(spark, SF), root, "trades", partition_by=("date",),
                       provenance={"source": "events"})
    return root


def test_round_trip_and_pruning(spark, stored):
    t = views.trades(spark, SF)
    back = lake.read_dataset(spark, stored, "trades")
    assert sorted(map(repr, back.select(*t.columns).collect())) == sorted(map(repr, t.collect()))
    day = lake.read_dataset(spark, stored, "trades", ["price"], {"date": "2024-01-05"})
    assert day.columns == ["price"]
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p_date" in plan and "ReadSchema: struct<price:bigint>" in plan
    with pytest.raises(ValueError):
        lake.read_dataset(spark, stored, "trades", partitions={"venue": 1})


def test_key_columns_stay_in_the_body(spark):
    root = fresh_folder(spark, "test-body")
    lake.write_dataset(views.trades(spark, SF), root, "d")
    one = glob.glob(f"{root}/d/data/*/*/*.parquet")[0]
    assert "instrument_id" in spark.read.parquet(one).columns
    assert "p_date" not in spark.read.parquet(one).columns


def test_catalog(spark, stored):
    shutil.copytree(f"{stored}/trades/manifest", f"{stored}/.hidden/manifest", dirs_exist_ok=True)
    os.makedirs(f"{stored}/broken/manifest", exist_ok=True)
    with open(f"{stored}/broken/manifest/part.json", "w") as f:
        f.write("{not json")
    assert [r.dataset_id for r in lake.list_datasets(spark, stored).collect()] == ["trades"]
    m = lake.get_dataset(spark, stored, "trades").first()
    assert m.record_count == 1000 and m.provenance == {"source": "events"} and len(m.dates) == 30
    with pytest.raises(ValueError):
        lake.get_dataset(spark, stored, "../trades")


def test_integrity_finds_tampering(spark):
    root = fresh_folder(spark, "test-audit")
    lake.write_dataset(views.trades(spark, SF), root, "d", partition_by=("date",))
    clean = lake.verify_integrity(spark, root, "d").collect()
    assert not any(v for r in clean for k, v in r.asDict().items() if k != "relative_path")
    files = sorted(glob.glob(f"{root}/d/data/*/*.parquet"))
    os.remove(files[0])
    part = spark.read.parquet(files[1])
    rows = part.limit(1).collect()
    spark.createDataFrame(rows, part.schema).coalesce(1).write.parquet(f"{root}/tmp")
    os.replace(glob.glob(f"{root}/tmp/*.parquet")[0], files[1])
    for crc in glob.glob(f"{root}/d/data/*/.*.crc"):
        os.remove(crc)
    bad = {r.relative_path: r for r in lake.verify_integrity(spark, root, "d").collect()}
    assert bad[os.path.relpath(files[0], f"{root}/d/data")].is_missing
    r = bad[os.path.relpath(files[1], f"{root}/d/data")]
    assert r.checksum_mismatch and r.size_mismatch and r.row_mismatch


def test_paths(spark):
    rows = [("a/b.parquet", False), ("../a", True), ("a/../b", True), ("/a", True), ("\\a", True),
            ("  ", True), (None, True), ("a/..b", False), ("a\0b", True)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(rows)], "i int, p string")
    got = {r.i: r.u for r in df.select("i", lake.unsafe_path(F.col("p")).alias("u")).collect()}
    assert got == {i: u for i, (_, u) in enumerate(rows)}


def test_contract_checks(spark):
    with pytest.raises(ValueError):
        lake.contracted(spark.range(1), contracts.TRADE)
    df = spark.createDataFrame([(None, "x")], "version smallint, price string")
    got = {r.column: r for r in lake.conformance_report(df, contracts.TRADE).collect()}
    assert got["version"].null_violations == 1 and got["version"].is_type_match
    assert not got["price"].is_type_match and got["quantity"].is_missing
    assert lake.is_compatible("1.1.0", "1.0.0") and not lake.is_compatible("1.0.0", "1.1.0")
    assert not lake.is_compatible("2.0.0", "1.0.0")
    assert len(contracts.REPLAY_V1_0.fields) == 32 and len(contracts.REPLAY_V1_1.fields) == 37


def test_codecs_and_ids(spark):
    t = views.trades(spark, SF)
    with pytest.raises(ValueError):
        lake.write_dataset(t, "/tmp/none", "bad id")
    with pytest.raises(ValueError):
        lake.write_dataset(t, "/tmp/none", "d", compression="lz77")


def test_interrupted_stream_equals_batch(spark):
    df = views.arrivals(spark, SF)
    parts = [df.where(F.col("input_index").between(a, b))
             for a, b in ((1, 333), (334, 334), (335, 10**9))]
    got = streams.run_in_steps(parts, streams.sequence_status, "test-seq")
    want = tape.with_sequence_status(df)
    cols = ["input_index", "previous_sequence", "sequence_status"]
    assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))


def test_stream_append_logs_each_batch(spark):
    root = fresh_folder(spark, "test-append")
    lake.write_dataset(views.trades(spark, SF), root, "source", partition_by=("date",))
    stream = lake.stream_dataset(spark, root, "source", files_per_batch=10)
    audit = streams.append_to_lake(stream, root, "copy", f"{root}/ck")
    assert audit.agg(F.sum("record_count")).first()[0] == 1000
    assert audit.select("batch_id").distinct().count() == 3
    assert lake.read_dataset(spark, root, "copy").count() == 1000


class Held:
    """A value state outside Spark."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_large_batches_are_worked_off_in_slices(monkeypatch):
    """Helper arrays of a key do not grow with its rows, and the cuts change no row."""
    import numpy as np
    import pandas as pd
    from tapeframe.streaming import processors

    rng = np.random.default_rng(5)
    n = 200
    frame = pd.DataFrame({
        "input_index": rng.permutation(n), "sequence_num": rng.integers(0, n, n), "source_timestamp_ns": rng.integers(0, 60, n),
        "best_bid_price": rng.integers(90, 100, n), "best_bid_quantity": rng.integers(0, 9, n),
        "best_ask_price": rng.integers(98, 110, n), "best_ask_quantity": rng.integers(1, 9, n)})
    for make, names in ((processors.SequenceGuard, ["seen"]), (processors.LateGuard, ["seen"]),
                        (lambda: processors.QuoteFeatures(5, 4, 2), ["state"])):
        found = []
        for rows in (10**6, 7):
            monkeypatch.setattr(processors, "SLICE_ROWS", rows)
            p = make()
            for name in names:
                setattr(p, name, Held())
            parts = list(p.handleInputRows((1,), iter([frame.iloc[:120], frame.iloc[120:]]), None))
            assert max(len(x) for x in parts) <= rows
            found.append(pd.concat(parts, ignore_index=True))
        pd.testing.assert_frame_equal(*found)
