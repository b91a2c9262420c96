"""Batches of a dataset: replay, failure half-way, compaction, and what a commit reads."""

import glob
import os

import pytest
from conftest import SF
from pyspark.sql import functions as F
from tapeframe.session import fresh_folder
from tapeframe.sources import commits, lake, views


def _part(spark, k):
    return views.trades(spark, SF).where(F.pmod("sequence_num", F.lit(4)) == k)


def _state(root):
    """Every file of a dataset with its size and time of change."""
    return {p: (os.stat(p).st_size, os.stat(p).st_mtime_ns) for p in glob.glob(f"{root}/d/**", recursive=True) if os.path.isfile(p)}


def _rows(spark, root):
    return sorted(map(repr, lake.read_dataset(spark, root, "d").select("sequence_num", "price", "source_timestamp_ns").collect()))


def _is_clean(spark, root):
    return not any(v for r in lake.verify_integrity(spark, root, "d").collect() for k, v in r.asDict().items() if k != "relative_path")


def test_a_replayed_batch_changes_nothing(spark):
    root = fresh_folder(spark, "test-commits")
    assert commits.commit(_part(spark, 0), root, "d", "b0") and commits.commit(_part(spark, 1), root, "d", "b1")
    before, rows = _state(root), _rows(spark, root)
    assert not commits.commit(_part(spark, 1), root, "d", "b1")
    assert not commits.commit(_part(spark, 2), root, "d", "b0")  # the id counts, not the rows
    assert _state(root) == before and _rows(spark, root) == rows
    assert lake.get_dataset(spark, root, "d").first().record_count == len(rows) and _is_clean(spark, root)


def test_a_commit_reads_its_own_files_only(spark, monkeypatch):
    root = fresh_folder(spark, "test-commits")
    commits.commit(_part(spark, 0), root, "d", "b0")
    old = {p: s for p, s in _state(root).items() if "batch=b0" in p}
    for p in old:
        if "/data/" in p and p.endswith(".parquet"):
            os.chmod(p, 0o000)
    seen, facts = [], lake.file_facts
    monkeypatch.setattr(lake, "file_facts", lambda spark, path, below="", data=None: seen.append(below) or facts(spark, path, below, data))
    commits.commit(_part(spark, 1), root, "d", "b1")
    assert seen == ["p_batch=b1"]
    assert {p: s for p, s in _state(root).items() if p in old} == old
    for p in old:
        os.chmod(p, 0o644)
    assert _is_clean(spark, root)


def test_half_written_batches_do_not_exist(spark):
    root = fresh_folder(spark, "test-commits")
    commits.commit(_part(spark, 0), root, "d", "b0")
    rows = _rows(spark, root)
    # A writer that died after the data: a folder without an entry.
    lost = f"{root}/d/data/p_batch=b1"
    lake.with_date(_part(spark, 2)).withColumnRenamed("date", "p_date").write.partitionBy("p_date").parquet(lost)
    assert _rows(spark, root) == rows and commits.live_batches(spark, f"{root}/d") == ["b0"]
    assert any(r.is_unlisted for r in lake.verify_integrity(spark, root, "d").collect())
    assert commits.commit(_part(spark, 1), root, "d", "b1")
    want = sorted(map(repr, views.trades(spark, SF).where("pmod(sequence_num, 4) < 2").select(
        "sequence_num", "price", "source_timestamp_ns").collect()))
    assert _rows(spark, root) == want and _is_clean(spark, root)


def test_compaction_keeps_rows(spark):
    root = fresh_folder(spark, "test-commits")
    for k in range(4):
        commits.commit(_part(spark, k), root, "d", f"b{k}")
    rows, files = _rows(spark, root), commits.live_files(spark, f"{root}/d").count()
    assert commits.compact(spark, root, "d", "c1") and not commits.compact(spark, root, "d", "c1")
    assert _rows(spark, root) == rows and _is_clean(spark, root)
    assert commits.live_batches(spark, f"{root}/d") == ["c1"] and commits.live_files(spark, f"{root}/d").count() < files
    m = lake.get_dataset(spark, root, "d").first()
    assert m.record_count == 1000 and m.instrument_ids == sorted({r.instrument_id for r in views.trades(spark, SF).collect()})
    commits.commit(_part(spark, 0), root, "d", "b4")
    assert commits.live_batches(spark, f"{root}/d") == ["b4", "c1"] and len(_rows(spark, root)) == 1250
    report = {r.batch: r.record_count for r in commits.batch_report(spark, root, "d").collect()}
    assert report == {"b4": 250, "c1": 1000}


def test_empty_batches_own_dates_and_ids(spark):
    root = fresh_folder(spark, "test-commits")
    own = views.trades(spark, SF).limit(10).withColumn("date", F.to_date(F.lit("1999-01-01")))
    assert commits.commit(own, root, "d", "b0") and commits.commit(own.limit(0), root, "d", "b1")
    back = lake.read_dataset(spark, root, "d")
    assert back.count() == 10 and {str(r.date) for r in back.collect()} == {"1999-01-01"}
    assert {r.batch: r.record_count for r in commits.batch_report(spark, root, "d").collect()} == {"b0": 10, "b1": 0}
    for name, batch in (("../d", "b"), ("d", "a/b"), ("d", "")):
        with pytest.raises(ValueError):
            commits.commit(own, root, name, batch)
    with pytest.raises(ValueError):
        commits.commit(own, root, "d", "b2", compression="lzo")
