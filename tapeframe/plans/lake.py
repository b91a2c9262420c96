"""Registered dataset queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeframe import contracts
from tapeframe.plans.duck import QUOTES, TRADES
from tapeframe.session import fresh_folder
from tapeframe.plans.stored import extract_and_store
from tapeframe.sources import commits, lake, views
from tapeframe.streaming import streams


def _trades(spark, sf):
    return views.trades(spark, sf)


def _stored(spark, sf):
    root = fresh_folder(spark, "lake")
    lake.write_dataset(_trades(spark, sf), root, "trades", provenance={"source": "events"})
    return root


def column_projection(spark, sf):
    return _trades(spark, sf).select("instrument_id", "price")


def dataset_roundtrip(spark, sf):
    return lake.read_dataset(spark, _stored(spark, sf), "trades")


def partition_filtered_read(spark, sf):
    return lake.read_dataset(
        spark, _stored(spark, sf), "trades", ["sequence_num", "price"],
        {"date": "2024-01-10", "instrument_id": 3},
    )


def utc_dates(spark, sf):
    return lake.with_date(_trades(spark, sf)).select("sequence_num", "date")


def partition_stats(spark, sf):
    return lake.partition_stats(lake.with_date(_trades(spark, sf)), ["date", "instrument_id"])


def dataset_stats(spark, sf):
    s = lake.dataset_stats(_trades(spark, sf))
    return s.select(
        "record_count", "min_timestamp_ns", "max_timestamp_ns",
        F.array_join(F.col("instrument_ids").cast("array<string>"), ",").alias("instrument_ids"),
        F.array_join("dates", ",").alias("dates"),
    )


def file_manifest(spark, sf):
    root = _stored(spark, sf)
    return spark.read.schema(lake.FILE_SCHEMA).parquet(f"{root}/trades/files").groupBy("dataset_id").agg(
        F.sum("record_count").alias("record_count"), F.min("min_timestamp_ns").alias("min_timestamp_ns"),
        F.max("max_timestamp_ns").alias("max_timestamp_ns"),
        F.min("min_sequence").alias("min_sequence"), F.max("max_sequence").alias("max_sequence"),
    )


def dataset_catalog(spark, sf):
    return lake.list_datasets(spark, _stored(spark, sf)).select(
        "dataset_id", "manifest_version", "record_count", "compression"
    )


def integrity_audit(spark, sf):
    return lake.verify_integrity(spark, _stored(spark, sf), "trades").agg(
        *[
            F.count_if(F.col(c)).alias(c)
            for c in ("is_missing", "is_unlisted", "size_mismatch", "checksum_mismatch",
                      "row_mismatch")
        ]
    )


def integrity_audit_damaged(spark, sf):
    """A dataset of which three files went wrong after it was written: one is cut short, one is gone, one is new."""
    root = fresh_folder(spark, "lake")
    lake.write_dataset(_trades(spark, sf), root, "trades", partition_by=("instrument_id",))
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(f"{root}/trades/data")
    store, keep = folder.getFileSystem(spark._jsc.hadoopConfiguration()), True

    def only_file(instrument):
        found = store.globStatus(fs.Path(folder, f"p_instrument_id={instrument}/*.parquet"))
        return found[0].getPath()

    util, conf = fs.FileUtil, spark._jsc.hadoopConfiguration()
    util.copy(store, only_file(3), store, fs.Path(folder, "p_instrument_id=3/extra.parquet"), not keep, conf)
    store.delete(only_file(2), False)
    short = only_file(1)
    store.delete(short, False)
    out = store.create(short, True)
    out.write(bytearray(b"PAR1"))
    out.close()
    return lake.verify_integrity(spark, root, "trades").groupBy(
        F.regexp_extract("relative_path", r"p_instrument_id=(\d+)", 1).cast("long").alias("instrument_id")
    ).agg(*[F.count_if(F.col(c)).alias(c) for c in _FLAGS])


_FLAGS = ("is_missing", "is_unlisted", "size_mismatch", "checksum_mismatch", "row_mismatch")


def _in_batches(spark, sf):
    """Trades committed in four batches by sequence number, the second one twice."""
    root, trades = fresh_folder(spark, "lake"), _trades(spark, sf)
    for k in (0, 1, 1, 2, 3):
        commits.commit(trades.where(F.pmod("sequence_num", F.lit(4)) == k), root, "trades", f"batch-{k}", provenance={"source": "events"})
    return root


def dataset_commits(spark, sf):
    """Live batches of a dataset, from its log."""
    return commits.batch_report(spark, _in_batches(spark, sf), "trades").select(
        "batch", "record_count", "min_timestamp_ns", "max_timestamp_ns")


def dataset_compaction(spark, sf):
    """Rows read back after four batches became one."""
    root = _in_batches(spark, sf)
    commits.compact(spark, root, "trades", "compact-1")
    return lake.read_dataset(spark, root, "trades")


def _catalogued(spark, root, dataset_id):
    """Catalog row beside the sums of the integrity audit."""
    flags = lake.verify_integrity(spark, root, dataset_id).agg(
        *[F.count_if(F.col(c)).alias(c) for c in _FLAGS]).selectExpr(f"{' + '.join(_FLAGS)} as n_faults")
    row = lake.get_dataset(spark, root, dataset_id).select(
        "dataset_id", "record_count", "min_timestamp_ns", "max_timestamp_ns",
        F.array_join(F.col("instrument_ids").cast("array<string>"), ",").alias("instrument_ids"), F.size("dates").alias("n_dates"))
    return row.withColumn("n_faults", flags.scalar())


def compacted_catalog(spark, sf):
    root = _in_batches(spark, sf)
    commits.compact(spark, root, "trades", "compact-1")
    return _catalogued(spark, root, "trades")


def streamed_catalog(spark, sf):
    """A dataset that a stream appended, as the catalog and the audit see it."""
    base = fresh_folder(spark, "stream-lake")
    lake.write_dataset(_trades(spark, sf), base, "source", partition_by=("date",))
    stream = lake.stream_dataset(spark, base, "source", files_per_batch=10)
    streams.append_to_lake(stream, base, "copy", f"{base}/checkpoint")
    return _catalogued(spark, base, "copy")


def stored_feature_catalog(spark, sf):
    """A stored feature table, as the catalog and the audit see it."""
    root = fresh_folder(spark, "features")
    extract_and_store(views.quotes(spark, sf), root, "features")
    return _catalogued(spark, root, "features").select("dataset_id", "record_count", "n_faults")


def source_lineage(spark, sf):
    df = lake.lineage_of(views.table(spark, sf, "events"))
    return df.select(F.regexp_extract("source_file", r"([^/]+)$", 1).alias("file_name"), "n_rows")


def manifest_audit(spark, sf):
    """Manifests derived from the trade tape, one dataset per instrument, some made wrong."""
    stats = lake.partition_stats(lake.with_date(_trades(spark, sf)), ["date", "instrument_id"])
    files = stats.selectExpr(
        "concat('ds', instrument_id) dataset_id",
        "concat(case when day(date) % 10 = 0 and instrument_id = 1 then '../' "
        " when day(date) % 10 = 5 and instrument_id = 2 then '/' else '' end, 'date=',"
        " case when instrument_id = 3 and day(date) = 2 then '2024-01-01' else string(date) end)"
        " relative_path",
        "record_count", "record_count * 100 byte_size",
    )
    manifests = stats.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("record_count").alias("r")
    ).selectExpr(
        "concat('ds', instrument_id) dataset_id",
        "if(instrument_id = 4, '2.0.0', '1.0.0') manifest_version", "instrument_id <> 5 is_complete",
        "n + if(instrument_id = 6, 1, 0) partition_count",
        "r - if(instrument_id = 7, 1, 0) record_count",
        "r * 100 + if(instrument_id = 0, 7, 0) total_byte_size",
    )
    return lake.manifest_audit(manifests, files)


def replay_upcast(spark, sf):
    """Trades under the older replay contract joined with snapshots under the newer one."""
    head = {
        "version": F.lit(1), "flags": F.lit(0), "venue_id": F.lit(1), "feed_id": F.lit(1),
        "checksum": F.lit(0),
    }
    t = _trades(spark, sf).withColumns(
        {**head, "message_type": F.lit(3), "source": F.lit(1), "input_index": F.col("sequence_num")}
    )
    old = lake.contracted(t, contracts.REPLAY_V1_0)
    s = views.book_snapshots(spark, sf).withColumns(
        {**head, "message_type": F.lit(7), "source": F.lit(2), "input_index": F.col("snapshot_id"),
         "sequence_num": F.col("snapshot_id"), "source_timestamp_ns": F.col("ts_ns"),
         "receive_timestamp_ns": F.col("ts_ns"), "last_included_sequence": F.lit(0),
         "bid_levels_count": F.size("bids"), "ask_levels_count": F.size("asks")}
    )
    both = lake.upcast_union([old, s], contracts.REPLAY_V1_1)
    return both.selectExpr(
        "message_type", "instrument_id", "sequence_num", "source_timestamp_ns", "price", "quantity",
        "bid_levels_count", "element_at(bids, 1).price first_bid",
    )


def conformance_report(spark, sf):
    df = _trades(spark, sf).withColumns({"price": F.col("price").cast("string"), "odd": F.lit(1)})
    return lake.conformance_report(df, contracts.TRADE)


def table_concat(spark, sf):
    t, q = _trades(spark, sf), views.quotes(spark, sf)
    cols = ["instrument_id", "sequence_num", "source_timestamp_ns"]
    return lake.concat([t.select(*cols), q.select(*cols)])


QUERIES = {
    f.__name__: f
    for f in (
        column_projection, dataset_roundtrip, partition_filtered_read, utc_dates, partition_stats,
        dataset_stats, file_manifest, dataset_catalog, integrity_audit, source_lineage,
        manifest_audit, replay_upcast, conformance_report, table_concat, integrity_audit_damaged,
        dataset_commits, dataset_compaction, compacted_catalog, streamed_catalog, stored_feature_catalog,
    )
}

_DATED = TRADES + """, dated as (
 select *, cast(make_timestamp(source_timestamp_ns // 1000) as date) date from trades)"""
_STATS = _DATED + """, stats as (
 select date, instrument_id, count(*) record_count, min(source_timestamp_ns) min_timestamp_ns,
  max(source_timestamp_ns) max_timestamp_ns, min(sequence_num) min_sequence,
  max(sequence_num) max_sequence from dated group by 1, 2)"""

# The trade contract beside the table given to it: price as text, aggressor side an int, one column too many.
_CONFORMANCE = [
    ("version", "smallint", None), ("message_type", "smallint", None), ("flags", "int", None), ("venue_id", "int", None),
    ("feed_id", "int", None), ("instrument_id", "bigint", "bigint"), ("checksum", "int", None),
    ("sequence_num", "bigint", "bigint"), ("source_timestamp_ns", "bigint", "bigint"),
    ("receive_timestamp_ns", "bigint", "bigint"), ("trade_id", "bigint", None), ("price", "bigint", "string"),
    ("quantity", "bigint", "bigint"), ("aggressor_side", "smallint", "int"), ("maker_order_id", "bigint", None),
    ("taker_order_id", "bigint", None), ("odd", None, "int"),
]


def _conformance_sql() -> str:
    rows, at = [], 0
    for i, (name, want, have) in enumerate(_CONFORMANCE):
        quoted = [f"'{x}'" if x else "null" for x in (name, want, have)]
        nulls = f"(select count(*) filter ({name} is null) from trades)" if want and have else "0"
        rows.append(f"({', '.join(quoted)}, {i if want else 'null'}, {at if have else 'null'}, {want is None}, {nulls},"
                    f" {have is None}, {want == have})".lower())
        at += have is not None
    return (f"with {TRADES} select * from (values {', '.join(rows)}) t(\"column\", expected_type, actual_type, expected_position,"
            " actual_position, is_extra, null_violations, is_missing, is_type_match)")


ORACLES = {
    "conformance_report": _conformance_sql(),
    "column_projection": f"with {TRADES} select instrument_id, price from trades",
    "dataset_roundtrip": f"with {TRADES} select * from trades",
    "partition_filtered_read": f"with {_DATED} select sequence_num, price from dated"
    " where date = date '2024-01-10' and instrument_id = 3",
    "utc_dates": f"with {_DATED} select sequence_num, date from dated",
    "partition_stats": f"with {_STATS} select * from stats",
    "dataset_stats": f"""with {_DATED} select count(*) record_count,
 min(source_timestamp_ns) min_timestamp_ns, max(source_timestamp_ns) max_timestamp_ns,
 string_agg(distinct instrument_id::varchar, ',' order by instrument_id::varchar) instrument_ids,
 string_agg(distinct date::varchar, ',' order by date::varchar) dates from dated""",
    "file_manifest": f"""with {TRADES} select 'trades' dataset_id, count(*) record_count,
 min(source_timestamp_ns) min_timestamp_ns, max(source_timestamp_ns) max_timestamp_ns,
 min(sequence_num) min_sequence, max(sequence_num) max_sequence from trades""",
    "dataset_catalog": "select 'trades' dataset_id, '1.0.0' manifest_version, count(*)"
    " record_count, 'zstd' compression from events",
    "integrity_audit": "select cast(0 as bigint) is_missing, cast(0 as bigint) is_unlisted,"
    " cast(0 as bigint) size_mismatch, cast(0 as bigint) checksum_mismatch,"
    " cast(0 as bigint) row_mismatch",
    "integrity_audit_damaged": f"""with {TRADES} select instrument_id,
 count(distinct case when instrument_id = 2 then 1 end) is_missing,
 count(distinct case when instrument_id = 3 then 1 end) is_unlisted,
 count(distinct case when instrument_id = 1 then 1 end) size_mismatch,
 count(distinct case when instrument_id = 1 then 1 end) checksum_mismatch,
 count(distinct case when instrument_id in (1, 2) then 1 end) row_mismatch from trades group by 1""",
    "dataset_commits": f"""with {TRADES} select 'batch-' || (sequence_num % 4) batch, count(*) record_count,
 min(source_timestamp_ns) min_timestamp_ns, max(source_timestamp_ns) max_timestamp_ns from trades group by 1""",
    "dataset_compaction": f"with {TRADES} select * from trades",
    **{name: f"""with {TRADES} select '{dataset}' dataset_id, count(*) record_count, min(source_timestamp_ns) min_timestamp_ns,
 max(source_timestamp_ns) max_timestamp_ns, (select string_agg(i::varchar, ',' order by i) from (select distinct instrument_id i from trades)) instrument_ids,
 cast(count(distinct cast(make_timestamp(source_timestamp_ns // 1000) as date)) as integer) n_dates, cast(0 as bigint) n_faults from trades"""
       for name, dataset in (("compacted_catalog", "trades"), ("streamed_catalog", "copy"))},
    "stored_feature_catalog": f"with {QUOTES} select 'features' dataset_id, count(*) record_count, cast(0 as bigint) n_faults from quotes",
    "source_lineage": "select 'events.parquet' file_name, count(*) n_rows from events",
    "manifest_audit": f"""with {_STATS}, files as (
 select instrument_id i, 'ds' || instrument_id dataset_id,
  case when day(date) % 10 = 0 and instrument_id = 1 then '../'
   when day(date) % 10 = 5 and instrument_id = 2 then '/' else '' end || 'date='
   || case when instrument_id = 3 and day(date) = 2 then '2024-01-01' else date::varchar end p,
  record_count from stats),
paths as (select i, dataset_id, p, count(*) copies from files group by 1, 2, 3)
select dataset_id, i = 5 is_incomplete, i = 4 bad_version, i = 6 count_mismatch,
 i = 7 record_mismatch, i in (0, 7) and (i = 0) byte_mismatch,
 count(*) filter (copies > 1) duplicate_paths,
 count(*) filter (p like '/%' or p like '../%') unsafe_paths, cast(0 as bigint) negative_sizes
 from paths group by i, dataset_id""",
    "replay_upcast": f"""with {TRADES} select cast(3 as smallint) message_type, instrument_id,
 sequence_num, source_timestamp_ns, price, quantity, cast(null as bigint) bid_levels_count,
 cast(null as bigint) first_bid from trades
union all select 7, o_custkey % 16, o_orderkey,
 (epoch_us(o_orderdate) + 43200000000) * 1000 + o_orderkey, null, null, 3, 9990
 from orders""",
    "table_concat": f"with {TRADES}, {QUOTES} select instrument_id, sequence_num,"
    " source_timestamp_ns from trades union all select instrument_id, sequence_num,"
    " source_timestamp_ns from quotes",
}
