"""Commit log of a dataset: batches appended, replayed and compacted without reading what is there.

A batch is a folder of data files and one log entry, a row per file with its size, digest and statistics.
The data are written first, into the batch's own folder, and the entry last: a batch without entry does not
exist for readers, and writing it again replaces its half-written files. A batch that has its entry is never
written again, so a replay after a failure changes nothing. Only the files of the new batch are read for
digests and statistics; manifest and catalog follow from the entries.

A compaction is a batch of its own that names the batches it replaces. Their files stay, for readers that
started before, until they are removed by hand.

Batches of one dataset are committed by one writer at a time, as a stream or a scheduled job does.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.sources import lake

BATCH_DIR = f"{lake.KEY_PREFIX}batch"
_KEYS = {"instrument_ids": "instrument_id", "venue_ids": "venue_id", "feed_ids": "feed_id"}
ENTRY_SCHEMA = T.StructType(
    [
        *lake.FILE_SCHEMA.fields,
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in _KEYS],
        T.StructField("dates", T.ArrayType(T.StringType())),
        T.StructField("compression", T.StringType()),
        T.StructField("replaces", T.ArrayType(T.StringType())),
    ]
)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def has_log(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path}/log")


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    return _exists(spark, f"{path}/log/batch={batch}/_SUCCESS")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """File rows of all committed batches, with ``batch``; a marker row without path stands for each batch."""
    return spark.read.schema(T.StructType([*ENTRY_SCHEMA.fields, T.StructField("batch", T.StringType())])).parquet(f"{path}/log")


def live_batches(spark: SparkSession, path: str) -> list[str]:
    """Committed batches that no committed batch replaces, in order. Compaction keeps the list short."""
    marks = entries(spark, path).where("relative_path is null").select("batch", "replaces").collect()
    gone = {b for m in marks for b in m.replaces or []}
    return sorted({m.batch for m in marks} - gone)


def live_files(spark: SparkSession, path: str) -> DataFrame:
    """File rows of the live batches."""
    return entries(spark, path).where(F.col("relative_path").isNotNull() & F.col("batch").isin(live_batches(spark, path)))


def commit(
    df: DataFrame, root: str, dataset_id: str, batch: str, schema: T.StructType | None = None,
    partition_by: Sequence[str] = ("date",), compression: str = "zstd", provenance: dict[str, str] | None = None,
    replaces: Sequence[str] = (),
) -> bool:
    """Append ``df`` as one batch; False, and nothing changes, if the batch has been committed before.

    A batch without rows is committed too. Directory columns carry a prefix, so columns of ``df`` stay as
    they are, a ``date`` of its own included.
    """
    for name in (dataset_id, batch):
        if not re.match(lake.SAFE_ID, name):
            raise ValueError(f"unsafe id {name!r}")
    if compression not in lake.CODECS:
        raise ValueError(f"unknown codec {compression!r}")
    spark, path = df.sparkSession, f"{root}/{dataset_id}"
    if is_committed(spark, path, batch):
        return False
    body = df if schema is None else lake.contracted(df, schema)
    layout = lake.with_date(body) if "date" in partition_by and "date" not in body.columns else body
    dirs = {f"{lake.KEY_PREFIX}{k}": F.col(k) for k in partition_by}
    layout = layout.withColumns(dirs)
    if "date" not in body.columns and "date" in layout.columns:
        layout = layout.drop("date")
    order = [*dirs, *[c for c in lake.STAMPS if c in body.columns]]
    if order:
        layout = layout.repartitionByRange(*order).sortWithinPartitions(*order)
    folder = f"{path}/data/{BATCH_DIR}={batch}"
    writer = layout.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*dirs) if dirs else writer).parquet(folder)
    stored = spark.read.schema(layout.schema).parquet(folder)
    facts = lake.file_facts(spark, path, f"{BATCH_DIR}={batch}", stored).withColumn("dataset_id", F.lit(dataset_id))
    sets = _key_sets(stored)
    rows = facts.join(sets, "relative_path", "left").withColumns(
        {"compression": F.lit(compression), "replaces": F.lit(None).cast("array<string>")})
    mark = spark.createDataFrame([(dataset_id, compression, list(replaces))], "dataset_id string, compression string, replaces array<string>")
    rows.unionByName(mark, allowMissingColumns=True).select(ENTRY_SCHEMA.names).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/log/batch={batch}")
    refresh_manifest(spark, root, dataset_id, compression, provenance)
    return True


def _key_sets(stored: DataFrame) -> DataFrame:
    """Per file the distinct instruments, venues, feeds and dates."""
    def distinct(c: str):
        return F.array_sort(F.collect_set(F.col(c).cast("bigint"))) if c in stored.columns else F.array().cast("array<bigint>")

    dated = stored.withColumn("relative_path", lake.relative_path(F.col("_metadata.file_path")))
    if lake.STAMPS[0] in stored.columns:
        dated = lake.with_date(dated)
    dates = F.array_sort(F.collect_set(F.col("date").cast("string"))) if "date" in dated.columns else F.array().cast("array<string>")
    return dated.groupBy("relative_path").agg(*[distinct(c).alias(name) for name, c in _KEYS.items()], dates.alias("dates"))


def refresh_manifest(
    spark: SparkSession, root: str, dataset_id: str, compression: str = "zstd", provenance: dict[str, str] | None = None,
) -> None:
    """Manifest and file rows from the log alone."""
    path = f"{root}/{dataset_id}"
    files = live_files(spark, path)
    files.select(*lake.FILE_SCHEMA.names).write.mode("overwrite").parquet(f"{path}/files")

    def union(c: str):
        # Per key first: a set of the keys, not of the files.
        return files.select(F.explode(c).alias("k")).distinct().agg(F.array_sort(F.collect_list("k")).alias(c))

    totals = files.agg(
        F.count(F.lit(1)).alias("partition_count"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"),
        F.coalesce(F.sum("byte_size"), F.lit(0)).alias("total_byte_size"),
        F.min("min_timestamp_ns").alias("min_timestamp_ns"), F.max("max_timestamp_ns").alias("max_timestamp_ns"),
    )
    totals = totals.withColumns({c: union(c).scalar() for c in [*_KEYS, "dates"]})
    lineage = {k: str(v) for k, v in (provenance or {}).items()}
    one = totals.withColumns(
        {
            "dataset_id": F.lit(dataset_id), "manifest_version": F.lit(lake.MANIFEST_VERSION), "is_complete": F.lit(True),
            "compression": F.lit(compression),
            "provenance": F.create_map(*[F.lit(x) for kv in lineage.items() for x in kv]).cast("map<string,string>"),
        }
    )
    one.select(*lake.MANIFEST_SCHEMA.names).write.mode("overwrite").json(f"{path}/manifest")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the live batches, directory columns included."""
    filled = [r.batch for r in live_files(spark, path).select("batch").distinct().collect()]
    folders = [f"{path}/data/{BATCH_DIR}={b}" for b in sorted(filled) or live_batches(spark, path)]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders)


def batch_report(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """One row per live batch: files, rows, bytes and time range, from the log."""
    path = f"{root}/{dataset_id}"
    marks = entries(spark, path).where("relative_path is null and batch in ({})".format(
        ", ".join(f"'{b}'" for b in live_batches(spark, path)) or "''")).select("batch")
    sums = live_files(spark, path).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("record_count").alias("record_count"), F.sum("byte_size").alias("byte_size"),
        F.min("min_timestamp_ns").alias("min_timestamp_ns"), F.max("max_timestamp_ns").alias("max_timestamp_ns"))
    return marks.join(sums, "batch", "left").na.fill(0, ["n_files", "record_count", "byte_size"])


def compact(
    spark: SparkSession, root: str, dataset_id: str, batch: str, partition_by: Sequence[str] = ("date",), compression: str = "zstd",
    provenance: dict[str, str] | None = None,
) -> bool:
    """Rewrite the live batches as one; False if ``batch`` has been committed before."""
    path = f"{root}/{dataset_id}"
    if is_committed(spark, path, batch):
        return False
    rows = read_committed(spark, path)
    body = rows.drop(*[c for c in rows.columns if c.startswith(lake.KEY_PREFIX)])
    return commit(body, root, dataset_id, batch, None, partition_by, compression, provenance, live_batches(spark, path))
