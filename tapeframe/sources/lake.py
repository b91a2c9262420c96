"""Contracted Parquet datasets with manifests, a catalog and integrity audits.

A dataset is ``<root>/<dataset_id>/`` with ``data/`` (Hive-style Parquet), ``files/`` (one manifest
row per data file) and ``manifest/`` (one row for the dataset). File rows stay a table of their own:
a dataset of a million files never becomes one record.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.session import inline_table

KEY_PREFIX = "p_"
# Codecs, identifier pattern and manifest version.
CODECS = ("none", "snappy", "gzip", "zstd")
SAFE_ID = r"^[a-zA-Z0-9_\-]+$"
MANIFEST_VERSION = "1.0.0"
STAMPS = ("source_timestamp_ns", "sequence_num")

FILE_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("byte_size", T.LongType()),
        T.StructField("sha256_checksum", T.StringType()),
        T.StructField("min_timestamp_ns", T.LongType()),
        T.StructField("max_timestamp_ns", T.LongType()),
        T.StructField("min_sequence", T.LongType()),
        T.StructField("max_sequence", T.LongType()),
    ]
)
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("manifest_version", T.StringType()),
        T.StructField("is_complete", T.BooleanType()),
        T.StructField("partition_count", T.LongType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("total_byte_size", T.LongType()),
        T.StructField("compression", T.StringType()),
        T.StructField("min_timestamp_ns", T.LongType()),
        T.StructField("max_timestamp_ns", T.LongType()),
        T.StructField("instrument_ids", T.ArrayType(T.LongType())),
        T.StructField("venue_ids", T.ArrayType(T.LongType())),
        T.StructField("feed_ids", T.ArrayType(T.LongType())),
        T.StructField("dates", T.ArrayType(T.StringType())),
        T.StructField("provenance", T.MapType(T.StringType(), T.StringType())),
    ]
)


# --- contracts -----------------------------------------------------------------------------------


def with_date(df: DataFrame, ts: str = "source_timestamp_ns") -> DataFrame:
    """UTC calendar date of a nanosecond clock, whatever the session time zone."""
    day = f"cast((`{ts}` - pmod(`{ts}`, 86400000000000L)) div 86400000000000L as int)"
    return df.withColumn("date", F.expr(f"date_from_unix_date({day})"))


def contracted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the contract, in order and typed; absent nullable columns become NULL."""
    have, out = set(df.columns), []
    for f in schema.fields:
        if f.name in have:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.nullable:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"column {f.name!r} is required by the contract")
    return df.select(*out)


def conformance_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Per contract column: position, presence, type match and NULLs in required columns."""
    have = {f.name: (i, f) for i, f in enumerate(df.schema.fields)}
    required = [f.name for f in schema.fields if not f.nullable and f.name in have]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required] or [F.lit(0).alias("_")])
    rows = []
    for i, f in enumerate(schema.fields):
        at, found = have.get(f.name, (None, None))
        rows.append((f.name, f.dataType.simpleString(),
                     found.dataType.simpleString() if found else None, i, at, False))
    for name, (i, f) in have.items():
        if name not in schema.names:
            rows.append((name, None, f.dataType.simpleString(), None, i, True))
    table = inline_table(
        df.sparkSession, "column string, expected_type string, actual_type string,"
        " expected_position int, actual_position int, is_extra boolean", rows,
    )
    counted = nulls.select(
        F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in nulls.columns]),
                                    F.array(*[F.col(c) for c in nulls.columns])))
        .alias("column", "null_violations")
    )
    table = table.join(F.broadcast(counted), "column", "left")
    return table.withColumns(
        {
            "is_missing": F.col("actual_type").isNull(),
            "is_type_match": F.coalesce(F.col("actual_type") == F.col("expected_type"), F.lit(False)),
            "null_violations": F.coalesce("null_violations", F.lit(0)),
        }
    )


def is_compatible(have: str, need: str) -> bool:
    """Same major version and at least the needed minor version."""
    a, b = [int(x) for x in have.split(".")], [int(x) for x in need.split(".")]
    return a[0] == b[0] and a[1] >= b[1]


def upcast_union(frames: Sequence[DataFrame], schema: T.StructType) -> DataFrame:
    """Tables of older compatible contracts under the newest one."""
    out = contracted(frames[0], schema)
    for f in frames[1:]:
        out = out.unionByName(contracted(f, schema))
    return out


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- statistics ----------------------------------------------------------------------------------


def partition_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    ts, seq = STAMPS
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min(ts).alias("min_timestamp_ns"), F.max(ts).alias("max_timestamp_ns"),
        F.min(seq).alias("min_sequence"), F.max(seq).alias("max_sequence"),
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    """One row: rows, time range and the distinct instruments, venues, feeds and dates."""
    ts = STAMPS[0]
    have = set(df.columns)

    def distinct(c):
        if c not in have:
            return F.array().cast("array<bigint>")
        return F.array_sort(F.collect_set(F.col(c).cast("bigint")))

    return with_date(df).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min(ts).alias("min_timestamp_ns"), F.max(ts).alias("max_timestamp_ns"),
        distinct("instrument_id").alias("instrument_ids"), distinct("venue_id").alias("venue_ids"),
        distinct("feed_id").alias("feed_ids"),
        F.array_sort(F.collect_set(F.col("date").cast("string"))).alias("dates"),
    )


# --- write and read ------------------------------------------------------------------------------


def write_dataset(
    df: DataFrame, root: str, dataset_id: str, schema: T.StructType | None = None,
    partition_by: Sequence[str] = ("date", "instrument_id"), compression: str = "zstd",
    mode: str = "overwrite", provenance: dict[str, str] | None = None,
    rows_per_file: int = 5_000_000,
) -> str:
    """Write a dataset and its manifest; returns the dataset folder.

    Rows are range-partitioned by partition keys and event order: a partition that holds most of the
    data becomes many files instead of one task, and files have tight time ranges for pruning.
    Directory columns carry a prefix, so the key columns also stay in the file body. ``overwrite``
    replaces only the partitions present in ``df``.
    """
    if not re.match(SAFE_ID, dataset_id):
        raise ValueError(f"unsafe dataset id {dataset_id!r}")
    if compression not in CODECS:
        raise ValueError(f"unknown codec {compression!r}")
    spark, path = df.sparkSession, f"{root}/{dataset_id}"
    body = df if schema is None else contracted(df, schema)
    layout = with_date(body) if "date" in partition_by and "date" not in body.columns else body
    dirs = {f"{KEY_PREFIX}{k}": F.col(k) for k in partition_by}
    layout = layout.withColumns(dirs)
    if "date" not in body.columns and "date" in layout.columns:
        layout = layout.drop("date")
    order = [*dirs, *[c for c in STAMPS if c in body.columns]]
    layout = layout.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = layout.write.mode(mode).option("compression", compression).option(
        "maxRecordsPerFile", rows_per_file
    ).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*dirs) if dirs else writer).parquet(f"{path}/data")
    write_manifest(spark, root, dataset_id, compression, provenance)
    return path


def _data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def relative_path(path: Column) -> Column:
    """Path below ``data/``; URI escapes are undone so both readers agree."""
    return F.regexp_replace(F.url_decode(path), r"^.*/data/", "")


def file_facts(spark: SparkSession, path: str, below: str = "", data: DataFrame | None = None) -> DataFrame:
    """Actual files of a dataset: size, SHA-256 and row statistics, from the files themselves; ``below``
    limits them to one folder, whose rows are ``data``. A file that cannot be read has no row statistics."""
    ts, seq = STAMPS
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true").load(f"{path}/data/{below}".rstrip("/"))
        .select(relative_path(F.col("path")).alias("relative_path"), F.col("length").alias("byte_size"),
                F.sha2("content", 256).alias("sha256_checksum"))
    )
    data = _data(spark, path) if data is None else data
    ts, seq = (F.col(c) if c in data.columns else F.lit(None).cast("long") for c in (ts, seq))
    rows = data.groupBy(relative_path(F.col("_metadata.file_path")).alias("relative_path")).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min(ts).alias("min_timestamp_ns"), F.max(ts).alias("max_timestamp_ns"),
        F.min(seq).alias("min_sequence"), F.max(seq).alias("max_sequence"),
    )
    return files.join(rows, "relative_path", "full")


def write_manifest(
    spark: SparkSession, root: str, dataset_id: str, compression: str = "zstd",
    provenance: dict[str, str] | None = None,
) -> None:
    path = f"{root}/{dataset_id}"
    facts = file_facts(spark, path).withColumn("dataset_id", F.lit(dataset_id))
    facts.select(*FILE_SCHEMA.names).write.mode("overwrite").parquet(f"{path}/files")
    totals = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/files").agg(
        F.count(F.lit(1)).alias("partition_count"), F.sum("byte_size").alias("total_byte_size")
    ).first()
    lineage = {k: str(v) for k, v in (provenance or {}).items()}
    one = dataset_stats(_data(spark, path)).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(MANIFEST_VERSION).alias("manifest_version"),
        F.lit(True).alias("is_complete"),
        F.lit(totals["partition_count"]).alias("partition_count"), "record_count",
        F.lit(totals["total_byte_size"]).alias("total_byte_size"),
        F.lit(compression).alias("compression"), "min_timestamp_ns", "max_timestamp_ns",
        "instrument_ids", "venue_ids", "feed_ids", "dates",
        F.create_map(*[F.lit(x) for kv in lineage.items() for x in kv]).cast("map<string,string>")
        .alias("provenance"),
    )
    one.write.mode("overwrite").json(f"{path}/manifest")


def lineage_of(df: DataFrame) -> DataFrame:
    """Source files a table was read from, one row each with its row count."""
    return df.groupBy(F.col("_metadata.file_path").alias("source_file")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def read_dataset(
    spark: SparkSession, root: str, dataset_id: str, columns: Sequence[str] | None = None,
    partitions: dict[str, object] | None = None,
) -> DataFrame:
    """Dataset rows with column and partition pruning; an unknown partition key is an error. Of a dataset
    with a commit log only live batches are read."""
    from tapeframe.sources import commits

    path = f"{root}/{dataset_id}"
    df = commits.read_committed(spark, path) if commits.has_log(spark, path) else _data(spark, path)
    dirs = [c for c in df.columns if c.startswith(KEY_PREFIX)]
    for key, value in (partitions or {}).items():
        if KEY_PREFIX + key not in dirs:
            raise ValueError(f"{key!r} is not a partition key of {dataset_id!r}")
        df = df.where(F.col(KEY_PREFIX + key).cast("string") == str(value))
    df = df.drop(*dirs)
    return df.select(*columns) if columns else df


def stream_dataset(
    spark: SparkSession, root: str, dataset_id: str, files_per_batch: int = 100
) -> DataFrame:
    """The dataset as a stream of bounded batches of files."""
    path = f"{root}/{dataset_id}"
    schema = _data(spark, path).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(
        f"{path}/data"
    )
    return df.drop(*[c for c in df.columns if c.startswith(KEY_PREFIX)])


# --- catalog and audits --------------------------------------------------------------------------


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of all complete, readable datasets; hidden folders and broken manifests are skipped."""
    rows = spark.read.schema(MANIFEST_SCHEMA).option("mode", "DROPMALFORMED").json(
        f"{root}/[!.]*/manifest"
    )
    return rows.where(F.col("is_complete") & F.col("manifest_version").startswith("1."))


def get_dataset(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    if not re.match(SAFE_ID, dataset_id):
        raise ValueError(f"unsafe dataset id {dataset_id!r}")
    return list_datasets(spark, root).where(F.col("dataset_id") == dataset_id)


def unsafe_path(path: Column) -> Column:
    """Empty, absolute, containing a NUL byte, or climbing out of the dataset."""
    clean = F.trim(path)
    return (
        path.isNull() | (clean == "") | clean.rlike(r"^[/\\]") | clean.rlike(r"(^|/)\.\.(/|$)")
        | clean.contains("\0")
    )


def manifest_audit(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Manifests against their file rows: one row per dataset with a flag per broken rule."""
    per_path = files.groupBy("dataset_id", F.trim("relative_path").alias("relative_path")).agg(
        F.count(F.lit(1)).alias("copies"), F.sum("record_count").alias("records"),
        F.sum("byte_size").alias("bytes"),
        F.count_if((F.col("record_count") < 0) | (F.col("byte_size") < 0)).alias("negative"),
    )
    sums = per_path.groupBy("dataset_id").agg(
        F.sum("copies").alias("n_files"), F.sum("records").alias("records"),
        F.sum("bytes").alias("bytes"), F.count_if(F.col("copies") > 1).alias("duplicate_paths"),
        F.count_if(unsafe_path(F.col("relative_path"))).alias("unsafe_paths"),
        F.sum("negative").alias("negative_sizes"),
    )
    j = manifests.join(sums, "dataset_id", "left")
    return j.select(
        "dataset_id",
        (~F.coalesce("is_complete", F.lit(False))).alias("is_incomplete"),
        (~F.coalesce(F.col("manifest_version").startswith("1."), F.lit(False))).alias("bad_version"),
        (F.col("partition_count") != F.coalesce("n_files", F.lit(0))).alias("count_mismatch"),
        (F.col("record_count") != F.coalesce("records", F.lit(0))).alias("record_mismatch"),
        (F.col("total_byte_size") != F.coalesce("bytes", F.lit(0))).alias("byte_mismatch"),
        F.coalesce("duplicate_paths", F.lit(0)).alias("duplicate_paths"),
        F.coalesce("unsafe_paths", F.lit(0)).alias("unsafe_paths"),
        F.coalesce("negative_sizes", F.lit(0)).alias("negative_sizes"),
    )


def verify_integrity(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Files against the manifest: one row per file with a flag per difference. Files that cannot be read
    as Parquet count as without rows."""
    from tapeframe.sources import commits

    path = f"{root}/{dataset_id}"
    data = spark.read.option("ignoreCorruptFiles", "true").schema(_data(spark, path).schema).parquet(f"{path}/data")
    replaced = F.lit(False)
    if commits.has_log(spark, path):
        old = commits.entries(spark, path).where("relative_path is not null").select("relative_path", "batch")
        replaced = F.regexp_extract("relative_path", f"^{commits.BATCH_DIR}=([^/]*)", 1).isin(
            [r.batch for r in old.where(~F.col("batch").isin(commits.live_batches(spark, path))).select("batch").distinct().collect()])
    want = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/files").select(
        "relative_path", "record_count", "byte_size", "sha256_checksum"
    )
    have = file_facts(spark, path, data=data).where(~replaced).select(
        "relative_path", F.col("record_count").alias("actual_count"),
        F.col("byte_size").alias("actual_size"), F.col("sha256_checksum").alias("actual_sha"),
    )
    j = want.join(have, "relative_path", "full")
    return j.select(
        "relative_path",
        F.col("actual_size").isNull().alias("is_missing"),
        F.col("byte_size").isNull().alias("is_unlisted"),
        F.coalesce(F.col("byte_size") != F.col("actual_size"), F.lit(False)).alias("size_mismatch"),
        F.coalesce(F.lower("sha256_checksum") != F.col("actual_sha"), F.lit(False)).alias(
            "checksum_mismatch"),
        F.coalesce(F.col("record_count") != F.coalesce("actual_count", F.lit(0)), F.lit(False)).alias(
            "row_mismatch"),
    )
