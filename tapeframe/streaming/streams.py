"""Streaming twins of the batch operators, and the runs that drive them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.operators.features import FeatureConfig, with_quote_validity, with_spread_mid
from tapeframe.operators.quoting import QuotingConfig, quote_decisions
from tapeframe.session import STATE_STORE, fresh_folder
from tapeframe.sources import commits, lake
from tapeframe.streaming.processors import BookKeeper, LateGuard, QuoteFeatures, SequenceGuard


def _stateful(df: DataFrame, keys: Sequence[str], processor, schema: T.StructType) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None"
    )


def drop_late(stream: DataFrame) -> DataFrame:
    return _stateful(stream, ["instrument_id"], LateGuard(), stream.schema)


def sequence_status(stream: DataFrame) -> DataFrame:
    schema = T.StructType(
        [*stream.schema.fields, T.StructField("previous_sequence", T.LongType()),
         T.StructField("sequence_status", T.StringType())]
    )
    return _stateful(stream, ["venue_id", "feed_id"], SequenceGuard(), schema)


def quote_features(stream: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Instant and rolling OFI, log return and volatility of a quote stream."""
    schema = T.StructType(
        [*stream.schema.fields, T.StructField("instant_ofi", T.LongType()),
         T.StructField("rolling_ofi", T.LongType()), T.StructField("log_return", T.DoubleType()),
         T.StructField("realized_volatility", T.DoubleType())]
    )
    out = _stateful(
        stream, ["instrument_id"],
        QuoteFeatures(config.ofi_window, config.volatility_window, config.return_lookback), schema,
    )
    # NaN marks "not yet known" inside the processor; the table contract uses NULL.
    clean = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("log_return", "realized_volatility")}
    return with_spread_mid(with_quote_validity(out.withColumns(clean)))


def bbo_feed(stream: DataFrame, policy: str = "allow") -> DataFrame:
    """BBO changes of an L3 event stream with a per-instrument ``seq``."""
    names = ["instrument_id", "seq", "best_bid_price", "best_bid_quantity", "best_bid_orders",
             "best_ask_price", "best_ask_quantity", "best_ask_orders"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])
    return _stateful(stream, ["instrument_id"], BookKeeper(policy), schema)


def decisions(
    features: DataFrame, inventory: DataFrame | None = None,
    configs: Sequence[QuotingConfig] = (QuotingConfig(),),
) -> DataFrame:
    """Quote decisions of a feature stream; inventory comes from a static table per instrument."""
    df = features
    if inventory is not None:
        df = df.join(inventory.select("instrument_id", "inventory"), "instrument_id", "left")
    else:
        df = df.withColumn("inventory", F.lit(0).cast("long"))
    df = df.withColumns(
        {
            "inventory": F.coalesce("inventory", F.lit(0)),
            "available_timestamp_ns": F.col("receive_timestamp_ns"),
            "decision_timestamp_ns": F.col("receive_timestamp_ns"),
            "has_rolling_ofi": F.col("rolling_ofi").isNotNull(),
            "has_realized_volatility": F.col("realized_volatility").isNotNull(),
        }
    )
    return quote_decisions(df, configs)


# --- running -------------------------------------------------------------------------------------


def state_settings(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def state_partitions(spark: SparkSession) -> str:
    """State stores per query: ``spark.tapeframe.statePartitions``, else one per core on a local
    master and the session's shuffle partitions on a cluster. Fixed at a query's first start."""
    named = spark.conf.get("spark.tapeframe.statePartitions", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return str(spark.sparkContext.defaultParallelism)
    return spark.conf.get("spark.sql.shuffle.partitions")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available, resuming from ``checkpoint``; returns the sink so far."""
    spark = stream.sparkSession
    state_settings(spark)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", state_partitions(spark))
    try:
        query = (
            stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    return spark.read.schema(stream.schema).parquet(path)


def run_once(stream: DataFrame, label: str) -> DataFrame:
    base = fresh_folder(stream.sparkSession, label)
    return run_available(stream, f"{base}/out", f"{base}/checkpoint")


def run_in_steps(
    parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], label: str,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Feed ``parts`` one after the other, stopping and restarting the query in between.

    Each restart resumes from the checkpoint, so the result equals one uninterrupted run.
    """
    spark = parts[0].sparkSession
    base = fresh_folder(spark, label)
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = (
            spark.readStream.schema(part.schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(f"{base}/in")
        )
        out = run_available(build(stream), f"{base}/out", f"{base}/checkpoint")
    return out


def append_to_lake(
    stream: DataFrame, root: str, dataset_id: str, checkpoint: str,
    partition_by: Sequence[str] = ("date",), provenance: dict[str, str] | None = None,
) -> DataFrame:
    """Append each micro-batch to a dataset as a commit and log its audit row; returns the audit log.

    A batch replayed after a failure is written once: by its log entry, or else over its own half-written
    folder. The dataset has a manifest after every batch.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        name = f"{batch_id:012d}"
        if commits.is_committed(spark, f"{root}/{dataset_id}", name):
            return
        kept = batch.persist()
        lake.partition_stats(kept, ["instrument_id"]).withColumn(
            "batch_id", F.lit(batch_id)
        ).write.mode("overwrite").parquet(f"{root}/{dataset_id}/audit/batch={batch_id}")
        commits.commit(kept, root, dataset_id, name, partition_by=partition_by, provenance=provenance)
        kept.unpersist()

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/{dataset_id}/audit")
