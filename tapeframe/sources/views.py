"""Market tapes derived from the supplied tables.

The supplied tables hold no market data, so every tape is a deterministic projection of ``events``
or ``orders``. Each is narrow (scan + project), so column pruning reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "instrument_id"
EVENT_TS = "source_timestamp_ns"
RECV_TS = "receive_timestamp_ns"
SEQ = "sequence_num"
ORDER = [EVENT_TS, SEQ]

_US = "unix_micros(cast({} as timestamp))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # events.ts and orders.o_orderdate carry no zone; the tapes read them as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str, files: int = 100) -> DataFrame:
    """A supplied table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", files).parquet(sf_dir)
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = _US.format("ts")
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id % 8 as bigint) instrument_id",
        "event_id + 1 sequence_num",
        f"{us} * 1000 source_timestamp_ns",
        f"{us} * 1000 + 500000 receive_timestamp_ns",
        "cast(round(value * 100) as bigint) + 1 price",
        "1 + event_id % 500 quantity",
        "case when event_id % 3 = 0 then 2 else 1 end aggressor_side",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_of(table(spark, sf_dir, "events"))


def quotes_of(events: DataFrame) -> DataFrame:
    """Quote tape of an ``events`` table or stream."""
    us = _US.format("ts")
    return events.selectExpr(
        "cast(user_id % 8 as bigint) instrument_id",
        "event_id + 1 sequence_num",
        f"{us} * 1000 source_timestamp_ns",
        f"{us} * 1000 + 200000 receive_timestamp_ns",
        "cast(round(value * 100) as bigint) + 1000 - event_id % 5 best_bid_price",
        "case when event_id % 53 = 0 then 0 else 100 + (event_id * 7) % 900 end best_bid_quantity",
        "cast(round(value * 100) as bigint) + 1000 - event_id % 5"
        " + case when event_id % 37 = 0 then 0 else 1 + event_id % 7 end best_ask_price",
        "100 + (event_id * 13) % 900 best_ask_quantity",
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals_of(table(spark, sf_dir, "events"))


def arrivals_of(events: DataFrame) -> DataFrame:
    """Quotes in arrival order with perturbed clocks and sequence numbers (late, repeated, gapped)."""
    return quotes_of(events).selectExpr(
        "cast(instrument_id % 2 as bigint) venue_id",
        "cast(instrument_id div 4 as bigint) feed_id",
        "instrument_id",
        "sequence_num input_index",
        "sequence_num + (sequence_num * 31) % 11 - 5 sequence_num",
        "source_timestamp_ns + ((sequence_num * 31) % 11 - 5) * 60000000000 source_timestamp_ns",
        "receive_timestamp_ns",
        "best_bid_price",
        "best_bid_quantity",
        "best_ask_price",
        "best_ask_quantity",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide union row per message with faults in every field, for the validation operators.

    message_type: 1 instrument, 2 quote, 3 trade, 4 add, 5 modify, 6 delete, 7 snapshot, 8 status.
    """
    us = _US.format("ts")
    return table(spark, sf_dir, "events").selectExpr(
        "event_id + 1 input_index",
        "cast(1 + event_id % 8 as smallint) message_type",
        "case when event_id % 211 = 0 then 2 else 1 end version",
        "cast(user_id % 2 as bigint) venue_id",
        "cast(user_id % 3 as bigint) feed_id",
        "cast(case when event_id % 223 = 0 then 0 else 1 + user_id % 8 end as bigint) instrument_id",
        "case when event_id % 227 = 0 then 0 else event_id + 1 + (event_id * 31) % 7 - 3 end"
        " sequence_num",
        f"{us} * 1000 source_timestamp_ns",
        f"{us} * 1000 + 500000 receive_timestamp_ns",
        "cast(round(value * 100) as bigint) - case when event_id % 229 = 0 then 60000 else 0 end"
        " price",
        "case when event_id % 61 = 0 then 0 else 1 + event_id % 500 end quantity",
        "event_id % 67 % 3 side",
        "case when event_id % 71 = 0 then 0 else event_id + 7 end order_id",
        "cast(round(value * 100) as bigint) - case when event_id % 73 = 0 then 60000 else 0 end"
        " best_bid_price",
        "case when event_id % 79 = 0 then 0 else 100 end best_bid_quantity",
        "cast(round(value * 100) as bigint) + event_id % 9 - 1 best_ask_price",
        "case when event_id % 83 = 0 then 0 else 100 end best_ask_quantity",
        "cast(event_id % 13 as bigint) bid_levels_count",
        "cast(event_id % 12 as bigint) ask_levels_count",
        "cast(event_id % 5 as bigint) status",
        "event_id % 11 tick_size",
        "event_id % 19 lot_size",
        "event_id % 23 min_quantity",
        "event_id % 97 max_quantity",
        "case when event_id % 8 = 6 and event_id % 9 = 4 then event_id - 10 else 0 end"
        " last_included_sequence",
    )


def book_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 log: add, resize every third order, delete. Actions: 4 add, 5 modify, 6 delete."""
    us = _US.format("o_orderdate")
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 16 instrument_id",
        "o_orderkey order_id",
        "cast(case when o_orderkey % 2 = 0 then 2 else 1 end as bigint) side",
        "case when o_orderkey % 2 = 0 then 10001 + o_orderkey % 50 else 10000 - o_orderkey % 50 end"
        " + case when o_orderkey % 101 = 0 then 5 else 0 end price",
        "10 + o_orderkey % 97 quantity",
        f"{us} t0",
        f"{us} + (1 + o_orderkey % 240) * 3600000000 t1",
    )
    # One pass over the orders: each row expands to its two or three log entries.
    entries = F.expr(
        """filter(array(
             named_struct('action', 4L, 'price', price, 'quantity', quantity, 'ts_ns', t0 * 1000),
             if(order_id % 3 = 0,
                named_struct('action', 5L, 'price', price + order_id % 2,
                             'quantity', quantity + order_id % 7 - 3,
                             'ts_ns', ((t0 + t1) div 2) * 1000), null),
             named_struct('action', 6L, 'price', price, 'quantity', quantity, 'ts_ns', t1 * 1000)),
           e -> e is not null)"""
    )
    return base.select("instrument_id", "order_id", "side", F.explode(entries).alias("e")).select(
        "instrument_id", F.col("e.action").alias("action"), "order_id", "side",
        F.col("e.price").alias("price"), F.col("e.quantity").alias("quantity"),
        F.col("e.ts_ns").alias("ts_ns"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed fills spread over 2024-2030, at odd times of day, for the fee and calendar rules."""
    us = _US.format("o_orderdate")
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 16 instrument_id",
        "o_orderkey fill_seq",
        # 10650 days carry 1995-01-01 to 2024-02-28.
        f"({us} + 10650 * 86400000000 + (o_orderkey * 7919 % 86400) * 1000000) * 1000"
        " fill_timestamp_ns",
        "case when o_orderkey % 3 = 0 then 'buy' when o_orderkey % 7 < 4 then 'sell' else 'buy' end"
        " side",
        "cast(1 + o_orderkey * 37 % 1999 as bigint) quantity",
        "cast(round(o_totalprice / 10) as bigint) + 1 price",
        "cast(round(o_totalprice / 10) as bigint) + 1"
        " - case when o_orderkey % 3 = 0 or o_orderkey % 7 >= 4 then 1 + o_orderkey % 5 else 0 end"
        " quote_bid",
        "cast(round(o_totalprice / 10) as bigint) + 1"
        " + case when o_orderkey % 3 = 0 or o_orderkey % 7 >= 4 then 0 else 1 + o_orderkey % 4 end"
        " quote_ask",
        "case when o_orderkey % 11 = 0 then null else 50 + o_orderkey % 3000 end reference_volume",
        "case when o_orderkey % 13 = 0 then 0.0D else (o_orderkey % 40) / 10000.0D end"
        " realized_volatility",
    )


def faulty_book_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book log with shared order ids and bad fields, for the update checks."""
    return book_log(spark, sf_dir).selectExpr(
        "instrument_id", "action", "order_id raw_id", "order_id - order_id % 3 order_id",
        "if(order_id % 23 = 0, 0L, side) side", "if(order_id % 19 = 0, -price, price) price",
        "if(order_id % 17 = 0, 0L, quantity) quantity", "ts_ns",
    )


def traded_book_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book log with executions (action 3) against every order, some too large."""
    log = book_log(spark, sf_dir)
    adds = log.where("action = 4")
    life = "(1 + order_id % 240) * 3600000000000"
    trades_ = adds.select(
        "instrument_id", F.lit(3).cast("long").alias("action"), "order_id", "side", "price",
        F.explode(
            F.expr(f"""array(
              named_struct('q', quantity div 2, 't', ts_ns + {life} div 4),
              named_struct('q', quantity div 2 + order_id % 3, 't', ts_ns + {life} * 3 div 4))""")
        ).alias("x"),
    ).select("instrument_id", "action", "order_id", "side", "price",
             F.col("x.q").alias("quantity"), F.col("x.t").alias("ts_ns"))
    return log.unionByName(trades_)


def book_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-level L2 snapshots, one per order, some out of price order."""
    us = _US.format("o_orderdate")
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 16 instrument_id", "o_orderkey snapshot_id",
        f"({us} + 43200000000) * 1000 + o_orderkey ts_ns",
        "transform(sequence(0L, 2L), i -> named_struct('price', 9990 - i * if(o_orderkey % 5 = 0 and"
        " i = 2, -1, 3), 'quantity', if(o_orderkey % 7 = 0, 0L, 50 + (o_orderkey + i) % 40),"
        " 'order_count', (o_orderkey + i) % 4)) bids",
        "transform(sequence(0L, 2L), i -> named_struct('price', 10010 + i * 2, 'quantity',"
        " 60 + (o_orderkey * 3 + i) % 50, 'order_count', (o_orderkey + i) % 3)) asks",
    )
