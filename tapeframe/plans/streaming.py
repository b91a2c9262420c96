"""Registered streaming queries. Their oracles are those of the batch operators they mirror."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeframe.operators import book
from tapeframe.operators.quoting import DECISION, QuotingConfig
from tapeframe.plans import book as book_plans
from tapeframe.plans import features as feature_plans
from tapeframe.plans import quoting as quoting_plans
from tapeframe.plans import tape as tape_plans
from tapeframe.plans.duck import TRADES
from tapeframe.session import fresh_folder
from tapeframe.sources import lake, views
from tapeframe.streaming import streams

IDS = ["instrument_id", "sequence_num"]
CONFIG = QuotingConfig(max_ofi_magnitude=800.0, max_volatility=1.4, max_notional_exposure=1e7)


def _events(spark, sf):
    return views.stream_table(spark, sf, "events")


def stream_late_drop(spark, sf):
    out = streams.drop_late(views.arrivals_of(_events(spark, sf)))
    return streams.run_once(
        out.select("instrument_id", "input_index", "source_timestamp_ns"), "late"
    )


def stream_sequence_status(spark, sf):
    # Only what the check reads goes through its Python workers.
    arrivals = views.arrivals_of(_events(spark, sf)).select("venue_id", "feed_id", "input_index", "sequence_num")
    return streams.run_once(streams.sequence_status(arrivals), "sequence")


def stream_quote_features(spark, sf):
    """The quote stream interrupted and resumed half-way."""
    q = views.quotes(spark, sf)
    half = q.agg(F.expr("percentile_approx(source_timestamp_ns, 0.5)")).first()[0]
    early = F.col("source_timestamp_ns") <= half
    out = streams.run_in_steps(
        [q.where(early), q.where(~early)],
        lambda s: streams.quote_features(s).select(
            *IDS, "instant_ofi", "rolling_ofi", "log_return", "realized_volatility"),
        "features",
    )
    return out.withColumns(
        {c: F.round(c, 9) for c in ("log_return", "realized_volatility")}
    )


def _book_parts(spark, sf):
    log = book.with_log_sequence(views.book_log(spark, sf))
    half = log.agg(F.expr("percentile_approx(ts_ns, 0.5)")).first()[0]
    return [log.where(F.col("ts_ns") <= half), log.where(F.col("ts_ns") > half)]


def stream_bbo(spark, sf):
    return streams.run_in_steps(_book_parts(spark, sf), streams.bbo_feed, "bbo")


def stream_bbo_reject(spark, sf):
    return streams.run_in_steps(
        _book_parts(spark, sf), lambda s: streams.bbo_feed(s, "reject"), "bbo-reject"
    )


def stream_quote_decisions(spark, sf):
    feats = streams.quote_features(views.quotes_of(_events(spark, sf))).withColumn(
        "realized_volatility", F.round("realized_volatility", 9)
    )
    position = views.trades(spark, sf).groupBy("instrument_id").agg(
        F.sum(F.expr("if(aggressor_side = 1, quantity, -quantity)")).alias("inventory")
    )
    d = streams.decisions(feats, position, [CONFIG])
    return streams.run_once(
        d.select(*DECISION).withColumns(
            {"reasons": F.concat_ws(",", "reasons"), "bid_distance": F.round("bid_distance", 9),
             "ask_distance": F.round("ask_distance", 9)}
        ), "decisions",
    )


def stream_lake_append(spark, sf):
    base = fresh_folder(spark, "stream-lake")
    trades = views.trades(spark, sf)
    lake.write_dataset(trades, base, "source", partition_by=("date",))
    stream = lake.stream_dataset(spark, base, "source", files_per_batch=10)
    streams.append_to_lake(stream, base, "copy", f"{base}/checkpoint")
    return lake.read_dataset(spark, base, "copy")


QUERIES = {
    f.__name__: f
    for f in (
        stream_late_drop, stream_sequence_status, stream_quote_features, stream_bbo,
        stream_bbo_reject, stream_quote_decisions, stream_lake_append,
    )
}

ORACLES = {
    "stream_late_drop": feature_plans.ORACLES["late_event_drop"],
    "stream_sequence_status": tape_plans.ORACLES["sequence_status"],
    "stream_quote_features": f"with {feature_plans._QUOTE_CORE} select instrument_id, sequence_num,"
    " instant_ofi, rolling_ofi, log_return, realized_volatility from qf",
    "stream_bbo": book_plans.ORACLES["bbo_timeline"],
    "stream_quote_decisions": f"""with {feature_plans._QUOTE_CORE}, {TRADES}, held as (
 select instrument_id, cast(sum(case when aggressor_side = 1 then quantity else -quantity end)
  as bigint) inventory from trades group by 1),
market as (
 select q.*, coalesce(held.inventory, 0) inventory, receive_timestamp_ns available_timestamp_ns,
  receive_timestamp_ns decision_timestamp_ns from qf q left join held using (instrument_id)),
{quoting_plans._decide(True, [CONFIG])}
select config_id, instrument_id, sequence_num, decision_timestamp_ns, mid_price,
 reservation_price, target_half_spread, inventory, bid_ticks, bid_quantity, bid_distance,
 bid_reason, ask_ticks, ask_quantity, ask_distance, ask_reason, is_valid,
 array_to_string(reasons, ',') reasons from dec""",
    "stream_lake_append": f"with {TRADES} select * from trades",
}
