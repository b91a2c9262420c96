"""Registered tape and point-in-time queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeframe.operators import tape as ops
from tapeframe.operators.asof import asof
from tapeframe.operators.scan import running, running_count
from tapeframe.plans.duck import ARRIVALS, MESSAGES, QUOTES, TRADES
from tapeframe.sources import views

STOP_TS = 1705000000000000000
STALENESS_NS = 3600 * 10**9
HORIZON_NS = 2 * 3600 * 10**9


def message_validation(spark, sf):
    return ops.with_validation(views.messages(spark, sf)).select(
        "input_index", "header_status", "payload_status", "validation_status"
    )


def sequence_status(spark, sf):
    return ops.with_sequence_status(views.arrivals(spark, sf)).select(
        "venue_id", "feed_id", "input_index", "sequence_num", "previous_sequence",
        "sequence_status",
    )


def snapshot_resync(spark, sf):
    return ops.with_resync_status(views.messages(spark, sf)).select(
        "input_index", "sequence_num", "sequence_status"
    )


def sequence_gaps(spark, sf):
    return ops.gap_report(ops.with_sequence_status(views.arrivals(spark, sf)))


def sequence_summary(spark, sf):
    return ops.sequence_summary(ops.with_sequence_status(views.arrivals(spark, sf)))


def canonical_order(spark, sf):
    df = ops.with_canonical_order(views.arrivals(spark, sf))
    return running(df, [], ops.CANONICAL, position=running_count()).select(
        "input_index", "position", "eff_source_ns", "eff_receive_ns"
    )


def _replay(spark, sf):
    return ops.with_replay_status(views.messages(spark, sf))


def replay_accepted(spark, sf):
    return ops.accepted(_replay(spark, sf)).select("input_index", "message_type", "sequence_num")


def replay_quarantine(spark, sf):
    return ops.quarantine(_replay(spark, sf)).select("input_index", "message_type", "reason")


def replay_strict_prefix(spark, sf):
    """A clean single-feed trade tape with one sequence gap after every 7000 messages."""
    tape = views.trades(spark, sf).selectExpr(
        "sequence_num input_index", "cast(3 as smallint) message_type", "1 version",
        "0L venue_id", "0L feed_id", "instrument_id + 1 instrument_id",
        "sequence_num + sequence_num div 7001 sequence_num", "source_timestamp_ns", "price",
        "quantity", "cast(aggressor_side as bigint) side", "0L last_included_sequence",
        *[f"0L {c}" for c in (
            "order_id", "best_bid_price", "best_bid_quantity", "best_ask_price",
            "best_ask_quantity", "bid_levels_count", "ask_levels_count", "status", "tick_size",
            "lot_size", "min_quantity", "max_quantity")],
    )
    return ops.strict_prefix(ops.with_replay_status(tape)).select("input_index", "message_type")


def replay_stop(spark, sf):
    df = ops.stop_at(views.arrivals(spark, sf), stop_ts=STOP_TS, max_events=500)
    return df.select("input_index", "source_timestamp_ns")


def replay_statistics(spark, sf):
    return ops.replay_statistics(_replay(spark, sf))


def replay_diagnostics(spark, sf):
    return ops.diagnostics(_replay(spark, sf))


def monotonic_check(spark, sf):
    return ops.first_time_regression(views.arrivals(spark, sf), "source_timestamp_ns", "input_index")


def timestamp_normalisation(spark, sf):
    texts = views.table(spark, sf, "events").selectExpr(
        "event_id",
        "concat(date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"),"
        " case event_id % 4 when 0 then 'Z' when 1 then '+05:30' when 2 then '-08:00' else '' end)"
        " text",
    )
    return ops.with_normal_timestamp(texts, "text")


def clock_audit(spark, sf):
    df = views.arrivals(spark, sf).selectExpr(
        "source_timestamp_ns ev", "receive_timestamp_ns av",
        "receive_timestamp_ns + (input_index % 7 - 1) * 1000 de",
        "receive_timestamp_ns + (input_index % 5) * 1000 ac",
        "receive_timestamp_ns + (input_index % 9) * 1000 fi",
    )
    return ops.clock_audit(
        df, {"event": "ev", "available": "av", "decision": "de", "actionable": "ac", "fill": "fi"}
    )


def content_digest(spark, sf):
    return ops.content_digest(views.trades(spark, sf))


# --- as-of ---------------------------------------------------------------------------------------


def _decisions(spark, sf):
    return views.trades(spark, sf).selectExpr(
        "instrument_id", "sequence_num", "source_timestamp_ns + 150000 decision_ts"
    )


_QUOTE_VALUES = ["receive_timestamp_ns", "best_bid_price", "best_ask_price"]


def asof_backward(spark, sf):
    return asof(
        _decisions(spark, sf), views.quotes(spark, sf), ["instrument_id"], "decision_ts",
        "receive_timestamp_ns", ["sequence_num"], ["sequence_num"], _QUOTE_VALUES, prefix="q_",
    )


def asof_staleness(spark, sf):
    return asof(
        _decisions(spark, sf), views.quotes(spark, sf), ["instrument_id"], "decision_ts",
        "receive_timestamp_ns", ["sequence_num"], ["sequence_num"], _QUOTE_VALUES, prefix="q_",
        max_staleness=STALENESS_NS,
    )


def asof_forward(spark, sf):
    d = _decisions(spark, sf).withColumn("target_ts", F.col("decision_ts") + HORIZON_NS)
    return asof(
        d, views.trades(spark, sf), ["instrument_id"], "target_ts", "source_timestamp_ns",
        ["sequence_num"], ["sequence_num"], ["source_timestamp_ns", "price"], forward=True,
        prefix="t_",
    )


def _status(rules, bad="0"):
    """Oracle side of a rule list, written out per message type in ``_VALIDATION``."""
    return "case " + " ".join(f"when {c} then {v}" for c, v in rules) + f" else {bad} end"


_VALIDATION = MESSAGES + f""", valid as (
 select *, {_status([
     ("version <> 1", 7), ("message_type <> 8 and instrument_id = 0", 1), ("sequence_num = 0", 6),
 ])} header_status,
 case message_type
  when 2 then {_status([
      ("best_bid_price < 0 or best_ask_price < 0", 3),
      ("best_bid_price > 0 and best_ask_price > 0 and best_bid_price > best_ask_price", 3),
      ("best_bid_price > 0 and best_bid_quantity = 0", 4),
      ("best_ask_price > 0 and best_ask_quantity = 0", 4)])}
  when 3 then {_status([("price <= 0", 3), ("quantity = 0", 4), ("side = 0", 8)])}
  when 4 then {_status([("order_id = 0", 8), ("price <= 0", 3), ("quantity = 0", 4),
                        ("side = 0", 8)])}
  when 5 then {_status([("order_id = 0", 8), ("price <= 0", 3)])}
  when 6 then {_status([("order_id = 0", 8)])}
  when 7 then {_status([("bid_levels_count > 10 or ask_levels_count > 10", 8)])}
  when 8 then {_status([("status = 0", 8)])}
  when 1 then {_status([("tick_size <= 0", 3),
                        ("lot_size = 0 or min_quantity = 0 or max_quantity < min_quantity", 4)])}
  end payload_status from messages),
validated as (select *, case when header_status <> 0 then header_status else payload_status end
 validation_status from valid)"""

_SEQ = ARRIVALS + """, seq0 as (
 select *, coalesce(max(sequence_num) over (partition by venue_id, feed_id order by input_index
  rows between unbounded preceding and 1 preceding), 0) previous_sequence from arrivals),
seq as (
 select *, case when sequence_num = previous_sequence + 1 then 'expected'
  when sequence_num > previous_sequence + 1 then 'gap'
  when sequence_num = previous_sequence then 'duplicate' else 'out_of_order' end sequence_status
 from seq0)"""


def _resync(src: str, good: str, counted: str) -> str:
    feed = "partition by venue_id, feed_id"
    upto = "rows between unbounded preceding and"
    return f"""seg as (
 select *, count(*) filter ({good} and message_type = 7 and last_included_sequence > 0) over w
   segment,
  coalesce(last_value(case when {good} and message_type = 7 and last_included_sequence > 0
   then last_included_sequence end ignore nulls) over w, 0) base
 from {src} window w as ({feed} order by input_index {upto} current row)),
segm as (
 select *, greatest(base, coalesce(max(case when {counted} then sequence_num end)
  over ({feed}, segment order by input_index {upto} 1 preceding), base)) m from seg),
resync as (
 select *, case when not ({counted}) then null when sequence_num = m + 1 then 'expected'
  when sequence_num > m + 1 then 'gap' when sequence_num = m then 'duplicate'
  else 'out_of_order' end sequence_status from segm)"""


_REPLAY = _VALIDATION + ", " + _resync(
    "validated", "validation_status = 0", "validation_status = 0 and message_type <> 7"
) + """, replay as (
 select *, case when header_status <> 0 then 'header' when payload_status <> 0 then 'payload'
  when sequence_status in ('duplicate', 'out_of_order') then sequence_status end reason
 from resync)"""

_CANON = ARRIVALS + """, canon as (
 select *, max(source_timestamp_ns) over w eff_source_ns,
  max(receive_timestamp_ns) over w eff_receive_ns from arrivals
 window w as (partition by venue_id, feed_id order by sequence_num, input_index
  rows unbounded preceding))"""

_DECISIONS = f"""with {QUOTES}, {TRADES}, d as (
 select instrument_id, sequence_num, source_timestamp_ns + 150000 decision_ts from trades),
 qu as (select instrument_id, receive_timestamp_ns, arg_max(best_bid_price, sequence_num)
  best_bid_price, arg_max(best_ask_price, sequence_num) best_ask_price from quotes group by 1, 2)"""

QUERIES = {
    f.__name__: f
    for f in (
        message_validation, sequence_status, snapshot_resync, sequence_gaps, sequence_summary,
        canonical_order, replay_accepted, replay_quarantine, replay_strict_prefix, replay_stop,
        replay_statistics, replay_diagnostics, monotonic_check, timestamp_normalisation,
        clock_audit, content_digest, asof_backward, asof_staleness, asof_forward,
    )
}

ORACLES = {
    "content_digest": f"""with {TRADES}, hashed as (
 select cast('0x' || substr(md5(concat_ws('|', aggressor_side, instrument_id, price, quantity, receive_timestamp_ns,
  sequence_num, source_timestamp_ns)), 1, 15) as bigint) h from trades)
select count(*) n_rows, bit_xor(h) digest_xor, cast(sum(h % 1000003) as bigint) digest_sum from hashed""",
    "message_validation": f"with {_VALIDATION} select input_index, header_status, payload_status,"
    " validation_status from validated",
    "sequence_status": f"with {_SEQ} select venue_id, feed_id, input_index, sequence_num,"
    " previous_sequence, sequence_status from seq",
    "snapshot_resync": f"with {MESSAGES}, "
    + _resync("messages", "true", "message_type <> 7 and sequence_num > 0")
    + " select input_index, sequence_num, sequence_status from resync",
    "sequence_gaps": f"with {_SEQ} select venue_id, feed_id, input_index, previous_sequence + 1"
    " missing_from, sequence_num - 1 missing_to, sequence_num - previous_sequence - 1"
    " missing_count from seq where sequence_status = 'gap'",
    "sequence_summary": f"""with {_SEQ} select venue_id, feed_id,
 count(*) filter (sequence_status = 'gap') gap_count,
 count(*) filter (sequence_status in ('duplicate', 'out_of_order')) duplicate_count,
 count(*) filter (sequence_status = 'expected') expected_count,
 cast(coalesce(sum(sequence_num - previous_sequence - 1) filter (sequence_status = 'gap'), 0)
  as bigint) missing_count from seq group by 1, 2""",
    "canonical_order": f"with {_CANON} select input_index, eff_source_ns, eff_receive_ns,"
    " row_number() over (order by eff_source_ns, eff_receive_ns, venue_id, feed_id, sequence_num,"
    " input_index) as position from canon",
    "replay_accepted": f"with {_REPLAY} select input_index, cast(message_type as smallint)"
    " message_type, sequence_num from replay where reason is null",
    "replay_quarantine": f"with {_REPLAY} select input_index, cast(message_type as smallint)"
    " message_type, reason from replay where reason is not null",
    "replay_strict_prefix": f"""with {TRADES}, s as (
 select sequence_num input_index, sequence_num + sequence_num // 7001 seq from trades)
select input_index, cast(3 as smallint) message_type from s where input_index < (
 select coalesce(min(input_index), 9223372036854775807) from (
  select *, coalesce(max(seq) over (order by input_index rows between unbounded preceding
   and 1 preceding), 0) m from s) where seq > m + 1)""",
    "replay_stop": "with " + ARRIVALS + f""", kept as (
 select * from arrivals where source_timestamp_ns <= {STOP_TS}), canon as (
 select *, max(source_timestamp_ns) over w es, max(receive_timestamp_ns) over w er from kept
 window w as (partition by venue_id, feed_id order by sequence_num, input_index
  rows unbounded preceding))
select input_index, source_timestamp_ns from canon
 order by es, er, venue_id, feed_id, sequence_num, input_index limit 500""",
    "replay_statistics": f"""with {_REPLAY}, s as (select count(*) events_read,
 count(*) filter (reason is null) events_processed,
 count(*) filter (reason is not null) events_rejected,
 count(*) filter (validation_status <> 0) validation_failures,
 count(*) filter (sequence_status = 'gap') sequence_gaps,
 count(*) filter (sequence_status = 'duplicate') duplicates,
 count(*) filter (sequence_status = 'out_of_order') out_of_order,
 count(*) filter (reason is null and message_type = 7) snapshots,
 count(*) filter (reason is null and message_type in (4, 5, 6)) book_updates,
 count(*) filter (reason is null and message_type = 3) trades,
 min(source_timestamp_ns) filter (reason is null) first_timestamp_ns,
 max(source_timestamp_ns) filter (reason is null) last_timestamp_ns from replay)
select *, last_timestamp_ns - first_timestamp_ns elapsed_ns from s""",
    "replay_diagnostics": f"""with {_REPLAY} select input_index, sequence_num, source_timestamp_ns,
 instrument_id, cast(message_type as smallint) message_type, coalesce(reason, 'gap') reason,
 header_status, payload_status, sequence_status from replay
 where reason is not null or sequence_status = 'gap'""",
    "monotonic_check": f"""with {ARRIVALS}, p as (select *, lag(source_timestamp_ns)
 over (order by input_index) prev from arrivals)
select min(input_index) first_violation, count(*) violations from p
 where source_timestamp_ns < prev""",
    "timestamp_normalisation": """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
 || case event_id % 4 when 0 then 'Z' when 1 then '+05:30' when 2 then '-08:00' else '' end as text,
 case event_id % 4 when 0 then epoch_us(ts) * 1000 when 1 then (epoch_us(ts) - 19800000000) * 1000
  when 2 then (epoch_us(ts) + 28800000000) * 1000 end ts_ns from events""",
    "clock_audit": f"""with {ARRIVALS}, c as (select source_timestamp_ns ev,
 receive_timestamp_ns av, receive_timestamp_ns + (input_index % 7 - 1) * 1000 de,
 receive_timestamp_ns + (input_index % 5) * 1000 ac,
 receive_timestamp_ns + (input_index % 9) * 1000 fi from arrivals)
select count(*) n_rows, count(*) filter (ev > av) event_after_available,
 count(*) filter (av > de) available_after_decision,
 count(*) filter (de > ac) decision_after_actionable,
 count(*) filter (ac > fi) actionable_after_fill from c""",
    "asof_backward": _DECISIONS + """
select d.*, q.receive_timestamp_ns q_receive_timestamp_ns, q.best_bid_price q_best_bid_price,
 q.best_ask_price q_best_ask_price from d asof left join qu q
 on d.instrument_id = q.instrument_id and d.decision_ts >= q.receive_timestamp_ns""",
    "asof_staleness": _DECISIONS + f"""
select instrument_id, sequence_num, decision_ts,
 case when fresh then r end q_receive_timestamp_ns, case when fresh then b end q_best_bid_price,
 case when fresh then a end q_best_ask_price from (
 select d.*, q.receive_timestamp_ns r, q.best_bid_price b, q.best_ask_price a,
  d.decision_ts - q.receive_timestamp_ns <= {STALENESS_NS} fresh from d asof left join qu q
  on d.instrument_id = q.instrument_id and d.decision_ts >= q.receive_timestamp_ns)""",
    "asof_forward": _DECISIONS + f""", tr as (select instrument_id, source_timestamp_ns,
  arg_min(price, sequence_num) price from trades group by 1, 2),
 d2 as (select *, decision_ts + {HORIZON_NS} target_ts from d)
select d2.*, t.source_timestamp_ns t_source_timestamp_ns, t.price t_price from d2
 asof left join tr t on d2.instrument_id = t.instrument_id
 and d2.target_ts <= t.source_timestamp_ns""",
}
