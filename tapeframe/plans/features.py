"""Registered feature queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeframe.contracts import FEATURE_COLUMNS, FEATURE_FLAGS
from tapeframe.operators import features as ops
from tapeframe.plans import stored
from tapeframe.plans.duck import ARRIVALS, QUOTES, TRADES, VALID_QUOTES
from tapeframe.session import fresh_folder
from tapeframe.sources import views

IDS = ["instrument_id", "sequence_num"]
CONFIG = ops.FeatureConfig()


def _round(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def quote_validity(spark, sf):
    return ops.with_quote_validity(views.quotes(spark, sf)).select(
        *IDS, "has_bid", "has_ask", "is_crossed"
    )


def spread_mid(spark, sf):
    q = ops.with_spread_mid(ops.with_quote_validity(views.quotes(spark, sf)))
    return q.select(*IDS, "spread", "mid_price", "relative_spread")


def weighted_mid(spark, sf):
    q = ops.with_weighted_mid(ops.with_quote_validity(views.quotes(spark, sf)))
    return q.select(*IDS, "weighted_mid_price", "book_imbalance_top")


def instant_ofi(spark, sf):
    q = ops.with_instant_ofi(ops.with_quote_validity(views.quotes(spark, sf)))
    return q.select(*IDS, "instant_ofi")


def rolling_ofi(spark, sf):
    q = ops.with_instant_ofi(ops.with_quote_validity(views.quotes(spark, sf)))
    return ops.with_rolling_ofi(q, CONFIG.ofi_window).select(*IDS, "instant_ofi", "rolling_ofi")


def returns_volatility(spark, sf):
    q = ops.with_spread_mid(ops.with_quote_validity(views.quotes(spark, sf)))
    q = ops.with_returns(q, CONFIG.return_lookback, CONFIG.volatility_window)
    return _round(q.select(*IDS, "log_return", "realized_volatility"),
                  "log_return", "realized_volatility")


def trade_flow(spark, sf):
    t = ops.with_trade_flow(views.trades(spark, sf), CONFIG.trade_window)
    return t.select(
        *IDS, "last_signed_volume", "rolling_trade_volume", "rolling_buy_volume",
        "rolling_sell_volume", "trade_flow_imbalance", "rolling_vwap", "has_trade_flow",
    )


def roll_spread(spark, sf):
    t = ops.with_roll_spread(views.trades(spark, sf), CONFIG.roll_window)
    return _round(t.select(*IDS, "roll_spread"), "roll_spread")


def volume_buckets(spark, sf):
    return ops.volume_buckets(views.trades(spark, sf), CONFIG.vpin_bucket_volume)


def vpin(spark, sf):
    t = ops.with_vpin(views.trades(spark, sf), CONFIG.vpin_bucket_volume, CONFIG.vpin_num_buckets)
    return t.select(*IDS, "vpin")


def availability_clock(spark, sf):
    return ops.with_availability(views.arrivals(spark, sf)).select(
        "input_index", "source_timestamp_ns", "receive_timestamp_ns", "decision_timestamp_ns"
    )


def late_event_drop(spark, sf):
    return ops.drop_late(views.arrivals(spark, sf)).select(
        "instrument_id", "input_index", "source_timestamp_ns"
    )


def stored_feature_audit(spark, sf):
    """Tape to features to leakage audit to stored dataset; the stored rows' audit counts."""
    root = fresh_folder(spark, "features")
    summary = stored.extract_and_store(views.quotes(spark, sf), root, "features", CONFIG)
    return summary.select("n_rows", "lookahead_rows", "acausal_rows")


ROUNDED = ["log_return", "realized_volatility", "roll_spread"]


def quote_feature_table(spark, sf):
    return _round(ops.extract_features(views.quotes(spark, sf), CONFIG), *ROUNDED)


def trade_feature_table(spark, sf):
    return _round(ops.extract_features(views.trades(spark, sf), CONFIG), *ROUNDED)


def unified_feature_timeline(spark, sf):
    both = ops.unified_timeline(views.quotes(spark, sf), views.trades(spark, sf), CONFIG)
    return _round(both, *ROUNDED)


def feature_coverage(spark, sf):
    return ops.feature_coverage(ops.extract_features(views.quotes(spark, sf), CONFIG))


W = "partition by instrument_id order by source_timestamp_ns, sequence_num"

_QUOTE_CORE = VALID_QUOTES + f""", prev as (
 select *, lag(is_valid) over w pv, lag(best_bid_price) over w pbp,
  lag(best_bid_quantity) over w pbq, lag(best_ask_price) over w pap, lag(best_ask_quantity) over w paq
 from vq window w as ({W})),
ofi as (
 select *, case when is_valid and pv then
   (case when best_bid_price > pbp then best_bid_quantity
         when best_bid_price = pbp then best_bid_quantity - pbq else -pbq end)
   + (case when best_ask_price < pap then -best_ask_quantity
           when best_ask_price = pap then paq - best_ask_quantity else paq end) end instant_ofi,
  case when is_valid then best_ask_price - best_bid_price end spread,
  case when is_valid then (best_bid_price + best_ask_price) / 2.0::double end mid_price,
  case when is_valid then (best_bid_price * best_ask_quantity + best_ask_price * best_bid_quantity)
    ::double / (best_bid_quantity + best_ask_quantity) end weighted_mid_price,
  case when is_valid then (best_bid_quantity - best_ask_quantity)::double
    / (best_bid_quantity + best_ask_quantity) end book_imbalance_top
 from prev),
roll_ofi as (
 select *, case when instant_ofi is not null
   and count(*) over w = {CONFIG.ofi_window} then cast(sum(instant_ofi) over w as bigint)
   end rolling_ofi
 from ofi window w as (partition by instrument_id, instant_ofi is not null
  order by source_timestamp_ns, sequence_num rows {CONFIG.ofi_window - 1} preceding)),
rets as (
 select *, case when mid_price is not null then ln(mid_price / lag(mid_price) over w) end ret
 from roll_ofi window w as (partition by instrument_id, mid_price is not null
  order by source_timestamp_ns, sequence_num)),
vols as (
 select *, case when count(ret) over w = {CONFIG.volatility_window}
   then stddev_samp(ret) over w end vol
 from rets window w as (partition by instrument_id, mid_price is not null
  order by source_timestamp_ns, sequence_num rows {CONFIG.volatility_window - 1} preceding)),
qf as (
 select *, round(last_value(ret ignore nulls) over w, 9) log_return,
  round(last_value(vol ignore nulls) over w, 9) realized_volatility
 from vols window w as ({W} rows between unbounded preceding and current row))"""

_TW = CONFIG.trade_window
_RN = CONFIG.roll_window
_BV = CONFIG.vpin_bucket_volume
_NB = CONFIG.vpin_num_buckets

_TRADE_FLOW = TRADES + f""", tf0 as (
 select *, case when aggressor_side = 1 then quantity else -quantity end last_signed_volume,
  cast(sum(quantity) over w as bigint) rolling_trade_volume,
  cast(sum(case when aggressor_side = 1 then quantity else 0 end) over w as bigint)
   rolling_buy_volume,
  cast(sum(case when aggressor_side = 2 then quantity else 0 end) over w as bigint)
   rolling_sell_volume,
  cast(sum(price * quantity) over w as bigint) notional, count(*) over w seen
 from trades window w as ({W} rows {_TW - 1} preceding)),
tf as (
 select *, (rolling_buy_volume - rolling_sell_volume)::double / rolling_trade_volume
   trade_flow_imbalance,
  notional::double / rolling_trade_volume rolling_vwap, seen = {_TW} has_trade_flow from tf0)"""

_ROLL = f"""rd as (
 select *, price - lag(price) over ({W}) d from tf),
ra as (
 select *, list(d) over ({W} rows {_RN - 1} preceding) ds from rd),
rg as (
 select *, case when count(d) over ({W} rows {_RN - 1} preceding) = {_RN} then
  ({_RN * _RN}::hugeint * list_sum(list_transform(range(2, {_RN + 1}), lambda i: ds[i] * ds[i - 1]))
   - {_RN} * list_sum(ds) * (2 * list_sum(ds) - ds[1] - ds[{_RN}])
   + {_RN - 1} * list_sum(ds) * list_sum(ds))::double / ({_RN * _RN * (_RN - 1)}.0::double) end gamma
 from ra),
rs as (
 select *, case when gamma < 0 then round(2 * sqrt(-gamma), 9) end roll_spread from rg)"""

_BUCKETS = f"""cum as (
 select *, cast(sum(quantity) over ({W} rows unbounded preceding) as bigint) c from {{src}}),
pieces as (
 select instrument_id, b bucket,
  least(c, (b + 1) * {_BV}) - greatest(c - quantity, b * {_BV}) share, aggressor_side
 from (select instrument_id, c, quantity, aggressor_side,
   unnest(range((c - quantity) // {_BV}, (c - 1) // {_BV} + 1)) b from cum)),
buckets as (
 select instrument_id, bucket, cast(sum(share) as bigint) volume,
  cast(abs(sum(case when aggressor_side = 1 then share else -share end)) as bigint) imbalance
 from pieces group by 1, 2 having sum(share) = {_BV})"""

_VPIN = _BUCKETS + f""", toxic as (
 select instrument_id, bucket, case when count(*) over w = {_NB}
   then sum(imbalance) over w / ({_NB * _BV}.0::double) end vpin
 from buckets window w as (partition by instrument_id order by bucket rows {_NB - 1} preceding)),
tv as (
 select cum.*, toxic.vpin from cum left join toxic
  on cum.instrument_id = toxic.instrument_id and cum.c // {_BV} - 1 = toxic.bucket)"""

_TRADE_ALL = _TRADE_FLOW + ", " + _ROLL + ", " + _VPIN.format(src="rs")


def _contract(src: str, given: set[str], flags: dict[str, str]) -> str:
    cols = []
    for c, t in FEATURE_COLUMNS.items():
        if c == "event_timestamp_ns":
            cols.append("source_timestamp_ns event_timestamp_ns")
        elif c == "source_timestamp_ns":
            cols.append("receive_timestamp_ns source_timestamp_ns")
        elif c == "decision_timestamp_ns":
            cols.append("greatest(source_timestamp_ns, receive_timestamp_ns) decision_timestamp_ns")
        elif c in FEATURE_FLAGS:
            default = f"{FEATURE_FLAGS[c]} is not null" if FEATURE_FLAGS[c] in given else "false"
            cols.append(f"coalesce({flags.get(c, default)}, false) {c}")
        elif c in given or c in ("instrument_id", "sequence_num"):
            gate = {"best_bid_price": "has_bid", "best_bid_quantity": "has_bid",
                    "best_ask_price": "has_ask", "best_ask_quantity": "has_ask"}.get(c)
            cols.append(f"cast({f'case when {gate} then {c} end' if gate else c} as {t}) {c}")
        else:
            cols.append(f"cast(null as {t}) {c}")
    return f"select {', '.join(cols)} from {src}"


_QUOTE_VALUES = {
    "best_bid_price", "best_bid_quantity", "best_ask_price", "best_ask_quantity", "spread",
    "relative_spread", "mid_price", "weighted_mid_price", "book_imbalance_top", "instant_ofi",
    "rolling_ofi", "log_return", "realized_volatility",
}
_TRADE_VALUES = {
    "last_signed_volume", "rolling_trade_volume", "rolling_buy_volume", "rolling_sell_volume",
    "trade_flow_imbalance", "rolling_vwap", "roll_spread", "vpin",
}
_QUOTE_TABLE = _contract(
    "(select *, spread / mid_price relative_spread from qf)", _QUOTE_VALUES,
    {"has_bid": "has_bid", "has_ask": "has_ask", "is_crossed": "is_crossed"},
)
_TRADE_TABLE = _contract("tv", _TRADE_VALUES, {"has_trade_flow": "has_trade_flow"})


def _unified() -> str:
    book = ["best_bid_price", "best_bid_quantity", "best_ask_price", "best_ask_quantity", "spread",
            "relative_spread", "mid_price", "weighted_mid_price", "book_imbalance_top",
            "has_bid", "has_ask", "is_crossed", "has_spread", "has_mid", "has_weighted_mid",
            "has_book_imbalance", "log_return", "realized_volatility", "has_log_return",
            "has_realized_volatility"]
    flow = sorted(_TRADE_VALUES) + ["has_trade", "has_trade_flow", "has_vwap", "has_roll_spread",
                                    "has_vpin"]
    cols = []
    for c in FEATURE_COLUMNS:
        flag = "coalesce({}, false)" if c in FEATURE_FLAGS else "{}"
        if c in book or c in flow:
            side = "bk" if c in book else "fl"
            cols.append(flag.format(f"{side}.{c}") + f" {c}")
        elif c == "rolling_ofi":
            cols.append("case when rk = 0 then rolling_ofi else ofi_seen end rolling_ofi")
        elif c == "has_rolling_ofi":
            cols.append("(case when rk = 0 then rolling_ofi else ofi_seen end) is not null"
                        " has_rolling_ofi")
        else:
            cols.append(c)

    def pack(names):
        return "{" + ", ".join(f"'{n}': {n}" for n in names) + "}"

    core = _QUOTE_CORE + ", " + _TRADE_ALL
    return f"""with {core},
both_sides as (select *, 0 rk from ({_QUOTE_TABLE}) union all select *, 1 rk from ({_TRADE_TABLE})),
filled as (
 select *, last_value(case when rk = 0 then {pack(book)} end ignore nulls) over w bk,
  last_value(case when rk = 1 then {pack(flow)} end ignore nulls) over w fl,
  last_value(rolling_ofi ignore nulls) over w ofi_seen
 from both_sides window w as (partition by instrument_id
  order by event_timestamp_ns, rk, sequence_num rows between unbounded preceding and current row))
select {', '.join(cols)} from filled"""


def _coverage() -> str:
    shares = ", ".join(
        f"sum({f}::bigint)::double / count(*) share_{f}" for f in FEATURE_FLAGS
    )
    return (f"with {_QUOTE_CORE} select instrument_id, count(*) n_rows, {shares}"
            f" from ({_QUOTE_TABLE}) group by 1")


QUERIES = {
    f.__name__: f
    for f in (
        quote_validity, spread_mid, weighted_mid, instant_ofi, rolling_ofi, returns_volatility,
        trade_flow, roll_spread, volume_buckets, vpin, availability_clock, late_event_drop,
        quote_feature_table, trade_feature_table, unified_feature_timeline, feature_coverage,
        stored_feature_audit,
    )
}

ORACLES = {
    "quote_validity": f"with {VALID_QUOTES} select instrument_id, sequence_num, has_bid, has_ask,"
    " is_crossed from vq",
    "spread_mid": f"with {_QUOTE_CORE} select instrument_id, sequence_num, spread, mid_price,"
    " spread / mid_price relative_spread from ofi",
    "weighted_mid": f"with {_QUOTE_CORE} select instrument_id, sequence_num, weighted_mid_price,"
    " book_imbalance_top from ofi",
    "instant_ofi": f"with {_QUOTE_CORE} select instrument_id, sequence_num, instant_ofi from ofi",
    "rolling_ofi": f"with {_QUOTE_CORE} select instrument_id, sequence_num, instant_ofi,"
    " rolling_ofi from roll_ofi",
    "returns_volatility": f"with {_QUOTE_CORE} select instrument_id, sequence_num, log_return,"
    " realized_volatility from qf",
    "trade_flow": f"with {_TRADE_FLOW} select instrument_id, sequence_num, last_signed_volume,"
    " rolling_trade_volume, rolling_buy_volume, rolling_sell_volume, trade_flow_imbalance,"
    " rolling_vwap, has_trade_flow from tf",
    "roll_spread": f"with {_TRADE_FLOW}, {_ROLL} select instrument_id, sequence_num, roll_spread"
    " from rs",
    "volume_buckets": f"with {TRADES}, {_BUCKETS.format(src='trades')} select * from buckets",
    "vpin": f"with {TRADES}, {_VPIN.format(src='trades')} select instrument_id, sequence_num, vpin"
    " from tv",
    "availability_clock": f"with {ARRIVALS} select input_index, source_timestamp_ns,"
    " receive_timestamp_ns, greatest(source_timestamp_ns, receive_timestamp_ns)"
    " decision_timestamp_ns from arrivals",
    "late_event_drop": f"""with {ARRIVALS}, seen as (
 select *, max(source_timestamp_ns) over (partition by instrument_id order by input_index
  rows between unbounded preceding and 1 preceding) m from arrivals)
select instrument_id, input_index, source_timestamp_ns from seen
 where m is null or source_timestamp_ns >= m""",
    "quote_feature_table": f"with {_QUOTE_CORE} {_QUOTE_TABLE}",
    "trade_feature_table": f"with {_TRADE_ALL} {_TRADE_TABLE}",
    "unified_feature_timeline": _unified(),
    "feature_coverage": _coverage(),
    "stored_feature_audit": f"""with {QUOTES} select count(*) n_rows,
 count(*) filter (receive_timestamp_ns > greatest(source_timestamp_ns, receive_timestamp_ns))
  lookahead_rows,
 count(*) filter (source_timestamp_ns > receive_timestamp_ns) acausal_rows from quotes""",
}
