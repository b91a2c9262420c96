"""Registered quoting queries with their DuckDB counterparts."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from tapeframe.operators import features as feat
from tapeframe.operators import quoting as ops
from tapeframe.plans.accounting import settled, walk_pnl
from tapeframe.plans.duck import QUOTES, TRADES
from tapeframe.plans.features import _QUOTE_CORE, CONFIG
from tapeframe.sources import views

DAY = 86400 * 10**9
LATENCY = 250_000
CONFIGS = [
    ops.QuotingConfig(config_id=1, max_long_inventory=6000, max_short_inventory=6000,
                      max_notional_exposure=900_000.0, max_volatility=1.2),
    ops.QuotingConfig(config_id=2, max_long_inventory=20000, max_short_inventory=20000,
                      use_optimal_spread=True, max_half_spread=0.6, max_notional_exposure=1e7,
                      max_ofi_magnitude=800.0, max_volatility=1.4, risk_aversion=0.002),
    ops.QuotingConfig(config_id=3, max_long_inventory=20000, max_short_inventory=20000,
                      require_microstructure_validity=True, max_notional_exposure=1e7,
                      max_depth_imbalance=0.0, max_vpin=0.0, max_volatility=0.0,
                      risk_aversion=0.001, tick_size=0.05),
    ops.QuotingConfig(config_id=4, risk_reduction_only=True, max_long_inventory=20000,
                      max_short_inventory=20000, stale_quote_timeout_ns=100_000,
                      max_market_spread=0.05, risk_aversion=0.0),
]


def _market(spark, sf):
    """Quotes with the maker's inventory; every print is one of its fills."""
    q = views.quotes(spark, sf)
    fills = views.trades(spark, sf).selectExpr(
        "instrument_id", "receive_timestamp_ns fill_ts", "sequence_num fill_seq",
        "if(aggressor_side = 1, quantity, -quantity) signed_quantity",
    )
    out = ops.inventory_as_of(
        q, fills, ["instrument_id"], "receive_timestamp_ns", "fill_ts", ["fill_seq"]
    )
    return out.withColumns(
        {"available_timestamp_ns": F.col("receive_timestamp_ns"),
         "decision_timestamp_ns": F.col("receive_timestamp_ns") + F.col("sequence_num") % 3 * 100_000}
    )


def _featured(spark, sf):
    # The feature columns are derived on the market rows themselves, so no join back is needed.
    m = _market(spark, sf)
    f = feat.with_spread_mid(feat.with_quote_validity(m))
    f = feat.with_rolling_ofi(feat.with_instant_ofi(f), CONFIG.ofi_window)
    f = feat.with_returns(f, CONFIG.return_lookback, CONFIG.volatility_window)
    f = f.withColumn("realized_volatility", F.round("realized_volatility", 9))
    return f.select(
        *m.columns, "rolling_ofi", F.col("rolling_ofi").isNotNull().alias("has_rolling_ofi"),
        "realized_volatility",
        F.col("realized_volatility").isNotNull().alias("has_realized_volatility"),
    )


def inventory_asof(spark, sf):
    return _market(spark, sf).select("instrument_id", "sequence_num", "inventory")


def maker_account_asof(spark, sf):
    """The maker's account at each quote; every print is one of its fills, at a fee per share."""
    fills = views.trades(spark, sf).selectExpr(
        "instrument_id", "receive_timestamp_ns fill_ts", "sequence_num fill_seq", "price",
        "if(aggressor_side = 1, quantity, -quantity) signed_quantity", "0.003D * quantity transaction_cost")
    out = ops.account_as_of(
        views.quotes(spark, sf), fills, ["instrument_id"], "receive_timestamp_ns", "fill_ts", ["fill_seq"], 1_000_000.0)
    money = ["cash", "average_entry_price", "realized_pnl", "unrealized_pnl"]
    return out.select("instrument_id", "sequence_num", "inventory", *[settled(c, 4) for c in money])


def reservation_price(spark, sf):
    df = ops.with_config(_market(spark, sf), CONFIGS[:1]).where(ops.usable_market())
    return ops.with_reservation_price(df, use_features=False).select(
        "instrument_id", "sequence_num", "mid_price", "reservation_price", "is_reservable"
    )


def raw_quotes(spark, sf):
    df = ops.with_config(_market(spark, sf), CONFIGS).where(ops.usable_market())
    df = ops.with_raw_quotes(ops.with_reservation_price(df, use_features=False))
    return df.select(
        "config_id", "instrument_id", "sequence_num",
        F.round("target_half_spread", 9).alias("target_half_spread"), "bid_ticks", "ask_ticks",
    )


def _decisions(spark, sf):
    return ops.quote_decisions(_featured(spark, sf), CONFIGS)


def quote_guards(spark, sf):
    return _decisions(spark, sf).select(
        "config_id", "instrument_id", "sequence_num", "bid_reason", "ask_reason",
        F.concat_ws(",", "reasons").alias("reasons"),
    )


def quote_decisions(spark, sf):
    d = _decisions(spark, sf).select(*ops.DECISION)
    return d.withColumns(
        {"target_half_spread": F.round("target_half_spread", 9),
         "bid_distance": F.round("bid_distance", 9), "ask_distance": F.round("ask_distance", 9),
         "reasons": F.concat_ws(",", "reasons")}
    )


def quote_order_intents(spark, sf):
    o = ops.order_intents(_decisions(spark, sf), LATENCY)
    return o.select(
        "config_id", "instrument_id", "sequence_num", "actionable_timestamp_ns", "side",
        "limit_price", "quantity",
    )


def rebalance_signals(spark, sf):
    s = ops.rebalance_signals(_market(spark, sf), CONFIGS)
    return s.withColumn("strength", F.round("strength", 9))


def feature_rebalance_signals(spark, sf):
    s = ops.feature_signals(_featured(spark, sf), CONFIGS)
    return s.withColumn("strength", F.round("strength", 9))


def suppression_report(spark, sf):
    return ops.suppression_report(_decisions(spark, sf), DAY)


def _config_rows(configs) -> str:
    rows = []
    for c in configs:
        vals = ", ".join(
            f"{str(v).lower()}" if isinstance(v, bool)
            else f"{v!r}::double" if isinstance(v, float) else str(v)
            for v in asdict(c).values()
        )
        rows.append(f"({vals})")
    return f"(values {', '.join(rows)}) c({', '.join(asdict(CONFIGS[0]))})"


_INV = """mm_fills as (
 select instrument_id, receive_timestamp_ns fill_ts, cast(sum(case when aggressor_side = 1
  then quantity else -quantity end) over (partition by instrument_id
  order by receive_timestamp_ns, sequence_num rows unbounded preceding) as bigint) inventory
 from trades),
market as (
 select q.*, coalesce(f.inventory, 0) inventory, q.receive_timestamp_ns available_timestamp_ns,
  q.receive_timestamp_ns + q.sequence_num % 3 * 100000 decision_timestamp_ns
 from {src} q asof left join mm_fills f on q.instrument_id = f.instrument_id
  and q.receive_timestamp_ns >= f.fill_ts)"""

_PLAIN = f"{QUOTES}, {TRADES}, " + _INV.format(src="quotes")
_FEATURED = f"{_QUOTE_CORE}, {TRADES}, " + _INV.format(src="qf")


def _decide(featured: bool, configs=tuple(CONFIGS)) -> str:
    vol = "coalesce(realized_volatility, volatility)" if featured else "volatility"
    flow = """
  case when max_ofi_magnitude > 0 and rolling_ofi is null and require_microstructure_validity
    then true else false end no_ofi,
  case when max_ofi_magnitude > 0 and abs(rolling_ofi) > max_ofi_magnitude then true
    else false end ofi_hit,
  require_microstructure_validity and (max_depth_imbalance > 0 or max_vpin > 0) no_rest""" if (
        featured) else "false no_ofi, false ofi_hit, false no_rest"
    ofi = "rolling_ofi" if featured else "0"
    return f"""m0 as (
 select *, (best_bid_price / price_scale + best_ask_price / price_scale) / 2.0::double mid,
  {vol} evol from market, {_config_rows(configs)}
 where best_bid_price > 0 and best_ask_price > 0 and best_bid_quantity > 0
  and best_ask_quantity > 0),
m1 as (
 select *, mid - inventory * risk_aversion * (evol * evol) * terminal_horizon * skew_factor r0,
  greatest(1, cast(round_even(tick_size * price_scale, 0) as bigint)) tick,
  case when use_optimal_spread then greatest(min_half_spread, least(max_half_spread,
   case when risk_aversion = 0 then 1.0::double / order_arrival_intensity
    else (1.0::double / risk_aversion) * ln(1.0::double + risk_aversion / order_arrival_intensity)
    end)) else half_spread end hs from m0),
m2 as (select *, r0 > 0 fine, case when r0 > 0 then r0 else mid end r from m1),
m3 as (
 select *, greatest(cast(floor(case when r - hs <= 0 then tick_size else r - hs end * price_scale
   / tick) as bigint) * tick, tick) bt0,
  greatest(cast(ceil((r + hs) * price_scale / tick) as bigint) * tick, tick) at0 from m2),
m4 as (
 select *, case when bt0 >= at0 then bt0 + tick else at0 end at1,
  stale_quote_timeout_ns > 0 and decision_timestamp_ns - available_timestamp_ns
   > stale_quote_timeout_ns stale,
  best_bid_price >= best_ask_price crossed,
  best_ask_price / price_scale - best_bid_price / price_scale > max_market_spread wide,
  min_displayed_depth > 0 and (best_bid_quantity < min_displayed_depth
   or best_ask_quantity < min_displayed_depth) thin,
  max_volatility > 0 and evol > max_volatility volatile_,
  {flow},
  risk_reduction_only and inventory = 0 flat_stop,
  inventory >= max_long_inventory or inventory + quote_size > max_long_inventory lh,
  inventory <= -max_short_inventory or inventory - quote_size < -max_short_inventory sh,
  abs(inventory) * mid >= max_notional_exposure nh from m3),
m5 as (
 select *, stale or crossed or wide or thin or volatile_ or no_ofi or no_rest or flat_stop stop_all,
  list_distinct_in_order from (select *, list_filter([case when stale
   then 'stale_market_data' end, case when crossed then 'crossed_or_locked_book' end,
   case when wide and not crossed then 'excessive_spread' end,
   case when thin then 'insufficient_depth' end,
   case when volatile_ then 'excessive_volatility' end,
   case when no_ofi or ofi_hit or no_rest then 'microstructure_imbalance' end,
   case when risk_reduction_only then 'risk_reduction_only' end,
   case when lh and not flat_stop then 'long_inventory_limit' end,
   case when sh and not flat_stop then 'short_inventory_limit' end,
   case when nh and not flat_stop then 'max_notional_exposure' end],
   lambda x: x is not null) list_distinct_in_order from m4)),
m6 as (
 select *, not (stop_all or (ofi_hit and {ofi} <= 0) or lh
   or ((risk_reduction_only or nh) and inventory >= 0)) bid_ok,
  not (stop_all or (ofi_hit and {ofi} > 0) or sh
   or ((risk_reduction_only or nh) and inventory <= 0)) ask_ok from m5),
dec as (
 select config_id, instrument_id, sequence_num, decision_timestamp_ns, mid mid_price,
  r reservation_price, fine is_reservable, case when fine then hs else half_spread end
   target_half_spread, inventory, max_long_inventory, max_short_inventory,
  case when fine then bt0 else 0 end bid_ticks, case when fine then at1 else 0 end ask_ticks,
  fine and bid_ok has_bid, fine and ask_ok has_ask,
  case when fine and bid_ok then quote_size else 0 end::bigint bid_quantity,
  case when fine and ask_ok then quote_size else 0 end::bigint ask_quantity,
  case when fine then round(mid - bt0 / price_scale, 9) else 0 end bid_distance,
  case when fine then round(at1 / price_scale - mid, 9) else 0 end ask_distance,
  case when not fine then 'invalid_reservation_price' when not bid_ok then coalesce(
   list_filter(list_distinct_in_order, lambda x: x in ('long_inventory_limit',
    'risk_reduction_only', 'max_notional_exposure'))[1], list_distinct_in_order[1],
   'invalid_market_data') end bid_reason,
  case when not fine then 'invalid_reservation_price' when not ask_ok then coalesce(
   list_filter(list_distinct_in_order, lambda x: x in ('short_inventory_limit',
    'risk_reduction_only', 'max_notional_exposure'))[1], list_distinct_in_order[1],
   'invalid_market_data') end ask_reason,
  case when fine then list_distinct_in_order else ['invalid_reservation_price'] end reasons,
  fine and (bid_ok or ask_ok) is_valid from m6),
sig as (
 select *, cast(case when is_valid then -sign(inventory) else 0 end as tinyint) direction,
  case when not is_valid then 0.0::double when inventory > 0
   then -least(1.0::double, inventory / max_long_inventory::double)
   when inventory < 0 then least(1.0::double, -inventory / max_short_inventory::double)
   else 0.0::double end target_weight,
  round(least(1.0::double, abs(reservation_price - mid_price) / target_half_spread), 9) strength,
  case when has_bid and has_ask then 1.0::double when is_valid then 0.5::double else 0.0::double end
   confidence from dec)"""


_DEC = f"with {_FEATURED}, {_decide(True)}"
_TABLE = f"with {_PLAIN}, {_decide(False)}"
_SIG = ("config_id, sequence_num, decision_timestamp_ns, instrument_id, direction, target_weight,"
        " strength, confidence, is_valid")

QUERIES = {
    f.__name__: f
    for f in (
        inventory_asof, maker_account_asof, reservation_price, raw_quotes, quote_guards, quote_decisions,
        quote_order_intents, rebalance_signals, feature_rebalance_signals, suppression_report,
    )
}

ORACLES = {
    "maker_account_asof": f"with recursive {QUOTES}, {TRADES}" + """, steps as (
 select instrument_id, sequence_num fill_seq, receive_timestamp_ns fill_ts, row_number() over (partition by instrument_id
  order by receive_timestamp_ns, sequence_num) rn, case when aggressor_side = 1 then quantity else -quantity end sq,
  price / 100.0::double px, price * quantity / 100.0::double notional, 0.003::double * quantity fee from trades),
""" + walk_pnl("steps", "instrument_id") + """, state as (
 select s.*, pos, entry, pnl, -cast(sum((sign(sq) * notional + fee)::decimal(38, 12)) over (partition by s.instrument_id order by s.rn) as double) flow
 from steps s join pnl using (instrument_id, rn)),
latest as (select instrument_id, fill_ts, max(rn) rn from state group by 1, 2),
seen as (
 select q.*, l.rn from quotes q asof left join latest l on q.instrument_id = l.instrument_id and q.receive_timestamp_ns >= l.fill_ts),
acc as (
 select q.instrument_id, q.sequence_num, coalesce(pos, 0) inventory, 1000000.0::double + coalesce(flow, 0) cash, coalesce(entry, 0) entry,
  coalesce(pnl, 0) pnl, best_bid_price > 0 and best_ask_price > 0 ok, (best_bid_price + best_ask_price) / 200.0::double mid
 from seen q left join state s on s.instrument_id = q.instrument_id and s.rn = q.rn)
select instrument_id, sequence_num, cast(inventory as bigint) inventory, round(cash::decimal(38, 6), 4)::double cash, round(entry::decimal(38, 6), 4)::double average_entry_price,
 round(pnl::decimal(38, 6), 4)::double realized_pnl, round((case when ok and inventory <> 0 then inventory * (mid - entry) else 0 end)::decimal(38, 6), 4)::double unrealized_pnl from acc""",
    "inventory_asof": f"with {_PLAIN} select instrument_id, sequence_num, inventory from market",
    "reservation_price": _TABLE + " select instrument_id, sequence_num, mid_price,"
    " reservation_price, is_reservable from dec where config_id = 1",
    "raw_quotes": _TABLE + " select config_id, instrument_id, sequence_num, round(hs, 9)"
    " target_half_spread, bt0 bid_ticks, at1 ask_ticks from m4",
    "quote_guards": _DEC + " select config_id, instrument_id, sequence_num, bid_reason, ask_reason,"
    " array_to_string(reasons, ',') reasons from dec",
    "quote_decisions": _DEC + """ select config_id, instrument_id, sequence_num,
 decision_timestamp_ns, mid_price, reservation_price, round(target_half_spread, 9)
 target_half_spread, inventory, bid_ticks, bid_quantity, bid_distance, bid_reason, ask_ticks,
 ask_quantity, ask_distance, ask_reason, is_valid, array_to_string(reasons, ',') reasons
 from dec""",
    "quote_order_intents": _DEC + f""" select config_id, instrument_id, sequence_num,
 decision_timestamp_ns + {LATENCY} actionable_timestamp_ns, 'buy' side, bid_ticks limit_price,
 bid_quantity quantity from dec where has_bid
union all select config_id, instrument_id, sequence_num, decision_timestamp_ns + {LATENCY}, 'sell',
 ask_ticks, ask_quantity from dec where has_ask""",
    "rebalance_signals": _TABLE + f""" select {_SIG} from sig
union all select config_id, sequence_num, decision_timestamp_ns, instrument_id,
 cast(0 as tinyint), 0.0::double, 0.0::double, 0.0::double, false from market,
 (select unnest([{', '.join(str(c.config_id) for c in CONFIGS)}]) config_id)
 where not (best_bid_price > 0 and best_ask_price > 0 and best_bid_quantity > 0
  and best_ask_quantity > 0)""",
    "feature_rebalance_signals": _DEC + f" select {_SIG} from sig",
    "suppression_report": _DEC + f""", e as (select config_id, instrument_id,
 decision_timestamp_ns // {DAY} * {DAY} bucket_ns, unnest(reasons) reason from dec)
select config_id, instrument_id, bucket_ns, reason, count(*) n_decisions from e
 group by rollup(config_id, instrument_id, bucket_ns, reason)""",
}
