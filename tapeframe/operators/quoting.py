"""Inventory-aware quote tables for a market maker, as column expressions over a quote tape.

Configuration travels as columns, so one pass prices every configuration of a sweep; with a single
configuration the columns are literals and fold into the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.operators.asof import asof
from tapeframe.operators.ledger import MONEY, average_cost, sweep
from tapeframe.operators.scan import running, running_sum


@dataclass(frozen=True)
class QuotingConfig:
    """Quoting parameters; guards with a non-positive limit are off."""

    config_id: int = 1
    tick_size: float = 0.01
    price_scale: float = 100.0
    quote_size: int = 100
    risk_aversion: float = 0.1
    volatility: float = 0.02
    terminal_horizon: float = 1.0
    half_spread: float = 0.05
    min_half_spread: float = 0.01
    max_half_spread: float = 1.0
    order_arrival_intensity: float = 1.5
    use_optimal_spread: bool = False
    max_long_inventory: int = 1000
    max_short_inventory: int = 1000
    max_notional_exposure: float = 100_000.0
    skew_factor: float = 1.0
    risk_reduction_only: bool = False
    stale_quote_timeout_ns: int = 5_000_000_000
    max_market_spread: float = 2.0
    min_displayed_depth: int = 100
    max_volatility: float = 0.50
    max_ofi_magnitude: float = 10_000.0
    max_depth_imbalance: float = 0.90
    max_vpin: float = 0.80
    require_microstructure_validity: bool = False

    def __post_init__(self):
        if self.tick_size <= 0 or self.price_scale <= 0:
            raise ValueError("tick_size and price_scale must be positive")
        if self.order_arrival_intensity <= 0 or self.min_half_spread <= 0:
            raise ValueError("arrival intensity and minimum half-spread must be positive")
        if self.max_half_spread < self.min_half_spread:
            raise ValueError("max_half_spread cannot be less than min_half_spread")
        for name in ("risk_aversion", "volatility", "terminal_horizon", "skew_factor"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} cannot be negative")


# Suppression reasons.
INVALID_MARKET_DATA = "invalid_market_data"
CROSSED = "crossed_or_locked_book"
STALE = "stale_market_data"
WIDE = "excessive_spread"
THIN = "insufficient_depth"
VOLATILE = "excessive_volatility"
FLOW = "microstructure_imbalance"
LONG_LIMIT = "long_inventory_limit"
SHORT_LIMIT = "short_inventory_limit"
NOTIONAL = "max_notional_exposure"
BAD_RESERVATION = "invalid_reservation_price"
REDUCE_ONLY = "risk_reduction_only"

FEATURES = {
    "has_realized_volatility": "boolean", "realized_volatility": "double",
    "has_rolling_ofi": "boolean", "rolling_ofi": "bigint",
    "has_depth_imbalance": "boolean", "depth_imbalance_k": "double",
    "has_vpin": "boolean", "vpin": "double",
}


def with_config(df: DataFrame, configs: Sequence[QuotingConfig]) -> DataFrame:
    if len(configs) == 1:
        return df.withColumns({k: F.lit(v) for k, v in asdict(configs[0]).items()})
    return sweep(df, [asdict(c) for c in configs])


def inventory_as_of(
    quotes: DataFrame, fills: DataFrame, keys: Sequence[str], quote_ts: str, fill_ts: str,
    fill_order: Sequence[str],
) -> DataFrame:
    """Signed position, fills up to each quote's time included; 0 before the first fill."""
    pos = running(fills, list(keys), [fill_ts, *fill_order], inventory=running_sum("signed_quantity"))
    out = asof(
        quotes, pos.withColumn("__at", F.col(fill_ts)), keys, quote_ts, "__at", ["sequence_num"],
        list(fill_order), ["inventory"],
    )
    return out.na.fill(0, ["inventory"])


def account_as_of(
    quotes: DataFrame, fills: DataFrame, keys: Sequence[str], quote_ts: str, fill_ts: str,
    fill_order: Sequence[str], initial_cash: float = 0.0, price_scale: float = 100.0,
) -> DataFrame:
    """The maker's account at each quote: inventory, cash, average entry price, realised and unrealised profit.

    ``fills`` needs signed_quantity, price and transaction_cost; fills up to the quote's time count. Cash
    pays notional and costs; profit is marked at the quote's mid where both sides have a price.
    """
    order = [fill_ts, *fill_order]
    notional = F.col("signed_quantity") * F.col("price") / price_scale
    state = average_cost(fills, order, keys, price_scale)
    state = running(
        state, list(keys), order, inventory=running_sum("signed_quantity"),
        __paid=running_sum((notional + F.col("transaction_cost")).cast(MONEY)),
    ).withColumns({"cash_flow": -F.col("__paid").cast("double"), "__at": F.col(fill_ts)})
    values = ["inventory", "cash_flow", "average_entry_price", "realized_pnl"]
    out = asof(quotes, state, keys, quote_ts, "__at", ["sequence_num"], list(fill_order), values).na.fill(0, values)
    both = (F.col("best_bid_price") > 0) & (F.col("best_ask_price") > 0)
    mid = (F.col("best_bid_price") + F.col("best_ask_price")) / (2.0 * price_scale)
    gain = F.col("inventory") * (mid - F.col("average_entry_price"))
    return out.withColumns(
        {"cash": F.lit(initial_cash) + F.col("cash_flow"),
         "unrealized_pnl": F.when(both & (F.col("inventory") != 0), gain).otherwise(0.0)}
    ).drop("cash_flow")


# --- price model -------------------------------------------------------------------------------


def mid_dollars() -> Column:
    return F.expr("(best_bid_price / price_scale + best_ask_price / price_scale) / 2.0D")


def effective_volatility(use_features: bool) -> Column:
    if not use_features:
        return F.col("volatility")
    return F.expr("if(has_realized_volatility, coalesce(realized_volatility, volatility), volatility)")


def with_reservation_price(df: DataFrame, use_features: bool = True) -> DataFrame:
    """Mid shifted against inventory; ``is_reservable`` is false when the shift leaves no price."""
    df = df.withColumns(
        {"mid_price": mid_dollars(), "effective_volatility": effective_volatility(use_features)}
    )
    shifted = F.expr(
        "mid_price - inventory * risk_aversion * (effective_volatility * effective_volatility)"
        " * terminal_horizon * skew_factor"
    )
    df = df.withColumn("__r", shifted).withColumn(
        "is_reservable", F.expr("__r > 0 and not isnan(__r) and __r < double('infinity')")
    )
    return df.withColumn(
        "reservation_price", F.expr("if(is_reservable, __r, mid_price)")
    ).drop("__r")


def half_spread() -> Column:
    """Fixed, or ln(1 + gamma / kappa) / gamma (1 / kappa at gamma 0) between its bounds."""
    best = """if(risk_aversion = 0, 1.0D / order_arrival_intensity,
        try_divide(1.0D, risk_aversion) * ln(1.0D + risk_aversion / order_arrival_intensity))"""
    return F.expr(
        f"if(use_optimal_spread, greatest(min_half_spread, least(max_half_spread, {best})),"
        " half_spread)"
    )


def with_raw_quotes(df: DataFrame) -> DataFrame:
    """Tick-rounded bid (down) and ask (up), at least one tick, the ask pushed off the bid."""
    df = df.withColumns(
        {
            "target_half_spread": half_spread(),
            "__tick": F.expr("greatest(1L, cast(bround(tick_size * price_scale) as bigint))"),
        }
    )
    df = df.withColumn(
        "__raw_bid",
        F.expr("if(reservation_price - target_half_spread <= 0, tick_size,"
               " reservation_price - target_half_spread)"),
    )
    df = df.withColumns(
        {
            "bid_ticks": F.expr("greatest(floor(__raw_bid * price_scale / __tick) * __tick, __tick)"),
            "__ask": F.expr(
                "greatest(ceil((reservation_price + target_half_spread) * price_scale / __tick)"
                " * __tick, __tick)"
            ),
        }
    )
    df = df.withColumn("ask_ticks", F.expr("if(bid_ticks >= __ask, bid_ticks + __tick, __ask)"))
    return df.withColumns(
        {
            "bid_distance": F.expr("mid_price - bid_ticks / price_scale"),
            "ask_distance": F.expr("ask_ticks / price_scale - mid_price"),
        }
    ).drop("__tick", "__raw_bid", "__ask")


# --- guards ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Guard:
    """SQL conditions that stop the bid, stop the ask, and the reasons to report, in order."""

    stop_bid: str
    stop_ask: str
    reasons: tuple[tuple[str, str], ...]


def _both(*reasons: tuple[str, str]) -> Guard:
    stop = " or ".join(f"({c})" for c, _ in reasons)
    return Guard(stop, stop, reasons)


STALE_GUARD = _both(
    ("stale_quote_timeout_ns > 0"
     " and decision_timestamp_ns - available_timestamp_ns > stale_quote_timeout_ns", STALE)
)
SPREAD_GUARD = _both(
    ("best_bid_price >= best_ask_price", CROSSED),
    ("best_bid_price < best_ask_price and best_ask_price / price_scale"
     " - best_bid_price / price_scale > max_market_spread", WIDE),
)
DEPTH_GUARD = _both(
    ("min_displayed_depth > 0 and (best_bid_quantity < min_displayed_depth"
     " or best_ask_quantity < min_displayed_depth)", THIN)
)
VOLATILITY_GUARD = _both(("max_volatility > 0 and effective_volatility > max_volatility", VOLATILE))


def flow_guard() -> Guard:
    """Strong buying stops the ask, strong selling the bid, toxic volume both.

    Under strict validity a missing measure stops both sides and ends the check, so later measures
    are not looked at.
    """
    def seen(value, flag):
        return f"(coalesce({flag}, false) and {value} is not null)"

    def missing(value, flag, limit):
        return f"({limit} > 0 and require_microstructure_validity and not {seen(value, flag)})"

    def beyond(value, flag, limit):
        return f"({limit} > 0 and {seen(value, flag)} and coalesce(abs({value}) > {limit}, false))"

    ofi = ("rolling_ofi", "has_rolling_ofi", "max_ofi_magnitude")
    depth = ("depth_imbalance_k", "has_depth_imbalance", "max_depth_imbalance")
    vpin = ("vpin", "has_vpin", "max_vpin")
    no_ofi, no_depth = missing(*ofi), missing(*depth)
    strict = f"({no_ofi} or {no_depth} or {missing(*vpin)})"
    ofi_hit = beyond(*ofi)
    depth_hit = f"(not {no_ofi} and {beyond(*depth)})"
    vpin_hit = f"(not {no_ofi} and not {no_depth} and {beyond(*vpin)})"
    return Guard(
        f"{strict} or {vpin_hit} or ({ofi_hit} and rolling_ofi <= 0)"
        f" or ({depth_hit} and depth_imbalance_k <= 0)",
        f"{strict} or {vpin_hit} or ({ofi_hit} and rolling_ofi > 0)"
        f" or ({depth_hit} and depth_imbalance_k > 0)",
        ((f"{strict} or {ofi_hit} or {depth_hit} or {vpin_hit}", FLOW),),
    )


def inventory_guard() -> Guard:
    """Position and notional limits. The side that reduces risk stays open."""
    open_ = "not (risk_reduction_only and inventory = 0)"
    long_hit = (f"({open_} and (inventory >= max_long_inventory"
                " or inventory + quote_size > max_long_inventory))")
    short_hit = (f"({open_} and (inventory <= -max_short_inventory"
                 " or inventory - quote_size < -max_short_inventory))")
    notional = f"({open_} and abs(inventory) * mid_price >= max_notional_exposure)"
    return Guard(
        f"{long_hit} or ((risk_reduction_only or {notional}) and inventory >= 0)",
        f"{short_hit} or ((risk_reduction_only or {notional}) and inventory <= 0)",
        (("risk_reduction_only", REDUCE_ONLY), (long_hit, LONG_LIMIT), (short_hit, SHORT_LIMIT),
         (notional, NOTIONAL)),
    )


def with_guards(df: DataFrame, use_features: bool = True, extra: Sequence[Guard] = ()) -> DataFrame:
    """Combined verdict of the guards in order, plus any ``extra`` ones.

    Verdicts are plain boolean columns, so the whole chain stays inside generated code.
    """
    chain = [STALE_GUARD, SPREAD_GUARD, DEPTH_GUARD, VOLATILITY_GUARD]
    chain += [flow_guard()] if use_features else []
    chain += [inventory_guard(), *extra]
    reasons = [r for g in chain for r in g.reasons]
    df = df.withColumns(
        {
            "bid_ok": F.expr("not (" + " or ".join(f"({g.stop_bid})" for g in chain) + ")"),
            "ask_ok": F.expr("not (" + " or ".join(f"({g.stop_ask})" for g in chain) + ")"),
            **{f"__r{i}": F.expr(c) for i, (c, _) in enumerate(reasons)},
        }
    )
    named = [(f"if(__r{i}, '{name}', null)", name) for i, (_, name) in enumerate(reasons)]

    def side_reason(ok, *own):
        mine = [c for c, name in named if name in own]
        every = [c for c, _ in named]
        return F.expr(f"if({ok}, null, coalesce({', '.join(mine + every)}, '{INVALID_MARKET_DATA}'))")

    # array_except drops the NULLs and repeats, keeping the order.
    listed = F.expr(
        f"array_except(array({', '.join(c for c, _ in named)}), array(cast(null as string)))"
    )
    return df.withColumns(
        {
            "reasons": listed,
            "bid_reason": side_reason("bid_ok", LONG_LIMIT, REDUCE_ONLY, NOTIONAL),
            "ask_reason": side_reason("ask_ok", SHORT_LIMIT, REDUCE_ONLY, NOTIONAL),
        }
    ).drop(*[f"__r{i}" for i in range(len(reasons))])


# --- decisions -----------------------------------------------------------------------------------


def usable_market() -> Column:
    """Rows a quote can be based on: both sides present and the event not after its availability."""
    return F.coalesce(
        F.expr(
            "best_bid_price > 0 and best_ask_price > 0 and best_bid_quantity > 0"
            " and best_ask_quantity > 0 and source_timestamp_ns <= available_timestamp_ns"
        ),
        F.lit(False),
    )


def quote_decisions(
    df: DataFrame, configs: Sequence[QuotingConfig] = (QuotingConfig(),),
    use_features: bool = True, extra_guards: Sequence[Guard] = (),
) -> DataFrame:
    """One decision per quote and configuration.

    Needs source/available/decision clocks, the four quote columns and ``inventory``; feature columns
    that are absent count as unknown. Rows without a usable market are left out.
    """
    missing = {c: F.lit(None).cast(t) for c, t in FEATURES.items() if c not in df.columns}
    df = with_config(df.withColumns(missing) if missing else df, configs).where(usable_market())
    df = with_guards(with_raw_quotes(with_reservation_price(df, use_features)), use_features,
                     extra_guards)
    ok = F.col("is_reservable")
    bad = F.lit(BAD_RESERVATION)

    def unless_bad(c, otherwise):
        return F.when(ok, c).otherwise(otherwise)

    for side in ("bid", "ask"):
        live = F.col(f"{side}_ok") & ok
        df = df.withColumns(
            {
                f"{side}_ticks": unless_bad(F.col(f"{side}_ticks"), F.lit(0)),
                f"{side}_distance": unless_bad(F.col(f"{side}_distance"), F.lit(0.0)),
                f"{side}_quantity": F.when(live, F.col("quote_size").cast("long")).otherwise(0),
                f"{side}_reason": unless_bad(F.col(f"{side}_reason"), bad),
                f"has_{side}_quote": live,
            }
        )
    return df.withColumns(
        {
            "target_half_spread": unless_bad(F.col("target_half_spread"), F.col("half_spread")),
            "reasons": unless_bad(F.col("reasons"), F.array(bad)),
            "is_valid": F.col("has_bid_quote") | F.col("has_ask_quote"),
        }
    )


DECISION = [
    "config_id", "instrument_id", "sequence_num", "decision_timestamp_ns", "mid_price",
    "reservation_price", "target_half_spread", "inventory", "bid_ticks", "bid_quantity",
    "bid_distance", "bid_reason", "ask_ticks", "ask_quantity", "ask_distance", "ask_reason",
    "is_valid", "reasons",
]


def order_intents(decisions: DataFrame, latency_ns: int = 0) -> DataFrame:
    """Post-only limit orders, immediate-or-cancel, for every active side."""
    def leg(side, name):
        return F.when(
            F.col(f"has_{side}_quote"),
            F.struct(F.lit(name).alias("side"), F.col(f"{side}_ticks").alias("limit_price"),
                     F.col(f"{side}_quantity").alias("quantity"),
                     F.col(f"{side}_distance").alias("distance_from_mid")),
        )

    legs = F.array_compact(F.array(leg("bid", "buy"), leg("ask", "sell")))
    return decisions.withColumn("__leg", F.explode(legs)).select(
        "config_id", "instrument_id", "sequence_num", "decision_timestamp_ns",
        (F.col("decision_timestamp_ns") + latency_ns).alias("actionable_timestamp_ns"),
        F.lit("limit").alias("order_type"), F.lit("ioc").alias("time_in_force"),
        F.lit(True).alias("is_post_only"), "__leg.*", "reservation_price",
    )


def with_signal(decisions: DataFrame) -> DataFrame:
    """Inventory-rebalancing signal of each decision."""
    q, valid = F.col("inventory"), F.col("is_valid")
    share = F.expr(
        "case when inventory > 0 then if(max_long_inventory > 0,"
        " -least(1.0D, try_divide(inventory, max_long_inventory)), -0.5D)"
        " when inventory < 0 then if(max_short_inventory > 0,"
        " least(1.0D, try_divide(abs(inventory), max_short_inventory)), 0.5D) else 0.0D end"
    )
    return decisions.withColumns(
        {
            "direction": F.when(valid, -F.signum(q)).otherwise(0).cast("tinyint"),
            "target_weight": F.when(valid, share).otherwise(0.0),
            "strength": F.expr(
                "least(1.0D, abs(reservation_price - mid_price) / target_half_spread)"
            ),
            "confidence": F.expr(
                "case when has_bid_quote and has_ask_quote then 1.0D when is_valid then 0.5D"
                " else 0.0D end"
            ),
        }
    )


SIGNAL = ["decision_timestamp_ns", "instrument_id", "direction", "target_weight", "strength",
          "confidence", "is_valid"]


def rebalance_signals(
    df: DataFrame, configs: Sequence[QuotingConfig] = (QuotingConfig(),)
) -> DataFrame:
    """Table path: one signal per row, features ignored; unusable rows give a flat invalid signal."""
    good = with_signal(quote_decisions(df, configs, use_features=False)).select(
        "config_id", "sequence_num", *SIGNAL
    )
    bad = with_config(df, configs).where(~usable_market()).select(
        "config_id", "sequence_num", "decision_timestamp_ns", "instrument_id",
        F.lit(0).cast("tinyint").alias("direction"), F.lit(0.0).alias("target_weight"),
        F.lit(0.0).alias("strength"), F.lit(0.0).alias("confidence"), F.lit(False).alias("is_valid"),
    )
    return good.unionByName(bad)


def feature_signals(
    df: DataFrame, configs: Sequence[QuotingConfig] = (QuotingConfig(),)
) -> DataFrame:
    """Event path: features drive volatility and guards; unusable rows give no signal."""
    return with_signal(quote_decisions(df, configs)).select("config_id", "sequence_num", *SIGNAL)


def suppression_report(decisions: DataFrame, bucket_ns: int) -> DataFrame:
    """Suppressed decisions by configuration, instrument, time bucket and reason, with subtotals."""
    each = decisions.select(
        "config_id", "instrument_id",
        F.expr(f"decision_timestamp_ns div {bucket_ns}L * {bucket_ns}L").alias("bucket_ns"),
        F.explode("reasons").alias("reason"),
    )
    return each.rollup("config_id", "instrument_id", "bucket_ns", "reason").agg(
        F.count(F.lit(1)).alias("n_decisions")
    )
