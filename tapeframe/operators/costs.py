"""Transaction costs: spread, slippage, venue fee and regulatory fees by dated schedule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.operators.calendar import eastern_midnight_ns, with_trade_dates
from tapeframe.operators.intervals import effective_dated
from tapeframe.session import inline_table

# Start date, sale fee per dollar, activity fee per share, its cap per trade.
FEE_ROWS = (
    ("2024-01-01", 0.0000080, 0.000195, 9.79),
    ("2024-05-22", 0.0000278, 0.000195, 9.79),
    ("2025-05-14", 0.0, 0.000195, 9.79),
    ("2026-04-04", 0.0000206, 0.000195, 9.79),
    ("2026-10-01", 0.0000206, 0.0, 0.0),
    ("2027-01-01", 0.0000206, 0.000195, 9.79),
    ("2029-01-01", 0.0000206, 0.000232, 11.61),
    ("2030-01-01", 0.0000206, 0.000240, 12.05),
    ("2031-01-01", 0.0000206, 0.000249, 12.50),
)
ACTIVITY_MIN = 0.0
TAKER_FEE = 0.0030
MAKER_REBATE = 0.0


def fee_schedule(spark: SparkSession) -> DataFrame:
    """Schedule rows over [start_ns, end_ns), bounds at Eastern midnight, the last one open."""
    rows = [
        (start, FEE_ROWS[i + 1][0] if i + 1 < len(FEE_ROWS) else None, i == 0, sale, act, cap,
         ACTIVITY_MIN, TAKER_FEE, MAKER_REBATE)
        for i, (start, sale, act, cap) in enumerate(FEE_ROWS)
    ]
    df = inline_table(
        spark,
        "start_date date, end_date date, is_first boolean, sale_fee_rate double,"
        " activity_fee_rate double, activity_fee_max double, activity_fee_min double,"
        " taker_fee double, maker_rebate double",
        rows,
    )
    return df.select(
        "start_date", "end_date", "is_first",
        eastern_midnight_ns(F.col("start_date")).alias("start_ns"),
        eastern_midnight_ns(F.col("end_date")).alias("end_ns"),
        "sale_fee_rate", "activity_fee_rate", "activity_fee_max", "activity_fee_min",
        "taker_fee", "maker_rebate",
    )


@dataclass(frozen=True)
class CostConfig:
    fixed_slippage_per_share: float = 0.0
    slippage_impact: float = 0.0
    price_scale: float = 100.0
    charge_rule: str = "clearing_settlement_date"
    settlement_days: int | None = None
    round_to_cents: bool = False
    strict_coverage: bool = False

    def __post_init__(self):
        if self.price_scale <= 0:
            raise ValueError("price_scale must be positive")
        if self.fixed_slippage_per_share < 0 or self.slippage_impact < 0:
            raise ValueError("slippage parameters cannot be negative")


def with_spread_cost(df: DataFrame, config: CostConfig = CostConfig()) -> DataFrame:
    """Distance from touch to mid times quantity: reported, never charged to cash."""
    mid = (F.col("quote_bid") + F.col("quote_ask")) / 2.0
    paid = F.when(F.col("side") == "buy", F.col("quote_ask") - mid).otherwise(
        mid - F.col("quote_bid"))
    return df.withColumn(
        "spread_cost", F.greatest(F.lit(0.0), paid / config.price_scale * F.col("quantity"))
    )


def with_slippage_cost(df: DataFrame, config: CostConfig = CostConfig()) -> DataFrame:
    """Fixed cost per share plus square-root impact; a missing volume counts as ratio 1."""
    mid = (F.col("quote_bid") + F.col("quote_ask")) / 2.0 / config.price_scale
    v, sigma = F.col("reference_volume"), F.col("realized_volatility")
    ratio = F.when(v > 0, F.sqrt(F.try_divide(F.col("quantity"), v))).otherwise(1.0)
    impact = F.when(sigma > 0, config.slippage_impact * mid * sigma * ratio).otherwise(0.0)
    return df.withColumn(
        "slippage_cost", (config.fixed_slippage_per_share + impact) * F.col("quantity")
    )


def with_regulatory_costs(
    df: DataFrame, ts_ns: str = "fill_timestamp_ns", config: CostConfig = CostConfig(),
    schedule: DataFrame | None = None,
) -> DataFrame:
    """``exchange_fee`` at the trade time and, for sells, ``sale_fee`` and ``activity_fee``.

    The sale fee takes the rate of the charge date, the activity fee that of the trade date.
    """
    schedule = fee_schedule(df.sparkSession) if schedule is None else schedule
    if config.charge_rule == "trade_date":
        out, charge_ts = df, ts_ns
    else:
        out = with_trade_dates(df, ts_ns, config.charge_rule, config.settlement_days)
        charge_ts = "settlement_timestamp_ns"
    fees = ["activity_fee_rate", "activity_fee_max", "activity_fee_min", "taker_fee"]
    out = effective_dated(out, schedule, ts_ns, fees, "__t_", config.strict_coverage)
    out = effective_dated(out, schedule, charge_ts, ["sale_fee_rate"], "__c_", config.strict_coverage)
    sell = F.col("side") == "sell"
    q, rate = F.col("quantity"), F.col("__t_activity_fee_rate")
    principal = F.col("price") * q / config.price_scale
    sale = F.when(sell, F.col("__c_sale_fee_rate") * principal).otherwise(0.0)
    exempt = (rate <= 0) | (F.col("price") / config.price_scale < rate)
    activity = F.when(
        sell & ~exempt,
        F.least(F.greatest(rate * q, F.col("__t_activity_fee_min")), F.col("__t_activity_fee_max")),
    ).otherwise(0.0)
    if config.round_to_cents:
        sale, activity = F.bround(sale, 2), F.bround(activity, 2)
    out = out.withColumns(
        {"exchange_fee": F.col("__t_taker_fee") * q, "sale_fee": sale, "activity_fee": activity}
    ).withColumn("regulatory_fee", F.col("sale_fee") + F.col("activity_fee"))
    return out.drop(*[f"__t_{f}" for f in fees], "__c_sale_fee_rate")


def with_costs(
    df: DataFrame, ts_ns: str = "fill_timestamp_ns", config: CostConfig = CostConfig(),
    schedule: DataFrame | None = None,
) -> DataFrame:
    """The four cost columns of a taker fill."""
    df = with_slippage_cost(with_spread_cost(df, config), config)
    return with_regulatory_costs(df, ts_ns, config, schedule)
