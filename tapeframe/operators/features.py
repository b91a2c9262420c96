"""Microstructure features over quote, trade and snapshot tapes.

Every value is NULL until it is defined and carries a ``has_*`` flag; nothing is reported as 0.
Rolling sums stay in integers and divide last, so they do not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.contracts import FEATURE_COLUMNS, FEATURE_FLAGS
from tapeframe.operators.scan import (
    history,
    running,
    running_last,
    running_max,
    running_sum,
)

KEY = ["instrument_id"]
ORDER = ["source_timestamp_ns", "sequence_num"]


@dataclass(frozen=True)
class FeatureConfig:
    return_lookback: int = 1
    volatility_window: int = 20
    ofi_window: int = 20
    trade_window: int = 20
    roll_window: int = 30
    vpin_bucket_volume: int = 1000
    vpin_num_buckets: int = 20
    depth_levels: int = 5

    def __post_init__(self):
        floors = {
            "return_lookback": 1, "volatility_window": 2, "ofi_window": 1, "trade_window": 1,
            "roll_window": 3, "vpin_bucket_volume": 1, "vpin_num_buckets": 1, "depth_levels": 1,
        }
        for name, low in floors.items():
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be at least {low}")


# --- quote columns -----------------------------------------------------------------------------


def with_quote_validity(df: DataFrame) -> DataFrame:
    """has_bid, has_ask, is_crossed (locked counts), is_valid (both sides, not crossed)."""
    bid = F.expr("best_bid_price > 0 and best_bid_quantity > 0")
    ask = F.expr("best_ask_price > 0 and best_ask_quantity > 0")
    return (
        df.withColumns({"has_bid": F.coalesce(bid, F.lit(False)),
                        "has_ask": F.coalesce(ask, F.lit(False))})
        .withColumn("is_crossed", F.expr("has_bid and has_ask and best_bid_price >= best_ask_price"))
        .withColumn("is_valid", F.expr("has_bid and has_ask and not is_crossed"))
    )


def with_spread_mid(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "spread": F.expr("if(is_valid, best_ask_price - best_bid_price, null)"),
            "mid_price": F.expr("if(is_valid, (best_bid_price + best_ask_price) / 2.0D, null)"),
            "relative_spread": F.expr(
                "if(is_valid, (best_ask_price - best_bid_price)"
                " / ((best_bid_price + best_ask_price) / 2.0D), null)"
            ),
        }
    )


def with_weighted_mid(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "weighted_mid_price": F.expr(
                "if(is_valid, cast(best_bid_price * best_ask_quantity"
                " + best_ask_price * best_bid_quantity as double)"
                " / (best_bid_quantity + best_ask_quantity), null)"
            ),
            "book_imbalance_top": F.expr(
                "if(is_valid, cast(best_bid_quantity - best_ask_quantity as double)"
                " / (best_bid_quantity + best_ask_quantity), null)"
            ),
        }
    )


def with_availability(df: DataFrame) -> DataFrame:
    """Decision clock: a row may be used once it has both happened and arrived."""
    return df.withColumn(
        "decision_timestamp_ns", F.greatest("source_timestamp_ns", "receive_timestamp_ns")
    )


def with_instant_ofi(df: DataFrame) -> DataFrame:
    """Order-flow imbalance of this quote against the previous one; NULL unless both are valid."""
    prev = F.struct(
        "is_valid", "best_bid_price", "best_bid_quantity", "best_ask_price", "best_ask_quantity"
    )
    df = running(df, KEY, ORDER, __prev=running_last(prev, inclusive=False))
    bid = """case when best_bid_price > __prev.best_bid_price then best_bid_quantity
                  when best_bid_price = __prev.best_bid_price
                    then best_bid_quantity - __prev.best_bid_quantity
                  else - __prev.best_bid_quantity end"""
    ask = """case when best_ask_price < __prev.best_ask_price then - best_ask_quantity
                  when best_ask_price = __prev.best_ask_price
                    then __prev.best_ask_quantity - best_ask_quantity
                  else __prev.best_ask_quantity end"""
    return df.withColumn(
        "instant_ofi", F.expr(f"if(is_valid and __prev.is_valid, ({bid}) + ({ask}), null)")
    ).drop("__prev")


def with_rolling_ofi(df: DataFrame, window: int) -> DataFrame:
    """Sum over the last ``window`` rows that have an OFI; NULL on the other rows and until full."""
    df = df.withColumn("__seq", F.col("instant_ofi").isNotNull())
    line = history(df, [*KEY, "__seq"], ORDER, window - 1, only=F.col("__seq"))
    w = line.window().rowsBetween(-(window - 1), 0)
    out = line.df.withColumn(
        "rolling_ofi",
        F.when(F.col("__seq") & (F.count(F.lit(1)).over(w) == window), F.sum("instant_ofi").over(w)),
    )
    return line.result(out).drop("__seq")


def with_returns(df: DataFrame, lookback: int, vol_window: int, carry: bool = True) -> DataFrame:
    """Log return against the mid ``lookback`` valid quotes back, and its rolling deviation.

    Both are carried forward over rows without a valid mid.
    """
    df = df.withColumn("__seq", F.col("mid_price").isNotNull())
    line = history(df, [*KEY, "__seq"], ORDER, lookback + vol_window - 1, only=F.col("__seq"))
    past = F.lag("mid_price", lookback).over(line.window())
    out = line.df.withColumn("__ret", F.ln(F.col("mid_price") / past))
    w = line.window().rowsBetween(-(vol_window - 1), 0)
    out = out.withColumn(
        "__vol", F.when(F.count("__ret").over(w) == vol_window, F.stddev_samp("__ret").over(w))
    )
    out = line.result(out).drop("__seq")
    if not carry:
        return out.withColumnsRenamed({"__ret": "log_return", "__vol": "realized_volatility"})
    return running(
        out, KEY, ORDER,
        log_return=running_last("__ret"), realized_volatility=running_last("__vol"),
    ).drop("__ret", "__vol")


def quote_features(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    df = with_weighted_mid(with_spread_mid(with_quote_validity(with_availability(df))))
    df = with_rolling_ofi(with_instant_ofi(df), config.ofi_window)
    return with_returns(df, config.return_lookback, config.volatility_window)


# --- trade columns -----------------------------------------------------------------------------


def with_trade_flow(df: DataFrame, window: int) -> DataFrame:
    """Signed volume, rolling buy/sell volume, imbalance and VWAP over the last ``window`` trades."""
    line = history(df, KEY, ORDER, window - 1)
    w = line.window().rowsBetween(-(window - 1), 0)
    out = line.df.withColumns(
        {
            "last_signed_volume": F.expr("if(aggressor_side = 1, quantity, -quantity)"),
            "rolling_trade_volume": F.sum("quantity").over(w),
            "rolling_buy_volume": F.sum(F.expr("if(aggressor_side = 1, quantity, 0L)")).over(w),
            "rolling_sell_volume": F.sum(F.expr("if(aggressor_side = 2, quantity, 0L)")).over(w),
            "__notional": F.sum(F.col("price") * F.col("quantity")).over(w),
            "__seen": F.count(F.lit(1)).over(w),
        }
    )
    out = out.withColumns(
        {
            "trade_flow_imbalance": F.expr(
                "if(rolling_trade_volume > 0, cast(rolling_buy_volume - rolling_sell_volume"
                " as double) / rolling_trade_volume, null)"
            ),
            "rolling_vwap": F.expr(
                "if(rolling_trade_volume > 0, cast(__notional as double) / rolling_trade_volume,"
                " null)"
            ),
            "has_trade_flow": F.expr(f"__seen = {window} and rolling_trade_volume > 0"),
        }
    )
    return line.result(out).drop("__notional", "__seen")


def with_roll_spread(df: DataFrame, window: int) -> DataFrame:
    """Roll's effective spread from the lag-1 covariance of the last ``window`` price changes.

    The covariance comes from windowed integer sums. With d_1..d_N the changes, S their sum, P the
    sum of neighbour products d_i * d_(i-1):  N * cov_sum * N = N^2 P - N S (2S - d_1 - d_N)
    + (N - 1) S^2, all exact in integers.
    """
    line = history(df, KEY, ORDER, window + 1)
    base = line.window()
    out = line.df.withColumn("__d", F.col("price") - F.lag("price").over(base))
    out = out.withColumn("__dd", F.col("__d") * F.lag("__d").over(base))
    w = base.rowsBetween(-(window - 1), 0)
    inner = base.rowsBetween(-(window - 2), 0)
    out = out.withColumns(
        {
            "__n": F.count("__d").over(w),
            "__s": F.sum("__d").over(w),
            "__p": F.sum("__dd").over(inner),
            "__first": F.lag("__d", window - 1).over(base),
        }
    )
    n = window
    gamma = F.expr(
        f"cast({n}L * {n}L * __p - {n}L * __s * (2L * __s - __first - __d)"
        f" + {n - 1}L * __s * __s as double) / ({n}.0D * {n}.0D * {n - 1}.0D)"
    )
    out = out.withColumn("__gamma", F.when(F.col("__n") == window, gamma)).withColumn(
        "roll_spread", F.when(F.col("__gamma") < 0, 2.0 * F.sqrt(-F.col("__gamma")))
    )
    return line.result(out).drop("__d", "__dd", "__n", "__s", "__p", "__first", "__gamma")


def volume_buckets(df: DataFrame, volume: int) -> DataFrame:
    """Complete volume buckets of ``volume`` per instrument with their absolute imbalance.

    A trade that crosses boundaries is split over every bucket it touches.
    """
    cum = running(df, KEY, ORDER, __cum=running_sum("quantity"))
    return _bucket_totals(cum, volume)


def _bucket_totals(cum: DataFrame, volume: int) -> DataFrame:
    lo = F.col("__cum") - F.col("quantity")
    pieces = cum.where(F.col("quantity") > 0).select(
        *KEY, "aggressor_side", lo.alias("__lo"), F.col("__cum").alias("__hi"),
        F.explode(
            F.expr(f"sequence((__cum - quantity) div {volume}L, (__cum - 1) div {volume}L)")
        ).alias("bucket"),
    )
    share = F.least(F.col("__hi"), (F.col("bucket") + 1) * volume) - F.greatest(
        F.col("__lo"), F.col("bucket") * volume
    )
    signed = F.when(F.col("aggressor_side") == 1, share).otherwise(-share)
    return (
        pieces.groupBy(*KEY, "bucket")
        .agg(F.sum(share).alias("volume"), F.abs(F.sum(signed)).alias("imbalance"))
        .where(F.col("volume") == volume)
    )


def with_vpin(df: DataFrame, volume: int, buckets: int) -> DataFrame:
    """Mean absolute imbalance of the last ``buckets`` complete volume buckets, per trade."""
    cum = running(df, KEY, ORDER, __cum=running_sum("quantity"))
    totals = _bucket_totals(cum, volume)
    line = history(totals, KEY, ["bucket"], buckets - 1)
    w = line.window().rowsBetween(-(buckets - 1), 0)
    toxic = line.df.withColumns(
        {"__sum": F.sum("imbalance").over(w), "__n": F.count(F.lit(1)).over(w)}
    )
    toxic = line.result(toxic).where(F.col("__n") == buckets).select(
        *KEY, F.col("bucket").alias("__done"),
        (F.col("__sum").cast("double") / (buckets * volume)).alias("vpin"),
    )
    return (
        cum.withColumn("__done", F.expr(f"__cum div {volume}L - 1"))
        .join(toxic, [*KEY, "__done"], "left")
        .drop("__cum", "__done")
    )


def trade_features(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    df = with_trade_flow(with_availability(df), config.trade_window)
    df = with_roll_spread(df, config.roll_window)
    return with_vpin(df, config.vpin_bucket_volume, config.vpin_num_buckets)


# --- snapshots ---------------------------------------------------------------------------------


def sorted_levels(levels: str, descending: bool, k: int | None = None) -> Column:
    """Level array ordered best price first, cut to the best ``k``."""
    sign = "-" if descending else ""
    best = F.expr(
        f"transform(array_sort(transform({levels}, (x, i) -> named_struct('p', {sign}x.price,"
        " 'i', i, 'x', x))), s -> s.x)"
    )
    return F.slice(best, 1, k) if k else best


def depth_features(df: DataFrame, k: int) -> DataFrame:
    """Depth and imbalance over the best ``k`` levels of a snapshot, plus its top of book."""
    df = df.withColumns(
        {"__b": sorted_levels("bids", True, k), "__a": sorted_levels("asks", False, k)}
    )
    df = df.withColumns(
        {
            "best_bid_price": F.expr("coalesce(get(__b, 0).price, 0L)"),
            "best_bid_quantity": F.expr("coalesce(get(__b, 0).quantity, 0L)"),
            "best_ask_price": F.expr("coalesce(get(__a, 0).price, 0L)"),
            "best_ask_quantity": F.expr("coalesce(get(__a, 0).quantity, 0L)"),
            "__bq": F.expr("aggregate(__b, 0L, (s, x) -> s + x.quantity)"),
            "__aq": F.expr("aggregate(__a, 0L, (s, x) -> s + x.quantity)"),
        }
    )
    df = with_quote_validity(df).withColumn(
        "has_depth_imbalance", F.expr("__bq + __aq > 0 and not is_crossed")
    )
    return df.withColumns(
        {
            "bid_depth_k": F.expr("if(has_depth_imbalance, __bq, null)"),
            "ask_depth_k": F.expr("if(has_depth_imbalance, __aq, null)"),
            "depth_imbalance_k": F.expr(
                "if(has_depth_imbalance, cast(__bq - __aq as double) / (__bq + __aq), null)"
            ),
        }
    ).drop("__b", "__a", "__bq", "__aq")


# --- tapes to the feature contract -------------------------------------------------------------


def event_kind(df: DataFrame) -> str:
    names = set(df.columns)
    if {"best_bid_price", "best_ask_price"} <= names:
        return "top_of_book"
    if {"aggressor_side", "price"} <= names:
        return "trade"
    if {"bids", "asks"} <= names:
        return "snapshot"
    raise ValueError(f"cannot tell the event type from the columns {sorted(names)}")


def drop_late(df: DataFrame, arrival: Sequence[str] = ("input_index",)) -> DataFrame:
    """Drop rows older than an earlier arrival of the same instrument; equal clocks are kept."""
    seen = running(df, KEY, list(arrival), __seen=running_max("source_timestamp_ns", False))
    return seen.where(F.expr("__seen is null or source_timestamp_ns >= __seen")).drop("__seen")


def extract_features(
    df: DataFrame, config: FeatureConfig = FeatureConfig(), kind: str | None = None
) -> DataFrame:
    """One feature row per tape row, in the feature contract's columns."""
    kind = kind or event_kind(df)
    if kind == "top_of_book":
        return to_feature_contract(quote_features(df, config))
    if kind == "trade":
        return to_feature_contract(trade_features(df, config))
    return to_feature_contract(quote_features(depth_features(df, config.depth_levels), config))


def unified_timeline(
    quotes: DataFrame, trades: DataFrame, config: FeatureConfig = FeatureConfig()
) -> DataFrame:
    """Quote and trade features on one event clock, each side carried onto the other's rows.

    At one instant quotes come before trades.
    """
    q = to_feature_contract(quote_features(quotes, config)).withColumn("__rank", F.lit(0))
    t = to_feature_contract(trade_features(trades, config)).withColumn("__rank", F.lit(1))
    both = q.unionByName(t)
    is_quote = F.col("__rank") == 0
    book = ["best_bid_price", "best_bid_quantity", "best_ask_price", "best_ask_quantity", "spread",
            "relative_spread", "mid_price", "weighted_mid_price", "book_imbalance_top",
            "bid_depth_k", "ask_depth_k", "depth_imbalance_k",
            "has_bid", "has_ask", "is_crossed", "has_spread", "has_mid", "has_weighted_mid",
            "has_book_imbalance", "has_depth_imbalance", "log_return", "realized_volatility",
            "has_log_return", "has_realized_volatility"]
    flow = ["last_signed_volume", "rolling_trade_volume", "rolling_buy_volume",
            "rolling_sell_volume", "trade_flow_imbalance", "rolling_vwap", "roll_spread", "vpin",
            "has_trade", "has_trade_flow", "has_vwap", "has_roll_spread", "has_vpin"]
    both = running(
        both.withColumnRenamed("event_timestamp_ns", "__ts"),
        KEY, ["__ts", "__rank", "sequence_num"],
        __book=running_last(F.when(is_quote, F.struct(*book))),
        __flow=running_last(F.when(~is_quote, F.struct(*flow))),
        __ofi=running_last("rolling_ofi"),
    )
    values = {c: F.col(f"__book.{c}") for c in book} | {c: F.col(f"__flow.{c}") for c in flow}
    values["rolling_ofi"] = F.when(is_quote, F.col("rolling_ofi")).otherwise(F.col("__ofi"))
    values["has_rolling_ofi"] = values["rolling_ofi"].isNotNull()
    both = both.withColumns(values).withColumnRenamed("__ts", "event_timestamp_ns")
    return both.select(
        *[
            F.coalesce(F.col(c), F.lit(False)).alias(c) if c in FEATURE_FLAGS else F.col(c)
            for c in FEATURE_COLUMNS
        ]
    )


def to_feature_contract(df: DataFrame) -> DataFrame:
    """Project onto the 46 feature columns: absent values NULL, flags from the values.

    The event clock is the source time; the contract's ``source_timestamp_ns`` is the receive time.
    """
    have = set(df.columns)
    clocks = {"event_timestamp_ns": "source_timestamp_ns",
              "source_timestamp_ns": "receive_timestamp_ns"}
    gates = {"best_bid_price": "has_bid", "best_bid_quantity": "has_bid",
             "best_ask_price": "has_ask", "best_ask_quantity": "has_ask"}
    out = []
    for c, dtype in FEATURE_COLUMNS.items():
        source = clocks.get(c, c)
        if c in FEATURE_FLAGS and c not in have:
            value = f"{FEATURE_FLAGS[c]} is not null" if FEATURE_FLAGS[c] in have else "false"
        elif source not in have:
            value = "null"
        else:
            value = f"if({gates[c]}, {c}, null)" if c in gates else source
        if c in FEATURE_FLAGS:
            value = f"coalesce({value}, false)"
        out.append(f"cast({value} as {dtype}) {c}")
    return df.selectExpr(*out)


def feature_coverage(features: DataFrame) -> DataFrame:
    """Share of rows carrying each flag, per instrument."""
    return features.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            (F.sum(F.col(f).cast("long")).cast("double") / F.count(F.lit(1))).alias(f"share_{f}")
            for f in FEATURE_FLAGS
        ],
    )
