"""Forward-looking labels with closed information intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.operators.asof import asof
from tapeframe.operators.scan import chunk_width, is_narrow
from tapeframe.session import staged

KEY = ["instrument_id"]


def forward_returns(
    df: DataFrame, ts: str, price: str, tie: str, horizon_ns: int, keys=KEY
) -> DataFrame:
    """Return to the first price at or after ``ts + horizon_ns``.

    Labels are NULL and invalid when the horizon leaves the series or a price is not positive.
    """
    if horizon_ns <= 0:
        raise ValueError("horizon_ns must be positive")
    df = df.withColumn("__target", F.col(ts) + horizon_ns)
    out = asof(
        df, df.select(*keys, F.col(ts).alias("__at"), F.col(tie).alias("__tie"),
                      F.col(price).cast("double").alias("__price")),
        keys, "__target", "__at", [tie], ["__tie"], ["__at", "__price"], forward=True,
    )
    now, later = F.col(price).cast("double"), F.col("__price")
    usable = F.coalesce((now > 0) & (later > 0), F.lit(False))
    end = F.coalesce("__at", "__target")
    return out.withColumns(
        {
            "forward_timestamp_ns": end,
            "forward_price": F.when(usable, later),
            "forward_return": F.when(usable, (later - now) / now),
            "forward_log_return": F.when(usable, F.ln(later / now)),
            "has_forward_target": usable,
            "label_end_ns": end,
        }
    ).drop("__target", "__at", "__price")


def _first_exit(prices: np.ndarray, upper: float, lower: float, start: np.ndarray) -> np.ndarray:
    """Index of the first later price whose return leaves (-lower, upper); len(prices) if none.

    Blocks of a power of two prices keep their maximum and minimum, each at a multiple of its size, so all levels
    together are as long as the prices. A row goes up from block to larger block while none can hold a hit, then
    down into the one that does.
    """
    n = len(prices)
    highs, lows = [prices], [prices]
    while len(highs[-1]) > 1:
        even = len(highs[-1]) // 2 * 2
        highs.append(np.maximum(highs[-1][:even:2], highs[-1][1:even:2]))
        lows.append(np.minimum(lows[-1][:even:2], lows[-1][1:even:2]))
    entry = prices[start]
    at = start + 1

    def skip(rows: np.ndarray, k: int) -> np.ndarray:
        """Takes ``rows`` over their next block of 2**k if it is whole and without a hit; which ones it did."""
        i = at[rows] >> k
        whole = i < len(highs[k])
        i = np.where(whole, i, 0)
        e = entry[rows]
        one, other = (highs[k][i] - e) / e, (lows[k][i] - e) / e
        quiet = whole & (np.maximum(one, other) < upper) & (np.minimum(one, other) > -lower)
        at[rows[quiet]] += 1 << k
        return quiet

    below = np.zeros(len(start), dtype="int8")  # the level a row stopped at
    up = np.arange(len(start))
    for k in range(len(highs)):
        here = (at[up] >> k) & 1 == 1
        tried = up[here]
        stopped = ~skip(tried, k)
        below[tried[stopped]] = k
        here[here] = stopped
        up = up[~here]
    for k in range(len(highs) - 2, -1, -1):
        skip(np.flatnonzero(below > k), k)
    return at


def _barrier_batch(upper: float, lower: float, holding: int):
    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "tie"], kind="stable")
            price = pdf["price"].to_numpy(dtype="float64")
            ts = pdf["ts"].to_numpy(dtype="int64")
            own = np.flatnonzero(pdf["own"].to_numpy())
            hit = _first_exit(price, upper, lower, own)
            inside = hit < len(price)
            j = np.where(inside, hit, 0)
            inside &= ts[j] < ts[own] + holding
            rows = pdf.iloc[own][["instrument_id", "ts", "tie", "price"]].copy()
            rows["hit_ts"] = pd.array(np.where(inside, ts[j], 0), dtype="Int64")
            rows["hit_price"] = np.where(inside, price[j], np.nan)
            rows.loc[~inside, "hit_ts"] = pd.NA
            yield rows

    return label


def triple_barrier(
    df: DataFrame, ts: str, price: str, tie: str,
    upper: float, lower: float, max_holding_ns: int,
) -> DataFrame:
    """First of profit, loss or time expiry after each row; censored where the series ends first.

    Rows are grouped by instrument and time chunk, each chunk extended by one holding period, so a
    group is bounded by the chunk's rows plus those of one holding period whatever an instrument's
    size. The expiry price is a forward as-of look-up.
    """
    if upper <= 0 or lower <= 0 or max_holding_ns <= 0:
        raise ValueError("thresholds and the holding period must be positive")
    base = df.select(
        F.col("instrument_id"), F.col(ts).alias("ts"), F.col(tie).alias("tie"),
        F.col(price).cast("double").alias("price"),
    )
    if not is_narrow(base):
        base = staged(base, "barrier")
    width = chunk_width(base, KEY, "ts") or (1 << 62)
    width = max(width, max_holding_ns)
    home = F.expr(f"(ts - pmod(ts, {width}L)) div {width}L")
    first = F.expr(
        f"((ts - {max_holding_ns}L) - pmod(ts - {max_holding_ns}L, {width}L)) div {width}L"
    )
    copies = base.withColumn("home", home).withColumn("chunk", F.explode(F.sequence(first, home)))
    copies = copies.withColumn("own", F.col("chunk") == F.col("home"))
    label = _barrier_batch(upper, lower, max_holding_ns)

    def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(label(iter([pdf])))

    # Written out, so that the search runs once; only rows without a hit look for their expiry.
    hits = staged(copies.groupBy("instrument_id", "chunk").applyInPandas(
        one_group,
        "instrument_id long, ts long, tie long, price double, hit_ts long, hit_price double",
    ), "hits")
    quiet = hits.where("hit_ts is null").withColumn("expiry", F.col("ts") + max_holding_ns)
    out = asof(
        quiet, base.withColumnsRenamed({"ts": "exp_ts", "price": "exp_price", "tie": "exp_tie"}),
        KEY, "expiry", "exp_ts", ["ts", "tie"], ["exp_tie"], ["exp_ts", "exp_price"], forward=True,
    )
    ends = base.groupBy("instrument_id").agg(
        F.max_by(F.struct("ts", "price"), F.struct("ts", "tie")).alias("last_row")
    )
    out = out.drop("expiry").unionByName(hits.where("hit_ts is not null"), allowMissingColumns=True)
    out = out.join(F.broadcast(ends), "instrument_id")
    hit, expired = F.col("hit_ts").isNotNull(), F.col("exp_ts").isNotNull()
    exit_price = F.when(hit, F.col("hit_price")).when(expired, F.col("exp_price")).otherwise(
        F.col("last_row.price"))
    ret = (exit_price - F.col("price")) / F.col("price")
    return out.select(
        "instrument_id", F.col("ts").alias("observation_timestamp_ns"), F.col("tie").alias(tie),
        F.col("price").alias("current_price"),
        F.when(hit, F.col("hit_ts")).when(expired, F.col("exp_ts")).otherwise(
            F.col("last_row.ts")).alias("exit_timestamp_ns"),
        exit_price.alias("exit_price"),
        F.when(hit | expired, ret).alias("return_value"),
        (hit & (ret >= upper)).alias("hit_upper"),
        (hit & (ret < upper)).alias("hit_lower"),
        (~hit & expired).alias("hit_vertical"),
        (hit | expired).alias("is_valid"),
    )


def label_distribution(labels: DataFrame, keys=KEY) -> DataFrame:
    """Outcome counts per key; the counts of one key add up to its labels."""
    outcome = (
        F.when(F.col("hit_upper"), "upper").when(F.col("hit_lower"), "lower")
        .when(F.col("hit_vertical"), "vertical").otherwise("censored")
    )
    return labels.groupBy(*keys, outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n_labels"))
