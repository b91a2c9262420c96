"""Hand-computed feature values and causal invariance."""

import math

import pytest
from pyspark.sql import functions as F

from tapeframe.contracts import FEATURES
from tapeframe.operators import features as ops
from tapeframe.sources import views

from conftest import SF

QUOTE = ("instrument_id long, sequence_num long, source_timestamp_ns long, receive_timestamp_ns long,"
         " best_bid_price long, best_bid_quantity long, best_ask_price long, best_ask_quantity long")
TRADE = ("instrument_id long, sequence_num long, source_timestamp_ns long, receive_timestamp_ns long,"
         " price long, quantity long, aggressor_side int")


def _quotes(spark, rows):
    return spark.createDataFrame(
        [(101, i + 1, 1000 * (i + 1), 1000 * (i + 1), *r) for i, r in enumerate(rows)], QUOTE)


def _trades(spark, rows):
    return spark.createDataFrame(
        [(101, i + 1, 1000 * (i + 1), 1000 * (i + 1), *r) for i, r in enumerate(rows)], TRADE)


def _sorted(df):
    return df.orderBy("sequence_num").collect()


def test_ofi(spark):
    q = _quotes(spark, [(10000, 50, 10020, 40), (10000, 70, 10020, 40), (10005, 30, 10020, 40),
                        (10005, 30, 10025, 45)])
    rows = _sorted(ops.with_rolling_ofi(ops.with_instant_ofi(ops.with_quote_validity(q)), 3))
    assert [r.instant_ofi for r in rows] == [None, 20, 30, 40]
    assert [r.rolling_ofi for r in rows] == [None, None, None, 90]


def test_trade_flow(spark):
    t = _trades(spark, [(10000, 100, 1), (9990, 50, 2), (10010, 50, 1)])
    rows = _sorted(ops.with_trade_flow(t, 3))
    assert [r.rolling_trade_volume for r in rows] == [100, 150, 200]
    assert [r.last_signed_volume for r in rows] == [100, -50, 50]
    assert rows[1].trade_flow_imbalance == pytest.approx(1 / 3)
    assert rows[2].trade_flow_imbalance == pytest.approx(0.5)
    assert rows[1].rolling_vwap == pytest.approx((1000000 + 499500) / 150)
    assert [r.has_trade_flow for r in rows] == [False, False, True]


def test_returns_and_volatility(spark):
    mids = [100, 102, 101, 103, 105]
    q = _quotes(spark, [(m - 1, 10, m + 1, 10) for m in mids])
    rows = _sorted(ops.with_returns(ops.with_spread_mid(ops.with_quote_validity(q)), 1, 4))
    rets = [math.log(b / a) for a, b in zip(mids, mids[1:], strict=False)]
    mean = sum(rets) / 4
    assert rows[-1].log_return == pytest.approx(rets[-1])
    assert rows[-1].realized_volatility == pytest.approx(
        math.sqrt(sum((r - mean) ** 2 for r in rets) / 3))
    assert rows[-2].realized_volatility is None


def test_roll_spread(spark):
    t = _trades(spark, [(p, 10, 1) for p in (100, 102, 100, 102, 100)])
    rows = _sorted(ops.with_roll_spread(t, 4))
    # changes 2,-2,2,-2: mean 0, covariance (-4-4-4)/3
    assert rows[-1].roll_spread == pytest.approx(2 * math.sqrt(4))
    assert rows[-2].roll_spread is None


def test_vpin(spark):
    t = _trades(spark, [(100, 100, 1), (100, 70, 1), (100, 30, 2)])
    rows = _sorted(ops.with_vpin(t, 100, 2))
    assert [r.vpin for r in rows] == [None, None, pytest.approx(0.70)]


def test_bucket_volume_is_conserved(spark, both_plans):
    t = views.trades(spark, SF)
    whole = t.groupBy("instrument_id").agg(F.sum("quantity").alias("q")).collect()
    got = ops.volume_buckets(t, 1000).groupBy("instrument_id").agg(F.sum("volume").alias("v"))
    assert {r.instrument_id: r.v for r in got.collect()} == {
        r.instrument_id: r.q // 1000 * 1000 for r in whole}


def test_depth(spark):
    level = "array<struct<price:long,quantity:long,order_count:long>>"
    s = spark.createDataFrame(
        [(1, [(99, 30, 1), (100, 50, 1)], [(103, 40, 1), (102, 40, 1)])],
        f"instrument_id long, bids {level}, asks {level}")
    r = ops.depth_features(s, 2).first()
    assert (r.bid_depth_k, r.ask_depth_k, r.depth_imbalance_k) == (80, 80, 0.0)
    assert (r.best_bid_price, r.best_ask_price) == (100, 102)


def test_late_drop(spark, both_plans):
    df = spark.createDataFrame(
        [(1, i, ts) for i, ts in enumerate([1000, 999, 1000])],
        "instrument_id long, input_index long, source_timestamp_ns long")
    assert [r.input_index for r in ops.drop_late(df).orderBy("input_index").collect()] == [0, 2]


def test_contract(spark):
    out = ops.extract_features(views.quotes(spark, SF))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in FEATURES]
    assert len(FEATURES) == 46
    with pytest.raises(ValueError):
        ops.event_kind(spark.range(1))


def test_future_shocks_leave_the_past_alone(spark):
    q = views.quotes(spark, SF)
    cut = q.agg(F.expr("percentile_approx(source_timestamp_ns, 0.6)")).first()[0]
    past = ops.extract_features(q.where(F.col("source_timestamp_ns") <= cut)).collect()
    shocked = q.withColumn(
        "best_bid_price",
        F.when(F.col("source_timestamp_ns") > cut, F.col("best_bid_price") * 7).otherwise(
            F.col("best_bid_price")))
    full = ops.extract_features(shocked).where(F.col("event_timestamp_ns") <= cut).collect()
    assert sorted(map(repr, past)) == sorted(map(repr, full))


def test_input_partitioning_does_not_matter(spark, both_plans):
    q = views.quotes(spark, SF)
    a = ops.extract_features(q).collect()
    b = ops.extract_features(q.repartition(7)).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
