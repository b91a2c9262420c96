"""Calendar rules, fees, ledger goldens and sequential rules against a loop."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tapeframe.operators import calendar as cal
from tapeframe.operators import costs, ledger
from tapeframe.operators.scan import CHUNK_ROWS_CONF
from tapeframe.session import inline_table

ET = ZoneInfo("America/New_York")


def _ns(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=ET).timestamp()) * 10**9


def _dates(spark, *texts):
    rows = [(i, _ns(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i long, ts long")
    return cal.with_trade_dates(df, "ts").orderBy("i").collect()


def test_holidays(spark):
    got = {str(r.day) for r in cal.settlement_holidays(spark).where("is_holiday").collect()}
    # Closures of 2024 and the observed ones of other years.
    want = {"2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19",
            "2024-07-04", "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25"}
    assert {d for d in got if d.startswith("2024")} == want
    assert {"2025-04-18", "2026-07-03", "2027-12-24", "2027-12-31", "2028-12-25", "2032-12-31",
            "2027-06-18", "2027-07-05"} <= got
    assert "2028-01-01" not in got and "2033-01-17" not in got


def test_settlement(spark):
    rows = _dates(
        spark, "2024-05-24T10:00", "2024-05-28T10:00", "2024-05-23T10:00", "2024-06-18T21:00",
        "2024-06-22T12:00", "2024-12-24T19:59:59", "2024-03-10T12:00",
    )
    assert [str(r.settlement_date) for r in rows] == [
        "2024-05-29", "2024-05-29", "2024-05-28", "2024-06-20", "2024-06-25", "2024-12-26",
        "2024-03-13"]
    assert [r.is_as_of_reporting for r in rows] == [False, False, False, True, True, False, True]
    assert str(rows[3].reporting_date) == "2024-06-20" and str(rows[4].clearing_date) == "2024-06-24"
    assert rows[1].settlement_timestamp_ns == _ns("2024-05-29T10:00")


def test_outside_calendar(spark):
    assert [r.is_outside_calendar for r in _dates(spark, "2023-12-29T10:00", "2033-01-03T10:00")] == [
        True, True]
    one = spark.createDataFrame([(1, _ns("2024-06-03T10:00"))], "i long, ts long")
    assert str(cal.with_trade_dates(one, "ts", settlement_days=3).first().settlement_date) == "2024-06-06"
    assert str(cal.with_trade_dates(one, "ts", "trade_date").first().charge_date) == "2024-06-03"
    with pytest.raises(ValueError):
        cal.with_trade_dates(one, "ts", "whenever")


FILL = ("run_id long, instrument_id long, fill_seq long, fill_timestamp_ns long, side string,"
        " quantity long, price long, quote_bid long, quote_ask long, reference_volume long,"
        " realized_volatility double")


def test_round_trip(spark):
    schedule = inline_table(
        spark, "start_ns long, end_ns long, is_first boolean, sale_fee_rate double,"
        " activity_fee_rate double, activity_fee_max double, activity_fee_min double, taker_fee double",
        [(0, None, True, 0.0000278, 0.000195, 9.79, 0.0, 0.0030)])
    t = _ns("2024-06-03T10:00")
    fills = spark.createDataFrame(
        [(1, 1, 1, t, "buy", 100, 10010, 10000, 10010, 500, 0.0),
         (1, 1, 2, t + 10**9, "sell", 100, 10200, 10200, 10210, 500, 0.0)], FILL)
    led = ledger.fill_ledger(costs.with_costs(fills, schedule=schedule))
    end = ledger.running_totals(led, ["fill_timestamp_ns", "fill_seq"]).orderBy("fill_seq").collect()[-1]
    friction = (end.cum_spread_cost + end.cum_slippage_cost + end.cum_exchange_fee
                + end.cum_regulatory_fee)
    assert end.position == 0
    assert end.cash_flow == pytest.approx(189.09694, abs=1e-9)
    assert friction == pytest.approx(10.90306, abs=1e-9)
    assert end.cash_flow + friction == pytest.approx(200.0, abs=1e-9)


def test_fee_caps_and_exemption(spark):
    t = _ns("2026-11-02T10:00")
    fills = spark.createDataFrame(
        [(1, 1, 1, _ns("2024-06-03T10:00"), "sell", 100_000, 10000, 9999, 10001, 1, 0.0),
         (1, 1, 2, t, "sell", 100, 10000, 9999, 10001, 1, 0.0),
         (1, 1, 3, t, "buy", 100, 10000, 9999, 10001, 1, 0.0)], FILL)
    a, b, c = costs.with_regulatory_costs(fills).orderBy("fill_seq").collect()
    assert a.activity_fee == 9.79 and b.activity_fee == 0.0 and c.regulatory_fee == 0.0
    assert b.sale_fee == pytest.approx(0.0000206 * 10_000)


def _pnl_loop(rows):
    pos, entry, pnl, out = 0, 0.0, 0.0, {}
    for seq, sq, px in rows:
        if pos * sq < 0:
            closed = min(abs(pos), abs(sq))
            pnl += closed * ((px - entry) if pos > 0 else (entry - px))
        new = pos + sq
        if new == 0:
            entry = 0.0
        elif pos == 0 or pos * new < 0:
            entry = px
        elif pos * sq > 0:
            entry = (abs(pos) * entry + abs(sq) * px) / (abs(pos) + abs(sq))
        pos = new
        out[seq] = (pos, entry, pnl)
    return out


def test_average_cost_matches_loop(spark, both_plans):
    rng = random.Random(11)
    rows = [(i, rng.choice([-1, 1]) * rng.choice([1, 2, 3, 5, 8]), rng.randint(900, 1100))
            for i in range(150)]
    df = spark.createDataFrame(
        [(1, 1, i * 5, i, sq, abs(sq), px) for i, sq, px in rows],
        "run_id long, instrument_id long, ts long, seq long, signed_quantity long, quantity long,"
        " price long")
    got = ledger.average_cost(df, ["ts", "seq"]).collect()
    want = _pnl_loop([(i, sq, px / 100.0) for i, sq, px in rows])
    for r in got:
        pos, entry, pnl = want[r.seq]
        assert r.position_after == pos
        assert r.average_entry_price == pytest.approx(entry, abs=1e-9)
        assert r.realized_pnl == pytest.approx(pnl, abs=1e-6)


@pytest.mark.parametrize("partial", [False, True])
@pytest.mark.parametrize("fraction", [0.5, 1.0])
def test_depth_allocation_matches_loop(spark, both_plans, partial, fraction):
    rng = random.Random(5)
    rows, want = [], {}
    for quote in (1, 2, 3):
        left = 40
        for i in range(rng.randint(4, 11)):
            row, q = quote * 100 + i, rng.randint(1, 20)
            rows.append((1, 1, row, "buy", q, quote, 99, 40, 100, 40))
            room = int(left * fraction)
            fill = min(q, room) if partial else (q if q <= room else 0)
            left -= fill
            want[row] = fill
    df = spark.createDataFrame(
        rows, "run_id long, instrument_id long, order_row long, side string, quantity long,"
        " quote_row long, quote_bid long, quote_bid_quantity long, quote_ask long,"
        " quote_ask_quantity long")
    got = ledger.allocate_depth(df, ["order_row"], True, partial, fraction).collect()
    assert {r.order_row: r.fill_quantity for r in got} == want
    assert all((r.rejection is None) == (r.fill_quantity > 0) for r in got)


def test_zero_latency_order_meets_its_own_quote(spark):
    quotes = spark.createDataFrame(
        [(1, s, 100, 100, 9, 5, 10, 5) for s in (1, 2, 3)],
        "instrument_id long, sequence_num long, source_timestamp_ns long, receive_timestamp_ns long,"
        " best_bid_price long, best_bid_quantity long, best_ask_price long, best_ask_quantity long")
    order = spark.createDataFrame([(1, 1, 2, 100)],
                                  "run_id long, instrument_id long, row long, actionable_timestamp_ns long")
    assert ledger.match_quotes(order, quotes, "row").first().quote_row == 2


def test_sweeps(spark, monkeypatch):
    with pytest.raises(ValueError):
        ledger.sweep(spark.range(1), [])
    configs = [{"run_id": r, "capital": r * 10.0} for r in range(7)]
    want = sorted((i, r, r * 10.0) for i in range(3) for r in range(7))
    assert sorted(map(tuple, ledger.sweep(spark.range(3), configs).collect())) == want
    monkeypatch.setattr(ledger, "SWEEP_BLOCK", 2)
    table = spark.createDataFrame([(c["run_id"], c["capital"]) for c in configs], "run_id long, capital double")
    for some in (configs, table):
        assert sorted(map(tuple, ledger.sweep(spark.range(3), some).collect())) == want
    assert ledger.sweep(spark.range(3), table.where("run_id < 0")).collect() == []


@pytest.mark.parametrize("partial, fraction", [(True, 1.0), (True, 0.25), (False, 1.0)])
def test_a_quote_met_by_fifty_thousand_orders(spark, partial, fraction):
    n, depth = 50_000, 200_000
    rng = random.Random(9)
    quantities = [rng.randint(1, 9) if i % 100 else 10_000 for i in range(n)]
    rows = spark.createDataFrame(list(enumerate(quantities)), "order_row long, quantity long").selectExpr(
        "1L run_id", "1L instrument_id", "order_row", "'sell' side", "quantity", "7L quote_row", "100L quote_bid",
        f"{depth}L quote_bid_quantity", "101L quote_ask", "1L quote_ask_quantity")
    want, left = [], depth
    for q in quantities:
        room = int(left * fraction)
        fill = min(q, room) if partial else (q if q <= room else 0)
        want.append((fill, left))
        left -= fill
    spark.conf.set(CHUNK_ROWS_CONF, "3000")
    try:
        got = ledger.allocate_depth(rows.repartition(5), ["order_row"], True, partial, fraction).collect()
    finally:
        spark.conf.unset(CHUNK_ROWS_CONF)
    assert [(r.fill_quantity, r.available_depth) for r in sorted(got, key=lambda r: r.order_row)] == want


def test_limited_fills_through_the_ledger(spark, both_plans):
    """Two orders on one quote: the second gets what is left, and cash, position and profit follow the loop."""
    orders = [(1, "buy", 40, 1), (2, "buy", 30, 1), (3, "sell", 90, 2), (4, "sell", 5, 2), (5, "buy", 20, 3)]
    quotes = {1: (100, 50, 101, 60), 2: (104, 85, 105, 60), 3: (99, 10, 100, 10)}
    rows = [(1, 1, r, side, q, k, k * 10**9, *quotes[k]) for r, side, q, k in orders]
    df = spark.createDataFrame(
        rows, "run_id long, instrument_id long, order_row long, side string, quantity long, quote_row long, fill_timestamp_ns long,"
        " quote_bid long, quote_bid_quantity long, quote_ask long, quote_ask_quantity long")
    got = ledger.allocate_depth(df, ["order_row"], allow_partial=True).where("rejection is null").selectExpr(
        "run_id", "instrument_id", "order_row fill_seq", "quote_row fill_row", "fill_timestamp_ns", "side", "fill_quantity quantity",
        "fill_price price", "0.0D spread_cost", "0.0D slippage_cost", "0.0D exchange_fee", "0.0D regulatory_fee")
    order = ["fill_timestamp_ns", "fill_row", "fill_seq"]
    out = ledger.average_cost(ledger.running_totals(ledger.fill_ledger(got), order), order).orderBy("fill_seq").collect()
    assert [(r.fill_seq, r.quantity, r.position) for r in out] == [(1, 40, 40), (2, 20, 60), (3, 85, -25), (5, 10, -15)]
    assert out[-1].cash_flow == pytest.approx(-60 * 1.01 + 85 * 1.04 - 10 * 1.00)
    assert out[-1].realized_pnl == pytest.approx(60 * 0.03 + 10 * 0.04)


def test_strict_schedule_leaves_early_rows_uncovered(spark):
    from tapeframe.operators.intervals import effective_dated, uncovered

    df = spark.createDataFrame([(1, 0), (2, _ns("2024-06-03T10:00"))], "i long, ts long")
    fees = costs.fee_schedule(spark)
    out = effective_dated(df, fees, "ts", ["sale_fee_rate"], strict=True).orderBy("i").collect()
    assert [r.sale_fee_rate for r in out] == [None, 0.0000278]
    assert [r.i for r in uncovered(df, fees, "ts").collect()] == [1]
    assert effective_dated(df, fees, "ts", ["sale_fee_rate"]).where(F.col("i") == 1).first()[2] == 8e-6


def test_a_second_order_sees_the_depth_that_is_left(spark):
    rows = [(1, 1, 5, "buy", r, q, 100, 101, 50, 60) for r, q in ((1, 40), (2, 30), (3, 5))]
    df = spark.createDataFrame(
        rows, "run_id long, instrument_id long, quote_row long, side string, order_row long, quantity long, quote_bid long,"
        " quote_ask long, quote_bid_quantity long, quote_ask_quantity long")
    for partial, want in ((True, [(40, 60), (20, 20), (0, 0)]), (False, [(40, 60), (0, 20), (5, 20)])):
        got = ledger.allocate_depth(df, ["order_row"], allow_partial=partial).orderBy("order_row").collect()
        assert [(r.fill_quantity, r.available_depth) for r in got] == want


def test_no_nested_loops(spark):
    """Interval and dated joins compare no row with every row of the other side."""
    from tapeframe.plans import registry

    queries = registry.queries()
    for name in ("fee_schedule_join", "regulatory_fees", "running_cash_position", "equity_curve", "label_interval_overlap"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_large_schedules_are_met_by_an_as_of_join(spark):
    from tapeframe.operators.intervals import ARRAY_ROWS, effective_dated

    n = ARRAY_ROWS + 50
    dim = spark.range(n).selectExpr("id * 10 start_ns", "if(id % 7 = 0, id * 10 + 5, id * 10 + 10) end_ns", "id * 1.0D rate")
    df = spark.range(-3, n * 10).selectExpr("id ts")
    want = lambda t: 0.0 if t < 0 else None if t // 10 % 7 == 0 and t % 10 >= 5 else t // 10 * 1.0
    for frame in (dim, dim.where(f"start_ns < {ARRAY_ROWS * 10 - 100}")):
        top = frame.count() * 10
        for r in effective_dated(df.where(F.col("ts") < top), frame, "ts", ["rate"]).collect():
            assert r.rate == want(r.ts), r


@pytest.mark.parametrize("n", [10, 256, 257, 3000])
@pytest.mark.parametrize("strict", [False, True])
def test_nested_schedules_have_one_rule(spark, n, strict):
    """The interval of latest start that holds the time counts, however many rows the dimension has."""
    from tapeframe.operators.intervals import effective_dated

    rng = random.Random(n)
    rows = []
    for k in range(n):
        start = rng.randrange(0, 4 * n)
        rows.append((start, None if rng.random() < 0.01 else start + rng.randrange(0, 40 if k % 9 else 4 * n), k))
    rows += [(5 * n, 5 * n + 100, n), (5 * n + 10, 5 * n + 20, n + 1)]
    dim = spark.createDataFrame(rows, "start_ns long, end_ns long, k long")
    order = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])
    times = [-1, *rng.sample(range(6 * n), min(6 * n, 300)), 5 * n + 15, 5 * n + 50]
    got = effective_dated(spark.createDataFrame([(t,) for t in times], "ts long"), dim, "ts", ["k"], strict=strict).collect()
    for r in got:
        held = [x for x in rows if x[0] <= r.ts and (x[1] is None or r.ts < x[1])]
        first = min(rows, key=order)
        want = max(held, key=order)[2] if held else first[2] if r.ts < first[0] and not strict else None
        assert r.k == want, r


def test_overlap_join_matches_all_pairs(spark):
    from tapeframe.operators.intervals import overlap_join

    rng = random.Random(4)
    labels = [(k, a, a + rng.choice([0, 3, 30, 5000])) for k in range(200) for a in [rng.randrange(-500, 3000)]] + [(999, -10**15, 10**15)]
    blocks = [(j, a, a + rng.choice([0, 1, 40, 1500])) for j in range(30) for a in [rng.randrange(0, 2500)]]
    got = overlap_join(spark.createDataFrame(labels, "k long, obs long, fin long"),
                       spark.createDataFrame(blocks, "j long, block_start long, block_stop long"), "obs", "fin").collect()
    want = sorted((k, j) for k, a, b in labels for j, c, d in blocks if c < d and a < d and b >= c)
    assert sorted((r.k, r.j) for r in got) == want
    none = spark.createDataFrame([], "j long, block_start long, block_stop long")
    assert overlap_join(spark.createDataFrame(labels, "k long, obs long, fin long"), none, "obs", "fin").collect() == []


@pytest.mark.parametrize("rows", [None, "7"])
def test_large_overlapping_schedules_stay_small(spark, rows):
    """Intervals become at most three rows each, in chunks, and nothing of their size is broadcast."""
    from tapeframe.operators import scan
    from tapeframe.operators.intervals import disjoint

    n = 400
    span = lambda k: (k * 10**12, None if k % 97 == 0 else k * 10**12 + (1 + k % 90) * 10**12)
    dim = spark.createDataFrame([(*span(k), None if k % 31 == 0 else 2**60 + k) for k in range(n)], "start_ns long, end_ns long, k long")
    if rows:
        spark.conf.set(scan.CHUNK_ROWS_CONF, rows)
    try:
        got = disjoint(dim, ["k"])
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        segments = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset(scan.CHUNK_ROWS_CONF)
    assert plan.count("Generate") <= 2 and "FlatMapGroupsInArrow" in plan
    for t in range(-1, n + 100):
        held = [k for k in range(n) if span(k)[0] <= t * 10**12 and (span(k)[1] is None or t * 10**12 < span(k)[1])]
        here = [s for s in segments if s[0] <= t * 10**12]
        want = (None if max(held) % 31 == 0 else 2**60 + max(held), True) if held else (None, False)
        assert (here[-1][1:] if here else (None, False)) == want, t


def test_a_summary_of_fills_is_the_end_of_the_curve(spark, both_plans):
    """Fills after the last quote do not count, and a run without fills is all cash; no curve is laid out for it."""
    rng = random.Random(5)
    order = ["fill_timestamp_ns", "fill_row", "fill_seq"]
    fills = [(1, k, t * 10, t, t, rng.choice([-3, -1, 2, 4]), rng.randint(900, 1100), rng.uniform(-50, 50), 7.0, 0.1, 0.2, 0.3, 0.4)
             for t in range(40) for k in (1, 2)]
    led = spark.createDataFrame(
        fills, "run_id long, instrument_id long, fill_timestamp_ns long, fill_row long, fill_seq long, signed_quantity long, price long,"
        " cash_delta double, notional double, spread_cost double, slippage_cost double, exchange_fee double, regulatory_fee double")
    quotes = spark.createDataFrame(
        [(r, k, i, 5 + 9 * (i // 2), 990 + i, 995 + i) for r in (1, 2) for k in (1, 2) for i in range(60)],
        "run_id long, instrument_id long, sequence_num long, receive_timestamp_ns long, best_bid_price long, best_ask_price long")
    got = ledger.summary_of_fills(quotes, led, order, 1000.0)
    names = list(ledger._TOTALS)
    totals = ledger.average_cost(led, order, totals=names).withColumnRenamed("position_after", "position")
    whole = ledger.run_summary(ledger.equity_curve(quotes, totals, 1000.0), ["receive_timestamp_ns", "sequence_num"], 1000.0)
    key = lambda r: (r.run_id, r.instrument_id)
    got, whole = sorted(got.collect(), key=key), sorted(whole.collect(), key=key)
    assert len(got) == 4 and [r.n_quotes for r in got] == [60] * 4
    for g, w in zip(got, whole, strict=True):
        for c in ("n_quotes", "position", "portfolio_equity", "turnover", "realized_pnl", "net_pnl", "total_friction", "gross_pnl"):
            assert g[c] == pytest.approx(w[c]), c
    assert [r.position for r in got if r.run_id == 2] == [0, 0]


def test_the_curve_writes_no_more_than_it_reads_again(spark, monkeypatch):
    """Position, cash and average cost share one scan; costs that the curve does not show are not carried along."""
    from tapeframe.operators import scan
    from tapeframe.plans import accounting as plan

    scans, plain = [], scan.running

    def counted(df, *args, **carries):
        scans.append(df.columns)
        return plain(df, *args, **carries)

    monkeypatch.setattr(ledger, "running", counted)
    plan.equity_curve(spark, "/root/testdata/sf0.001")
    # The orders' targets, the positions beside the cash, and the profit.
    assert len(scans) == 3 and "turnover" not in scans[-1] and "spread_cost" not in scans[-1]
