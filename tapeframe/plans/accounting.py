"""Registered calendar, cost and ledger queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeframe import contracts
from tapeframe.operators import calendar as cal
from tapeframe.operators import costs, extension, ledger
from tapeframe.operators import features as feat
from tapeframe.operators.intervals import effective_dated
from tapeframe.plans.duck import FILLS, QUOTES, VALID_QUOTES
from tapeframe.sources import views

CASH = 1_000_000.0
VOL = 0.01
RUNS = [
    {"run_id": 1, "capital": 100_000.0, "latency_ns": 10**9},
    {"run_id": 2, "capital": 250_000.0, "latency_ns": 6 * 3600 * 10**9},
]
COSTS = costs.CostConfig(fixed_slippage_per_share=0.001, slippage_impact=0.1)
# The tape starts on New Year's Eve, Eastern time, a day before the verified calendar.
TAPE_COSTS = costs.CostConfig(
    fixed_slippage_per_share=0.001, slippage_impact=0.1, charge_rule="trade_date"
)


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def settled(c, digits):
    """Column ``c`` to so many digits, by way of six, so that both engines' last bits fall on one side of a half."""
    return F.round(F.col(c).cast("decimal(38,6)"), digits).cast("double").alias(c)


def eastern_dates(spark, sf):
    return views.fills(spark, sf).select(
        "fill_seq", "fill_timestamp_ns", cal.eastern_date("fill_timestamp_ns").alias("eastern_date")
    )


def calendar_join(spark, sf):
    days = F.broadcast(cal.settlement_calendar(spark)).select("day", "is_business", "is_holiday")
    f = views.fills(spark, sf).select(
        "fill_seq", cal.eastern_date("fill_timestamp_ns").alias("day")
    )
    return f.join(days, "day", "left")


def trade_date_resolution(spark, sf):
    return cal.with_trade_dates(
        views.fills(spark, sf).select("fill_seq", "fill_timestamp_ns"), "fill_timestamp_ns"
    )


def fee_schedule_join(spark, sf):
    f = views.fills(spark, sf).select("fill_seq", "fill_timestamp_ns")
    return effective_dated(
        f, costs.fee_schedule(spark), "fill_timestamp_ns",
        ["start_date", "sale_fee_rate", "activity_fee_rate", "activity_fee_max", "taker_fee"],
    )


def overlapping_schedule_join(spark, sf):
    """Fills beside dated rows that overlap and nest: of those that hold a fill the one of latest start counts."""
    ns = "unix_micros(cast(ts as timestamp)) * 1000"
    length = "(1 + event_id % 97) * 60000000000"
    dim = views.table(spark, sf, "events").selectExpr(
        f"{ns} + event_id % 1000 start_ns", f"if(event_id % 1000 = 0, null, {ns} + event_id % 1000 + {length}) end_ns", "event_id")
    f = views.fills(spark, sf).select("fill_seq", "fill_timestamp_ns")
    return effective_dated(f, dim, "fill_timestamp_ns", ["event_id"], strict=True)


def spread_cost(spark, sf):
    return costs.with_spread_cost(views.fills(spark, sf)).select("fill_seq", "spread_cost")


def slippage_cost(spark, sf):
    f = costs.with_slippage_cost(views.fills(spark, sf), COSTS)
    return _round(f.select("fill_seq", "slippage_cost"), "slippage_cost", digits=9)


def regulatory_fees(spark, sf):
    f = costs.with_regulatory_costs(views.fills(spark, sf), config=COSTS)
    return _round(
        f.select("fill_seq", "exchange_fee", "sale_fee", "activity_fee", "regulatory_fee"),
        "exchange_fee", "sale_fee", "activity_fee", "regulatory_fee", digits=9,
    )


# --- signals to equity ---------------------------------------------------------------------------


def _signals(spark, sf):
    q = feat.with_weighted_mid(feat.with_quote_validity(views.quotes(spark, sf)))
    q = q.select(
        "instrument_id", "sequence_num", "receive_timestamp_ns", "best_bid_price", "best_ask_price", "is_valid",
        F.expr("coalesce(book_imbalance_top, 0.0D)").alias("target_weight"),
    )
    return ledger.sweep(q, RUNS)


def _orders(spark, sf):
    o = ledger.target_orders(_signals(spark, sf), ["receive_timestamp_ns", "sequence_num"])
    return ledger.with_latency(o, "receive_timestamp_ns", "latency_ns").select(
        "run_id", "instrument_id", F.col("sequence_num").alias("order_row"),
        F.col("receive_timestamp_ns").alias("decision_timestamp_ns"), "actionable_timestamp_ns",
        "target_quantity", "side", "quantity",
    )


def signal_orders(spark, sf):
    return _orders(spark, sf)


def _matched(spark, sf):
    return ledger.match_quotes(_orders(spark, sf), views.quotes(spark, sf), "order_row")


def order_quote_match(spark, sf):
    return _matched(spark, sf).select(
        "run_id", "instrument_id", "order_row", "quote_row", "fill_timestamp_ns", "quote_bid",
        "quote_ask",
    )


def order_rejections(spark, sf):
    m = ledger.allocate_depth(_matched(spark, sf), ["order_row"], enforce=False)
    return m.groupBy("run_id", F.coalesce("rejection", F.lit("filled")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("fill_quantity").alias("quantity")
    )


def depth_allocation_partial(spark, sf):
    m = ledger.allocate_depth(_matched(spark, sf), ["order_row"], allow_partial=True)
    return m.select("run_id", "instrument_id", "order_row", "fill_quantity", "rejection")


def depth_allocation_all_or_none(spark, sf):
    m = ledger.allocate_depth(_matched(spark, sf), ["order_row"], fraction=0.5)
    return m.select("run_id", "instrument_id", "order_row", "fill_quantity", "rejection")


UNLIMITED = {"enforce": False}
PARTIAL = {"allow_partial": True}
ALL_OR_NONE = {"fraction": 0.5}


def _fills(spark, sf, limits=UNLIMITED):
    m = ledger.allocate_depth(_matched(spark, sf), ["order_row"], **limits)
    f = m.where(F.col("rejection").isNull()).select(
        "run_id", "instrument_id", F.col("order_row").alias("fill_seq"),
        F.col("quote_row").alias("fill_row"), "fill_timestamp_ns", "side",
        F.col("fill_quantity").alias("quantity"), F.col("fill_price").alias("price"), "quote_bid",
        "quote_ask", F.col("available_depth").alias("reference_volume"),
        F.lit(VOL).alias("realized_volatility"),
    )
    return costs.with_costs(f, config=TAPE_COSTS)


FILL_ORDER = ["fill_timestamp_ns", "fill_row", "fill_seq"]
_COSTS = ["spread_cost", "slippage_cost", "exchange_fee", "regulatory_fee"]


def _ledger(spark, sf, limits=UNLIMITED):
    return ledger.fill_ledger(_fills(spark, sf, limits))


def fill_ledger(spark, sf, limits=UNLIMITED):
    out = _ledger(spark, sf, limits).select(
        "run_id", "instrument_id", "fill_seq", "side", "quantity", "price", *_COSTS, "notional",
        "cash_delta",
    )
    return _round(_round(out, *_COSTS, digits=9), "notional", "cash_delta")


def fill_ledger_limited(spark, sf):
    """The ledger of fills that take what earlier orders left of the displayed depth."""
    return fill_ledger(spark, sf, PARTIAL)


def fill_ledger_all_or_none(spark, sf):
    """The ledger of orders that half of the depth left can fill whole."""
    return fill_ledger(spark, sf, ALL_OR_NONE)


def running_cash_position_limited(spark, sf):
    return running_cash_position(spark, sf, PARTIAL)


def running_cash_position(spark, sf, limits=UNLIMITED):
    out = ledger.running_totals(_ledger(spark, sf, limits), FILL_ORDER).select(
        "run_id", "instrument_id", "fill_seq", "position", "cash_flow", "turnover",
        "volume_traded", "cum_spread_cost", "cum_slippage_cost", "cum_exchange_fee",
        "cum_regulatory_fee",
    )
    out = _round(out, "cash_flow", "turnover", digits=3)
    out = _round(out, "cum_spread_cost", "cum_slippage_cost", "cum_exchange_fee")
    return _round(out, "cum_regulatory_fee", digits=8)


def average_cost_pnl(spark, sf):
    fills = views.fills(spark, sf).selectExpr(
        "1 run_id", "instrument_id", "fill_timestamp_ns", "fill_seq", "price", "quantity",
        "if(side = 'buy', quantity, -quantity) signed_quantity",
    )
    out = ledger.average_cost(fills, ["fill_timestamp_ns", "fill_seq"]).select(
        "instrument_id", "fill_seq", "position_after", "average_entry_price", "realized_delta",
        "realized_pnl",
    )
    return _round(out, "average_entry_price", "realized_delta", "realized_pnl", digits=3)


def _equity_inputs(spark, sf, limits, costs_too):
    """Quotes of every run and the ledger, each with no more than the marks need."""
    quotes = views.quotes(spark, sf).select(
        "instrument_id", "sequence_num", "receive_timestamp_ns", "best_bid_price", "best_ask_price")
    led = _ledger(spark, sf, limits).select(
        *ledger.KEYS, *FILL_ORDER, "price", "signed_quantity", "cash_delta", *(["notional", *_COSTS] if costs_too else []))
    return ledger.sweep(quotes, [{"run_id": r["run_id"]} for r in RUNS]), led


def equity_curve_limited(spark, sf):
    return equity_curve(spark, sf, PARTIAL)


def equity_curve(spark, sf, limits=UNLIMITED):
    quotes, led = _equity_inputs(spark, sf, limits, costs_too=False)
    totals = ledger.average_cost(led, FILL_ORDER, totals=["cash_flow"]).select(
        *ledger.KEYS, *FILL_ORDER, F.col("position_after").alias("position"), "cash_flow", "average_entry_price", "realized_pnl")
    out = ledger.equity_curve(quotes, totals, CASH).select(
        "run_id", "instrument_id", "sequence_num", "cash", "position", "market_mid_price",
        "portfolio_equity", "realized_pnl", "unrealized_pnl",
    )
    money = {c: settled(c, 3) for c in ("cash", "portfolio_equity", "realized_pnl", "unrealized_pnl")}
    return out.withColumns(money)


def run_summary_limited(spark, sf):
    return run_summary(spark, sf, PARTIAL)


def run_summary_all_or_none(spark, sf):
    return run_summary(spark, sf, ALL_OR_NONE)


def run_summary(spark, sf, limits=UNLIMITED):
    out = ledger.summary_of_fills(*_equity_inputs(spark, sf, limits, costs_too=True), FILL_ORDER, CASH).select(
        "run_id", "instrument_id", "n_quotes", "position", "portfolio_equity", "turnover",
        "realized_pnl", "net_pnl", "total_friction", "gross_pnl",
    )
    return _round(out, *out.columns[4:], digits=3)


def flat_benchmark(spark, sf):
    return ledger.flat_signals(views.quotes(spark, sf))


def strategy_signals(spark, sf):
    """A strategy that leans to the heavier side when it is heavier than usual."""
    q = feat.with_quote_validity(views.quotes(spark, sf))
    lean = F.col("best_bid_quantity") - F.col("best_ask_quantity")

    def fit(train):
        return train.where("is_valid").agg((F.sum(F.abs(lean)) / F.count(F.lit(1))).alias("usual"))

    def signals(features, learned):
        heavy = F.col("is_valid") & (F.abs(lean) >= learned.scalar())
        side = F.when(heavy, F.signum(lean)).otherwise(0.0)
        return features.select(
            F.col("receive_timestamp_ns").alias("decision_timestamp_ns"), "instrument_id", side.alias("direction"),
            (side * 0.5).alias("target_weight"), F.abs(side).alias("strength"), F.lit(1.0).alias("confidence"), "is_valid")

    return extension.strategy_signals(q, q, fit, signals)


def normalised_feed(spark, sf):
    """Raw events as rows of the trade contract."""
    def normaliser(raw):
        ns = "unix_micros(cast(ts as timestamp)) * 1000"
        return raw.selectExpr(
            "1 version", "1 message_type", "0 flags", "1 venue_id", "user_id % 4 feed_id", "user_id % 8 instrument_id", "0 checksum",
            "event_id + 1 sequence_num", f"{ns} source_timestamp_ns", f"{ns} + 500000 receive_timestamp_ns", "event_id trade_id",
            "round(value * 100) + 1 price", "1 + event_id % 500 quantity", "if(event_id % 3 = 0, 2, 1) aggressor_side",
            "event_id * 2 maker_order_id", "event_id * 2 + 1 taker_order_id")

    return extension.normalise(views.table(spark, sf, "events"), normaliser, contracts.TRADE)


def signal_audit(spark, sf):
    s = views.quotes(spark, sf).selectExpr(
        "cast(sequence_num % 5 - 2 as tinyint) direction",
        "(sequence_num % 27 - 13) / 12.0D target_weight", "sequence_num % 13 / 12.0D strength",
        "sequence_num % 14 / 12.0D confidence", "sequence_num % 3 <> 0 is_valid",
    )
    return ledger.signal_audit(s)


def order_audit(spark, sf):
    o = views.trades(spark, sf).selectExpr(
        "source_timestamp_ns decision_timestamp_ns",
        "source_timestamp_ns + sequence_num % 10 - 1 actionable_timestamp_ns",
        "source_timestamp_ns + sequence_num % 7 - 5 signal_event_timestamp_ns",
        "if(sequence_num % 4 = 0, null, source_timestamp_ns - 1) signal_available_timestamp_ns",
        "quantity - sequence_num % 3 quantity",
        "if(sequence_num % 2 = 0, 'limit', 'market') order_type",
        "if(sequence_num % 3 = 0, price, null) limit_price",
    )
    return ledger.order_audit(o)


def fill_audit(spark, sf):
    f = _fills(spark, sf).withColumn("quantity", F.col("quantity") - F.col("fill_row") % 2 * 50)
    return ledger.fill_audit(f)


# --- oracles -------------------------------------------------------------------------------------

_ET = "(to_timestamp(fill_timestamp_ns // 1000000000) at time zone 'America/New_York')"

_CALENDAR = """days as (
 select cast(d as date) as day, year(d) y, month(d) m, day(d) dd, isodow(d) wd
 from generate_series(date '2023-12-20', date '2033-01-31', interval 1 day) t(d)),
easters as (
 select y, make_date(y, 3, 22) + cast(d + e as integer) easter from (
  select y, d, (2 * (y % 4) + 4 * (y % 7) + 6 * d + 5) % 7 e from (
   select y, (19 * (y % 19) + 24) % 30 d from range(2023, 2034) r(y)))),
fixed as (
 select make_date(y, m, d) f from range(2024, 2034) a(y),
  (values (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) b(m, d)),
observed as (
 select case isodow(f) when 6 then f - 1 when 7 then f + 1 else f end h from fixed),
flags as (
 select days.day, wd > 5 is_weekend, days.y between 2024 and 2032 and (
   days.day in (select h from observed) or days.day in (select easter - 2 from easters)
   or (m in (1, 2) and wd = 1 and dd between 15 and 21) or (m = 5 and wd = 1 and dd >= 25)
   or (m = 9 and wd = 1 and dd <= 7) or (m = 10 and wd = 1 and dd between 8 and 14)
   or (m = 11 and wd = 4 and dd between 22 and 28)) is_holiday from days),
biz as (
 select *, not is_weekend and not is_holiday is_business from flags),
nums as (
 select day, row_number() over (order by day) n from biz where is_business),
cal as (
 select b.day, is_business, is_holiday, r.day next_business_day, c.day clearing_day,
  s.day settlement_day
 from (select *, cast(sum(is_business::int) over (order by day) as bigint) o from biz) b
 left join nums r on r.n = b.o + 1
 left join nums c on c.n = b.o + case when is_business then 0 else 1 end
 left join nums s on s.n = b.o + case when is_business then 0 else 1 end
  + case when b.day < date '2024-05-28' then 2 else 1 end)"""

_DATES = _CALENDAR + f""", dated as (
 select f.*, cast({_ET} as date) trade_date, hour({_ET}) >= 20 late,
  {_ET} - cast(cast({_ET} as date) as timestamp) clock from fills f),
resolved as (
 select d.*, case when late or not is_business then next_business_day else trade_date end
   reporting_date, late or not is_business is_as_of_reporting, clearing_day clearing_date,
  settlement_day settlement_date, settlement_day charge_date,
  epoch_us((settlement_day::timestamp + clock) at time zone 'America/New_York') * 1000
   + fill_timestamp_ns % 1000000000 settlement_timestamp_ns,
  cal.day is null is_outside_calendar
 from dated d left join cal on d.trade_date = cal.day and year(cal.day) between 2024 and 2032)"""

_SCHEDULE = """schedule0 as (
 select * from (values
  (date '2024-01-01', 0.0000080::double, 0.000195::double, 9.79::double),
  (date '2024-05-22', 0.0000278::double, 0.000195::double, 9.79::double),
  (date '2025-05-14', 0.0::double, 0.000195::double, 9.79::double),
  (date '2026-04-04', 0.0000206::double, 0.000195::double, 9.79::double),
  (date '2026-10-01', 0.0000206::double, 0.0::double, 0.0::double),
  (date '2027-01-01', 0.0000206::double, 0.000195::double, 9.79::double),
  (date '2029-01-01', 0.0000206::double, 0.000232::double, 11.61::double),
  (date '2030-01-01', 0.0000206::double, 0.000240::double, 12.05::double),
  (date '2031-01-01', 0.0000206::double, 0.000249::double, 12.50::double))
  t(start_date, sale_fee_rate, activity_fee_rate, activity_fee_max)),
schedule as (
 select *, epoch_us(start_date::timestamp at time zone 'America/New_York') * 1000 start_ns
 from schedule0)"""

_REG = f"with {FILLS}, {_DATES}, {_SCHEDULE}" + """, priced as (
 select r.*, t.activity_fee_rate, t.activity_fee_max, c.sale_fee_rate
 from resolved r asof join schedule t on r.fill_timestamp_ns >= t.start_ns
 asof join schedule c on r.settlement_timestamp_ns >= c.start_ns),
fees as (
 select fill_seq, 0.0030::double * quantity exchange_fee,
  case when side = 'sell' then sale_fee_rate * (price * quantity / 100.0::double) else 0 end
   sale_fee,
  case when side = 'sell' and activity_fee_rate > 0
    and price / 100.0::double >= activity_fee_rate
   then least(activity_fee_rate * quantity, activity_fee_max) else 0 end activity_fee
 from priced)
select fill_seq, round(exchange_fee, 9) exchange_fee, round(sale_fee, 9) sale_fee,
 round(activity_fee, 9) activity_fee, round(sale_fee + activity_fee, 9) regulatory_fee from fees"""

_RUNS = ", ".join(
    f"({r['run_id']}, {r['capital']}::double, {r['latency_ns']})" for r in RUNS
)

_MATCH = QUOTES + f""", sig as (
 select run_id, capital, latency_ns, q.*,
  best_bid_price < best_ask_price and best_bid_quantity > 0 and best_ask_quantity > 0
   and best_bid_price > 0 usable,
  (best_bid_price + best_ask_price) / 200.0::double mid,
  (best_bid_quantity - best_ask_quantity)::double / (best_bid_quantity + best_ask_quantity) w
 from quotes q, (values {_RUNS}) c(run_id, capital, latency_ns)),
targets as (
 select *, case when usable then cast(round_even(capital * w / mid, 0) as bigint) end target
 from sig),
chained as (
 select *, coalesce(last_value(target ignore nulls) over (partition by run_id, instrument_id
  order by receive_timestamp_ns, sequence_num rows between unbounded preceding and 1 preceding), 0)
  before from targets),
orders_ as (
 select run_id, instrument_id, sequence_num order_row, receive_timestamp_ns decision_timestamp_ns,
  receive_timestamp_ns + latency_ns actionable_timestamp_ns, target target_quantity,
  case when target > before then 'buy' else 'sell' end side, abs(target - before) quantity
 from chained where target is not null and target <> before),
matched as (
 select o.*, q.sequence_num quote_row, q.receive_timestamp_ns fill_timestamp_ns,
  q.best_bid_price quote_bid, q.best_ask_price quote_ask,
  case when side = 'buy' then best_ask_price else best_bid_price end fill_price,
  case when side = 'buy' then best_ask_quantity else best_bid_quantity end available_depth,
  case when q.sequence_num is null then 'unmatched'
   when q.best_bid_price <= 0 or q.best_ask_price <= 0 then 'bad_quote'
   when q.best_bid_price >= q.best_ask_price then 'crossed' end pre
 from orders_ o asof left join quotes q on o.instrument_id = q.instrument_id
  and o.actionable_timestamp_ns <= q.receive_timestamp_ns)"""

#: How orders take depth, each as the table ``taken``: ``matched`` with the quantity filled and the depth found.
_TAKE_ALL = """, taken as (select * from matched where pre is null)"""
_TAKE_LEFT = """, ahead as (select *, coalesce(sum(quantity) over (partition by run_id, instrument_id, quote_row, side
  order by order_row rows between unbounded preceding and 1 preceding), 0) gone from matched where pre is null),
taken as (select * replace (cast(greatest(0, least(quantity, available_depth - gone)) as bigint) as quantity,
  cast(greatest(0, available_depth - gone) as bigint) as available_depth) from ahead where available_depth > gone)"""
_TAKE_WHOLE = """, turns as (
 select *, row_number() over (partition by run_id, instrument_id, quote_row, side order by order_row) rn
 from matched where pre is null),
walk as (
 select t.* exclude (rn), rn, available_depth found, case when quantity <= available_depth // 2 then quantity else 0 end fill
 from turns t where rn = 1
 union all
 select t.* exclude (rn), t.rn, w.found - w.fill, case when t.quantity <= (w.found - w.fill) // 2 then t.quantity else 0 end
 from walk w join turns t on t.run_id = w.run_id and t.instrument_id = w.instrument_id
  and t.quote_row = w.quote_row and t.side = w.side and t.rn = w.rn + 1),
taken as (select * replace (cast(found as bigint) as available_depth) from walk where fill > 0)"""


def _ledger_sql(take: str) -> str:
    return _MATCH + take + f""", filled as (
 select run_id, instrument_id, order_row fill_seq, quote_row fill_row, fill_timestamp_ns, side,
  quantity, fill_price price,
  greatest(0, case when side = 'buy' then quote_ask - (quote_bid + quote_ask) / 2.0::double
   else (quote_bid + quote_ask) / 2.0::double - quote_bid end / 100.0::double * quantity)
   spread_cost,
  (0.001::double + 0.1::double * ((quote_bid + quote_ask) / 2.0::double / 100.0::double)
   * {VOL}::double * case when available_depth > 0 then sqrt(quantity / available_depth::double)
   else 1 end) * quantity slippage_cost,
  0.0030::double * quantity exchange_fee,
  case when side = 'sell' then 0.0000080::double * (fill_price * quantity / 100.0::double)
   + least(0.000195::double * quantity, 9.79::double) else 0 end regulatory_fee
 from taken),
led as (
 select *, case when side = 'buy' then quantity else -quantity end sq,
  price * quantity / 100.0::double notional,
  case when side = 'buy' then -(price * quantity / 100.0::double
    + (slippage_cost + exchange_fee + regulatory_fee))
   else price * quantity / 100.0::double - (slippage_cost + exchange_fee + regulatory_fee) end
   cash_delta from filled)"""


_LEDGER = _ledger_sql(_TAKE_ALL)

_MONEY_SUMS = ", ".join(
    f"cast(sum({c}::decimal(38, 12)) over w as double) {t}" for t, c in (
        ("cash_flow", "cash_delta"), ("turnover", "notional"), ("cum_spread_cost", "spread_cost"),
        ("cum_slippage_cost", "slippage_cost"), ("cum_exchange_fee", "exchange_fee"),
        ("cum_regulatory_fee", "regulatory_fee"))
)


def _totals_sql(take: str) -> str:
    return _ledger_sql(take) + f""", tot as (
 select *, cast(sum(sq) over w as bigint) position,
  cast(sum(quantity) over w as bigint) volume_traded, {_MONEY_SUMS},
  row_number() over w rn
 from led window w as (partition by run_id, instrument_id
  order by fill_timestamp_ns, fill_row, fill_seq rows unbounded preceding))"""


def walk_pnl(src: str, keys: str) -> str:
    """Recursive walk over ``src`` (keys, rn, sq, px): one fill of every key per step."""
    same = " and ".join(f"s.{k} = w.{k}" for k in keys.split(", "))
    qualified = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""pnl as (
 select {keys}, rn, sq pos, px entry, 0.0::double delta, 0.0::double pnl from {src} where rn = 1
 union all
 select {qualified}, s.rn, w.pos + s.sq,
  case when w.pos + s.sq = 0 then 0 when w.pos = 0 or w.pos * (w.pos + s.sq) < 0 then s.px
   when w.pos * s.sq > 0
    then (abs(w.pos) * w.entry + abs(s.sq) * s.px) / (abs(w.pos) + abs(s.sq))
   else w.entry end,
  case when w.pos * s.sq < 0 then least(abs(w.pos), abs(s.sq))
   * case when w.pos > 0 then s.px - w.entry else w.entry - s.px end else 0 end,
  w.pnl + case when w.pos * s.sq < 0 then least(abs(w.pos), abs(s.sq))
   * case when w.pos > 0 then s.px - w.entry else w.entry - s.px end else 0 end
 from pnl w join {src} s on {same} and s.rn = w.rn + 1)"""


def _equity_sql(take: str) -> str:
    return (
        "with recursive " + _totals_sql(take)
        + ", steps as (select run_id, instrument_id, rn, sq, price / 100.0::double px from tot), "
        + walk_pnl("steps", "run_id, instrument_id")
        + f""", state as (
 select tot.*, pnl.entry, pnl.pnl from tot join pnl using (run_id, instrument_id, rn)),
latest as (
 select run_id, instrument_id, fill_timestamp_ns, max(rn) rn from state group by 1, 2, 3),
eq0 as (
 select r.run_id, q.instrument_id, q.sequence_num, q.receive_timestamp_ns,
  case when best_bid_price > 0 and best_ask_price > 0
   then (best_bid_price + best_ask_price) / 200.0::double else 0 end mid, l.rn
 from (select *, unnest([{', '.join(str(r['run_id']) for r in RUNS)}]) run_id from quotes) q
 join (select unnest([{', '.join(str(r['run_id']) for r in RUNS)}]) run_id) r using (run_id)
 asof left join latest l on q.run_id = l.run_id and q.instrument_id = l.instrument_id
  and q.receive_timestamp_ns >= l.fill_timestamp_ns),
eq as (
 select e.run_id, e.instrument_id, e.sequence_num, e.receive_timestamp_ns, mid market_mid_price,
  {CASH}::double + coalesce(cash_flow, 0) cash, coalesce(position, 0) position,
  coalesce(s.entry, 0) entry, coalesce(s.pnl, 0) realized_pnl, coalesce(turnover, 0) turnover,
  coalesce(cum_spread_cost + cum_slippage_cost + cum_exchange_fee + cum_regulatory_fee, 0) friction
 from eq0 e left join state s on s.run_id = e.run_id and s.instrument_id = e.instrument_id
  and s.rn = e.rn)"""
    )


def _ledger_oracles(take: str, suffix: str) -> dict[str, str]:
    return {
        f"fill_ledger{suffix}": f"""with recursive {_ledger_sql(take)} select run_id, instrument_id, fill_seq, side, quantity, price,
 round(spread_cost, 9) spread_cost, round(slippage_cost, 9) slippage_cost,
 round(exchange_fee, 9) exchange_fee, round(regulatory_fee, 9) regulatory_fee,
 round(notional, 6) notional, round(cash_delta, 6) cash_delta from led""",
        f"running_cash_position{suffix}": f"""with recursive {_totals_sql(take)} select run_id, instrument_id, fill_seq, position,
 round(cash_flow, 3) cash_flow, round(turnover, 3) turnover, volume_traded,
 round(cum_spread_cost, 6) cum_spread_cost, round(cum_slippage_cost, 6) cum_slippage_cost,
 round(cum_exchange_fee, 6) cum_exchange_fee, round(cum_regulatory_fee, 8) cum_regulatory_fee
 from tot""",
        f"equity_curve{suffix}": _equity_sql(take) + """ select run_id, instrument_id, sequence_num, round(cash::decimal(38, 6), 3)::double cash,
 position, market_mid_price, round((cash + position * market_mid_price)::decimal(38, 6), 3)::double portfolio_equity,
 round(realized_pnl::decimal(38, 6), 3)::double realized_pnl, round((case when position <> 0 and market_mid_price > 0
  then position * (market_mid_price - entry) else 0 end)::decimal(38, 6), 3)::double unrealized_pnl from eq""",
        f"run_summary{suffix}": _equity_sql(take) + f""", fin as (select run_id, instrument_id, count(*) n_quotes,
 arg_max(eq, receive_timestamp_ns) e from eq group by 1, 2)
select run_id, instrument_id, n_quotes, e.position,
 round(e.cash + e.position * e.market_mid_price, 3) portfolio_equity, round(e.turnover, 3) turnover,
 round(e.realized_pnl, 3) realized_pnl,
 round(e.cash + e.position * e.market_mid_price - {CASH}, 3) net_pnl,
 round(e.friction, 3) total_friction,
 round(e.cash + e.position * e.market_mid_price - {CASH} + e.friction, 3) gross_pnl from fin""",
    }


QUERIES = {
    f.__name__: f
    for f in (
        eastern_dates, calendar_join, trade_date_resolution, fee_schedule_join,
        overlapping_schedule_join, spread_cost,
        slippage_cost, regulatory_fees, signal_orders, order_quote_match, order_rejections,
        depth_allocation_partial, depth_allocation_all_or_none, fill_ledger, fill_ledger_limited,
        fill_ledger_all_or_none, running_cash_position, running_cash_position_limited,
        average_cost_pnl, equity_curve, equity_curve_limited, run_summary, run_summary_limited,
        run_summary_all_or_none, flat_benchmark,
        strategy_signals, normalised_feed,
        signal_audit, order_audit, fill_audit,
    )
}


def _audit(src: str, rules: dict[str, str]) -> str:
    return _audit_cte(f"s as ({src})", rules)


def _audit_cte(ctes: str, rules: dict[str, str]) -> str:
    """``ctes`` must end by defining ``s``."""
    names = ", ".join(f"'{n}'" for n in rules)
    counts = ", ".join(f"count(*) filter (not coalesce(({ok}), false))" for ok in rules.values())
    return f"with {ctes} select unnest([{names}]) rule, unnest([{counts}]) violations from s"


ORACLES = {
    "eastern_dates": f"with {FILLS} select fill_seq, fill_timestamp_ns, cast({_ET} as date)"
    " eastern_date from fills",
    "calendar_join": f"with {FILLS}, {_CALENDAR} select fill_seq, cast({_ET} as date) as day,"
    f" is_business, is_holiday from fills left join cal on cal.day = cast({_ET} as date)",
    "trade_date_resolution": f"with {FILLS}, {_DATES} select fill_seq, fill_timestamp_ns,"
    " trade_date, reporting_date, is_as_of_reporting, clearing_date, settlement_date, charge_date,"
    " settlement_timestamp_ns, is_outside_calendar from resolved",
    "fee_schedule_join": f"with {FILLS}, {_SCHEDULE} select fill_seq, fill_timestamp_ns,"
    " start_date, sale_fee_rate, activity_fee_rate, activity_fee_max, 0.0030::double taker_fee"
    " from fills asof join schedule on fill_timestamp_ns >= start_ns",
    "overlapping_schedule_join": f"""with {FILLS}, dim as (
 select event_id, epoch_us(ts) * 1000 + event_id % 1000 start_ns, case when event_id % 1000 <> 0
  then epoch_us(ts) * 1000 + event_id % 1000 + (1 + event_id % 97) * 60000000000 end end_ns from events),
held as (
 select fill_seq, arg_max(event_id, (start_ns, end_ns, event_id)) event_id from fills join dim
 on start_ns <= fill_timestamp_ns and (end_ns is null or fill_timestamp_ns < end_ns) group by 1)
select fill_seq, fill_timestamp_ns, event_id from fills left join held using (fill_seq)""",
    "spread_cost": f"""with {FILLS} select fill_seq, greatest(0, case when side = 'buy'
 then quote_ask - (quote_bid + quote_ask) / 2.0::double
 else (quote_bid + quote_ask) / 2.0::double - quote_bid end / 100.0::double * quantity)
 spread_cost from fills""",
    "slippage_cost": f"""with {FILLS} select fill_seq, round((0.001::double
 + case when realized_volatility > 0 then 0.1::double
  * ((quote_bid + quote_ask) / 2.0::double / 100.0::double) * realized_volatility
  * case when reference_volume > 0 then sqrt(quantity / reference_volume::double) else 1 end
  else 0 end) * quantity, 9) slippage_cost from fills""",
    "regulatory_fees": _REG,
    "signal_orders": f"with {_MATCH} select * from orders_",
    "order_quote_match": f"with {_MATCH} select run_id, instrument_id, order_row, quote_row,"
    " fill_timestamp_ns, quote_bid, quote_ask from matched",
    "order_rejections": f"""with {_MATCH} select run_id, coalesce(pre, 'filled') outcome,
 count(*) n_orders, cast(sum(case when pre is null then quantity else 0 end) as bigint) quantity
 from matched group by 1, 2""",
    "depth_allocation_partial": f"""with {_MATCH}, c as (select *, coalesce(sum(quantity) over (
  partition by run_id, instrument_id, quote_row, side order by order_row
  rows between unbounded preceding and 1 preceding), 0) taken from matched where pre is null),
f as (select *, cast(greatest(0, least(quantity, available_depth - taken)) as bigint) fq from c)
select run_id, instrument_id, order_row, fq fill_quantity,
 case when fq <= 0 then 'zero_depth' end rejection from f
union all select run_id, instrument_id, order_row, 0, pre from matched where pre is not null""",
    "depth_allocation_all_or_none": f"""with recursive {_MATCH}, turns as (
 select *, row_number() over (partition by run_id, instrument_id, quote_row, side
  order by order_row) rn from matched where pre is null),
walk as (
 select run_id, instrument_id, quote_row, side, order_row, rn,
  case when quantity <= available_depth // 2 then quantity else 0 end fill,
  available_depth - case when quantity <= available_depth // 2 then quantity else 0 end rest
 from turns where rn = 1
 union all
 select t.run_id, t.instrument_id, t.quote_row, t.side, t.order_row, t.rn,
  case when t.quantity <= w.rest // 2 then t.quantity else 0 end,
  w.rest - case when t.quantity <= w.rest // 2 then t.quantity else 0 end
 from walk w join turns t on t.run_id = w.run_id and t.instrument_id = w.instrument_id
  and t.quote_row = w.quote_row and t.side = w.side and t.rn = w.rn + 1)
select run_id, instrument_id, order_row, fill fill_quantity,
 case when fill <= 0 then 'insufficient_depth' end rejection from walk
union all select run_id, instrument_id, order_row, 0, pre from matched where pre is not null""",
    "average_cost_pnl": f"with recursive {FILLS}" + """, steps as (
 select instrument_id, fill_seq, row_number() over (partition by instrument_id
  order by fill_timestamp_ns, fill_seq) rn,
  case when side = 'buy' then quantity else -quantity end sq, price / 100.0::double px
 from fills), """ + walk_pnl("steps", "instrument_id") + """
select instrument_id, fill_seq, pos position_after, round(entry, 3) average_entry_price,
 round(delta, 3) realized_delta, round(pnl, 3) realized_pnl
 from pnl join steps using (instrument_id, rn)""",
    "strategy_signals": f"""with {VALID_QUOTES}, usual as (
 select sum(abs(best_bid_quantity - best_ask_quantity))::double / count(*) u from vq where is_valid),
leaning as (select vq.*, case when is_valid and abs(best_bid_quantity - best_ask_quantity) >= u
  then sign(best_bid_quantity - best_ask_quantity) else 0 end d from vq, usual)
select receive_timestamp_ns decision_timestamp_ns, instrument_id, d::tinyint direction, d * 0.5::double target_weight,
 abs(d)::double strength, 1.0::double confidence, is_valid from leaning""",
    "normalised_feed": """select 1::smallint as version, 1::smallint message_type, 0 flags, 1 venue_id,
 (user_id % 4)::int feed_id, (user_id % 8)::bigint instrument_id, 0 checksum, (event_id + 1)::bigint sequence_num,
 epoch_us(ts) * 1000 source_timestamp_ns, epoch_us(ts) * 1000 + 500000 receive_timestamp_ns, event_id::bigint trade_id,
 cast(round(value * 100) as bigint) + 1 price, (1 + event_id % 500)::bigint quantity,
 (case when event_id % 3 = 0 then 2 else 1 end)::smallint aggressor_side, (event_id * 2)::bigint maker_order_id,
 (event_id * 2 + 1)::bigint taker_order_id from events""",
    "flat_benchmark": f"""with {QUOTES} select receive_timestamp_ns decision_timestamp_ns,
 instrument_id, cast(0 as tinyint) direction, 0.0::double target_weight, 0.0::double strength,
 0.0::double confidence, true is_valid from quotes""",
    "signal_audit": _audit(
        f"""with {QUOTES} select cast(sequence_num % 5 - 2 as tinyint) direction,
 (sequence_num % 27 - 13) / 12.0::double target_weight, sequence_num % 13 / 12.0::double strength,
 sequence_num % 14 / 12.0::double confidence, sequence_num % 3 <> 0 is_valid from quotes""",
        ledger.SIGNAL_RULES,
    ),
    "fill_audit": _audit_cte(
        _LEDGER
        + ", s as (select * replace (quantity - fill_row % 2 * 50 as quantity) from filled)",
        ledger.FILL_RULES,
    ),
    "order_audit": _audit(
        """select epoch_us(ts) * 1000 decision_timestamp_ns,
 epoch_us(ts) * 1000 + (event_id + 1) % 10 - 1 actionable_timestamp_ns,
 epoch_us(ts) * 1000 + (event_id + 1) % 7 - 5 signal_event_timestamp_ns,
 case when (event_id + 1) % 4 <> 0 then epoch_us(ts) * 1000 - 1 end signal_available_timestamp_ns,
 1 + event_id % 500 - (event_id + 1) % 3 quantity,
 case when (event_id + 1) % 2 = 0 then 'limit' else 'market' end order_type,
 case when (event_id + 1) % 3 = 0 then cast(round(value * 100) as bigint) + 1 end limit_price
 from events""",
        ledger.ORDER_RULES,
    ),
}
for _take, _suffix in ((_TAKE_ALL, ""), (_TAKE_LEFT, "_limited"), (_TAKE_WHOLE, "_all_or_none")):
    ORACLES.update({k: v for k, v in _ledger_oracles(_take, _suffix).items() if k in QUERIES})
