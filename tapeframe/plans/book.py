"""Registered order-book queries with their DuckDB counterparts."""

from __future__ import annotations

from tapeframe.operators import book as ops
from tapeframe.operators import features as feat
from tapeframe.plans.duck import BOOK
from tapeframe.session import staged
from tapeframe.sources import views

AS_OF = 897912000000000000  # 1998-06-15 12:00 UTC
LEVEL_PRICE = 10009
DEPTH = 3


def _log(spark, sf):
    return ops.with_log_sequence(views.book_log(spark, sf))


def _intervals(spark, sf):
    return ops.order_intervals(_log(spark, sf))


def _l3(spark, sf):
    return ops.l3_as_of(_intervals(spark, sf), AS_OF)


def _l2(spark, sf):
    return ops.l2_depth(_l3(spark, sf))


def order_intervals(spark, sf):
    return _intervals(spark, sf)


def book_update_status(spark, sf):
    log = ops.with_log_sequence(
        views.faulty_book_log(spark, sf), ["ts_ns", "order_id", "action", "raw_id"]
    )
    return ops.with_update_status(log).select(
        "instrument_id", "seq", "action", "order_id", "book_status"
    )


def trade_reductions(spark, sf):
    log = ops.with_log_sequence(views.traded_book_log(spark, sf))
    return ops.trade_reductions(log)


def l3_snapshot(spark, sf):
    return _l3(spark, sf)


def l2_depth(spark, sf):
    return _l2(spark, sf)


def top_levels(spark, sf):
    return ops.top_levels(_l2(spark, sf), DEPTH)


def depth_quantity(spark, sf):
    return ops.depth_quantity(_l2(spark, sf), DEPTH)


def best_quotes(spark, sf):
    return ops.best_quotes(_l2(spark, sf))


def level_lookup(spark, sf):
    return ops.level_at(_l2(spark, sf), LEVEL_PRICE)


def orders_at_level(spark, sf):
    return ops.orders_at_level(_l3(spark, sf), LEVEL_PRICE)


def queue_positions(spark, sf):
    return ops.queue_positions(_l3(spark, sf)).drop("queue_seq")


def level_timeline(spark, sf):
    return ops.level_timeline(_intervals(spark, sf))


def bbo_timeline(spark, sf):
    return ops.bbo_timeline(_intervals(spark, sf))


def bbo_timeline_chunked(spark, sf):
    """The same timeline cut into runs of 50 events."""
    return ops.bbo_timeline(_intervals(spark, sf), chunk_events=50)


def book_change_feed(spark, sf):
    log = _log(spark, sf)
    return ops.change_feed(log, ops.bbo_timeline(ops.order_intervals(log)))


def book_invariants(spark, sf):
    iv = staged(_intervals(spark, sf), "intervals")
    levels = staged(ops.level_timeline(iv), "levels")
    return ops.invariant_audit(iv, levels, ops.bbo_timeline(iv, levels=levels))


def snapshot_overlay_depth(spark, sf):
    return ops.overlay_depth(views.book_log(spark, sf), views.book_snapshots(spark, sf), AS_OF)


def snapshot_validation(spark, sf):
    return ops.with_snapshot_status(views.book_snapshots(spark, sf)).select(
        "instrument_id", "snapshot_id", "is_valid_snapshot"
    )


def snapshot_levels(spark, sf):
    return ops.flatten_snapshots(
        views.book_snapshots(spark, sf), ["instrument_id", "snapshot_id"]
    )


def snapshot_rebuild(spark, sf):
    """Arrays rebuilt from the derived L2 book, flattened again."""
    return ops.flatten_snapshots(ops.snapshot_arrays(_l2(spark, sf)), ["instrument_id"])


def depth_imbalance(spark, sf):
    s = feat.depth_features(views.book_snapshots(spark, sf), 2)
    return s.select(
        "instrument_id", "snapshot_id", "best_bid_price", "best_ask_price", "bid_depth_k",
        "ask_depth_k", "depth_imbalance_k", "has_depth_imbalance",
    )


def _intervals_sql(log: str, scope: str = "") -> str:
    """``iv``: intervals from ``log`` (instrument_id, order_id, action, side, price, quantity, seq)."""
    part = f"partition by instrument_id{scope}, order_id order by seq"
    return f"""st as (
 select *, coalesce(last_value(case when action in (4, 6) then action end ignore nulls) over (
  {part} rows between unbounded preceding and 1 preceding) = 4, false) live from {log}
 where order_id <> 0),
okd as (select * from st where (action = 4) <> live),
iv0 as (
 select *, lead(seq) over w end_seq, lead(ts_ns) over w end_ts,
  case when action = 4 or action = 5 and (price <> lag(price) over w
   or quantity > lag(quantity) over w) then seq end reset from okd window w as ({part})),
iv1 as (
 select *, last_value(reset ignore nulls) over ({part} rows unbounded preceding) queue_seq
 from iv0),
iv as (
 select instrument_id{scope}, order_id, side, price, quantity, queue_seq, seq start_seq, end_seq,
  ts_ns start_ts, end_ts from iv1 where action <> 6)"""


_IV = BOOK + """, log as (
 select *, row_number() over (partition by instrument_id order by ts_ns, order_id, action) seq
 from book_log), """ + _intervals_sql("log")

_L3 = _IV + f""", l3 as (
 select instrument_id, side, price, queue_seq, order_id, quantity from iv
 where start_ts <= {AS_OF} and (end_ts is null or end_ts > {AS_OF}))"""

_L2 = _L3 + """, l2 as (
 select instrument_id, side, price, cast(sum(quantity) as bigint) quantity, count(*) order_count
 from l3 group by 1, 2, 3),
top as (
 select *, row_number() over (partition by instrument_id, side
  order by case when side = 1 then -price else price end) as level from l2)"""

_LEVELS = _IV + """, deltas as (
 select instrument_id, side, price, seq, sum(q) dq, sum(n) dn from (
  select instrument_id, side, price, start_seq seq, quantity q, 1 n from iv union all
  select instrument_id, side, price, end_seq, -quantity, -1 from iv where end_seq is not null)
 group by 1, 2, 3, 4),
levels as (
 select instrument_id, side, price, seq, cast(sum(dq) over w as bigint) quantity,
  cast(sum(dn) over w as bigint) order_count from deltas
 window w as (partition by instrument_id, side, price order by seq rows unbounded preceding))"""

_BBO = _LEVELS + """, spans as (
 select *, coalesce(lead(seq) over (partition by instrument_id, side, price order by seq),
  9223372036854775807) nxt from levels),
moments as (select distinct instrument_id, seq from levels),
tops as (
 select m.instrument_id, m.seq, max(case when s.side = 1 then s.price end) bp,
  arg_max(s.quantity, case when s.side = 1 then s.price end) bq,
  arg_max(s.order_count, case when s.side = 1 then s.price end) bn,
  min(case when s.side = 2 then s.price end) ap,
  arg_min(s.quantity, case when s.side = 2 then s.price end) aq,
  arg_min(s.order_count, case when s.side = 2 then s.price end) an
 from moments m left join spans s on s.instrument_id = m.instrument_id and s.seq <= m.seq
  and m.seq < s.nxt and s.quantity > 0 group by 1, 2),
bbo0 as (
 select *, lag(bp) over w lbp, lag(bq) over w lbq, lag(bn) over w lbn, lag(ap) over w lap,
  lag(aq) over w laq, lag(an) over w lan from tops
 window w as (partition by instrument_id order by seq)),
bbo as (
 select instrument_id, seq, bp best_bid_price, bq best_bid_quantity, bn best_bid_orders,
  ap best_ask_price, aq best_ask_quantity, an best_ask_orders from bbo0
 where (bp, bq, bn, ap, aq, an) is distinct from (lbp, lbq, lbn, lap, laq, lan))"""

_SNAPS = """snaps as (
 select o_custkey % 16 instrument_id, o_orderkey snapshot_id,
  (epoch_us(o_orderdate) + 43200000000) * 1000 + o_orderkey ts_ns,
  list_transform([0, 1, 2], lambda i: {'price': 9990 - i * case when o_orderkey % 5 = 0 and i = 2
   then -1 else 3 end, 'quantity': case when o_orderkey % 7 = 0 then 0
   else 50 + (o_orderkey + i) % 40 end, 'order_count': (o_orderkey + i) % 4}) bids,
  list_transform([0, 1, 2], lambda i: {'price': 10010 + i * 2,
   'quantity': 60 + (o_orderkey * 3 + i) % 50, 'order_count': (o_orderkey + i) % 3}) asks
 from orders),
snap_levels as (
 select instrument_id, snapshot_id, ts_ns, side, row_number() over (
  partition by snapshot_id, side order by case when side = 1 then -x.price else x.price end)
  as level, x.price::bigint price, x.quantity::bigint quantity, x.order_count::bigint order_count
 from (select instrument_id, snapshot_id, ts_ns, 1 side, unnest(bids) x from snaps union all
  select instrument_id, snapshot_id, ts_ns, 2, unnest(asks) from snaps))"""

QUERIES = {
    f.__name__: f
    for f in (
        order_intervals, book_update_status, trade_reductions, l3_snapshot, l2_depth, top_levels,
        depth_quantity, best_quotes, level_lookup, orders_at_level, queue_positions,
        level_timeline, bbo_timeline, bbo_timeline_chunked, book_change_feed, book_invariants, snapshot_overlay_depth,
        snapshot_validation, snapshot_levels, snapshot_rebuild, depth_imbalance,
    )
}

ORACLES = {
    "order_intervals": f"with {_IV} select * from iv",
    "book_update_status": f"""with {BOOK}, faulty as (
 select instrument_id, action, order_id raw_id, order_id - order_id % 3 order_id,
  case when order_id % 23 = 0 then 0 else side end side,
  case when order_id % 19 = 0 then -price else price end price,
  case when order_id % 17 = 0 then 0 else quantity end quantity, ts_ns from book_log),
f as (select *, row_number() over (partition by instrument_id
  order by ts_ns, order_id, action, raw_id) seq,
 case when order_id = 0 then 1 when action <> 6 and price <= 0 then 4
  when action <> 6 and quantity = 0 then 5 when action = 4 and side = 0 then 9 else 0 end bad
 from faulty),
g as (select *, coalesce(last_value(case when bad = 0 and action in (4, 6) then action end
  ignore nulls) over (partition by instrument_id, order_id order by seq
  rows between unbounded preceding and 1 preceding) = 4, false) live from f)
select instrument_id, seq, action, order_id, case when bad <> 0 then bad
 when action = 4 and live then 2 when action <> 4 and not live then 3 else 0 end book_status
 from g""",
    "trade_reductions": f"""with recursive {BOOK}, traded as (
 select instrument_id, action, order_id, quantity, ts_ns from book_log union all
 select instrument_id, 3, order_id, case x when 1 then qty // 2 else qty // 2 + order_id % 3 end,
  t0 * 1000 + case x when 1 then (1 + order_id % 240) * 3600000000000 // 4
   else (1 + order_id % 240) * 3600000000000 * 3 // 4 end
 from book_orders, (values (1), (2)) v(x)),
tl as (select *, row_number() over (partition by instrument_id order by ts_ns, order_id, action)
 seq from traded),
steps as (select *, row_number() over (partition by instrument_id, order_id order by seq) rn
 from tl),
walk as (
 select instrument_id, order_id, seq, action, quantity, rn, 0 book_status, quantity remaining,
  quantity > 0 live from steps where rn = 1 and action = 4
 union all
 select s.instrument_id, s.order_id, s.seq, s.action, s.quantity, s.rn, c.code,
  case when c.code <> 0 then w.remaining when s.action = 6 then 0
   when s.action = 3 then w.remaining - s.quantity else s.quantity end,
  case when c.code <> 0 then w.live when s.action = 6 then false
   when s.action = 3 then w.remaining - s.quantity > 0 else true end
 from walk w join steps s on s.instrument_id = w.instrument_id and s.order_id = w.order_id
  and s.rn = w.rn + 1,
  lateral (select case when s.action = 4 then (case when w.live then 2 else 0 end)
   when s.action <> 6 and s.quantity = 0 then 5 when not w.live then 3
   when s.action = 3 and s.quantity > w.remaining then 6 else 0 end code) c)
select instrument_id, order_id, seq, action, quantity, book_status, remaining from walk""",
    "l3_snapshot": f"with {_L3} select * from l3",
    "l2_depth": f"with {_L2} select * from l2",
    "top_levels": f"with {_L2} select * from top where level <= {DEPTH}",
    "depth_quantity": f"""with {_L2} select instrument_id, side,
 cast(sum(quantity) as bigint) total_quantity,
 cast(sum(case when level <= {DEPTH} then quantity end) as bigint) top_quantity
 from top group by 1, 2""",
    "best_quotes": f"""with {_L2}, b as (select instrument_id,
 max(price) filter (side = 1) best_bid_price,
 arg_max(quantity, price) filter (side = 1) best_bid_quantity,
 min(price) filter (side = 2) best_ask_price,
 arg_min(quantity, price) filter (side = 2) best_ask_quantity from l2 group by 1)
select *, best_ask_price - best_bid_price spread,
 coalesce(best_bid_price >= best_ask_price, false) is_crossed from b""",
    "level_lookup": f"with {_L2} select * from l2 where price = {LEVEL_PRICE}",
    "orders_at_level": f"""with {_L3} select instrument_id, side, price, row_number() over (
 partition by instrument_id, side order by queue_seq) - 1 queue_position, order_id, quantity
 from l3 where price = {LEVEL_PRICE}""",
    "queue_positions": f"""with {_L3} select instrument_id, side, price, order_id, quantity,
 row_number() over w - 1 queue_position, cast(coalesce(sum(quantity) over (
  partition by instrument_id, side, price order by queue_seq
  rows between unbounded preceding and 1 preceding), 0) as bigint) quantity_ahead
 from l3 window w as (partition by instrument_id, side, price order by queue_seq)""",
    "level_timeline": f"with {_LEVELS} select * from levels",
    "bbo_timeline": f"with {_BBO} select * from bbo",
    "bbo_timeline_chunked": f"with {_BBO} select * from bbo",
    "book_change_feed": f"""with {_BBO} select instrument_id, seq, case action when 4 then 'added'
 when 5 then 'modified' else 'deleted' end kind, order_id, price, quantity from okd
union all select instrument_id, seq, 'bbo_changed', null, null, null from bbo""",
    "book_invariants": f"""with {_BBO} select 'order_price' rule,
 count(*) filter (price <= 0) violations from iv
union all select 'order_quantity', count(*) filter (quantity <= 0) from iv
union all select 'order_span', count(*) filter (end_seq <= start_seq) from iv
union all select 'level_quantity', count(*) filter (quantity < 0) from levels
union all select 'level_count', count(*) filter (order_count < 0) from levels
union all select 'level_reconcile', count(*) filter ((quantity = 0) <> (order_count = 0))
 from levels
union all select 'crossed_states', count(*) filter (best_bid_price >= best_ask_price) from bbo""",
    "snapshot_overlay_depth": f"""with {BOOK}, {_SNAPS}, good as (
 select * from snaps where bids[2].price < bids[1].price and bids[3].price < bids[2].price
  and ts_ns <= {AS_OF}),
cut as (select instrument_id, arg_max(snapshot_id, ts_ns) snapshot_id, max(ts_ns) cut_ts
 from good group by 1),
kept as (select b.* from book_log b left join cut c using (instrument_id)
 where b.ts_ns <= {AS_OF} and b.ts_ns >= coalesce(c.cut_ts, 0)),
log as (select *, row_number() over (partition by instrument_id order by ts_ns, order_id, action)
 seq from kept), {_intervals_sql("log")},
parts as (
 select instrument_id, side, price, quantity, 1 n from iv
 where start_ts <= {AS_OF} and (end_ts is null or end_ts > {AS_OF}) union all
 select l.instrument_id, side, price, quantity, greatest(order_count, 1)
 from snap_levels l join cut using (snapshot_id) where price > 0 and quantity > 0)
select instrument_id, side, price, cast(sum(quantity) as bigint) quantity,
 cast(sum(n) as bigint) order_count from parts group by 1, 2, 3""",
    "snapshot_validation": f"""with {_SNAPS} select instrument_id, snapshot_id,
 bids[2].price < bids[1].price and bids[3].price < bids[2].price and asks[2].price > asks[1].price
 and asks[3].price > asks[2].price is_valid_snapshot from snaps""",
    "snapshot_levels": f"with {_SNAPS} select instrument_id, snapshot_id, side, level, price,"
    " quantity, order_count from snap_levels",
    "snapshot_rebuild": f"with {_L2} select instrument_id, side, level, price, quantity,"
    " order_count from top where level <= 10",
    "depth_imbalance": f"""with {_SNAPS}, d as (
 select instrument_id, snapshot_id,
  max(price) filter (side = 1) best_bid_price, min(price) filter (side = 2) best_ask_price,
  arg_max(quantity, price) filter (side = 1) bq, arg_min(quantity, price) filter (side = 2) aq,
  cast(sum(quantity) filter (side = 1) as bigint) b,
  cast(sum(quantity) filter (side = 2) as bigint) a
 from snap_levels where level <= 2 group by 1, 2),
e as (select *, a + b > 0 and not (bq > 0 and aq > 0 and best_bid_price >= best_ask_price)
 has_depth_imbalance from d)
select instrument_id, snapshot_id, best_bid_price, best_ask_price,
 case when has_depth_imbalance then b end bid_depth_k,
 case when has_depth_imbalance then a end ask_depth_k,
 case when has_depth_imbalance then (b - a)::double / (b + a) end depth_imbalance_k,
 has_depth_imbalance from e""",
}
