"""The derived tapes as DuckDB CTEs, the common prefix of the oracle queries."""

TRADES = """trades as (
 select cast(user_id % 8 as bigint) instrument_id, event_id + 1 sequence_num,
  epoch_us(ts) * 1000 source_timestamp_ns, epoch_us(ts) * 1000 + 500000 receive_timestamp_ns,
  cast(round(value * 100) as bigint) + 1 price, 1 + event_id % 500 quantity,
  case when event_id % 3 = 0 then 2 else 1 end aggressor_side from events)"""

QUOTES = """quotes as (
 select cast(user_id % 8 as bigint) instrument_id, event_id + 1 sequence_num,
  epoch_us(ts) * 1000 source_timestamp_ns, epoch_us(ts) * 1000 + 200000 receive_timestamp_ns,
  cast(round(value * 100) as bigint) + 1000 - event_id % 5 best_bid_price,
  case when event_id % 53 = 0 then 0 else 100 + (event_id * 7) % 900 end best_bid_quantity,
  cast(round(value * 100) as bigint) + 1000 - event_id % 5
   + case when event_id % 37 = 0 then 0 else 1 + event_id % 7 end best_ask_price,
  100 + (event_id * 13) % 900 best_ask_quantity from events)"""

VALID_QUOTES = QUOTES + """, vq as (
 select *, best_bid_price > 0 and best_bid_quantity > 0 has_bid,
  best_ask_price > 0 and best_ask_quantity > 0 has_ask,
  best_bid_price > 0 and best_bid_quantity > 0 and best_ask_price > 0 and best_ask_quantity > 0
   and best_bid_price >= best_ask_price is_crossed,
  best_bid_price > 0 and best_bid_quantity > 0 and best_ask_price > 0 and best_ask_quantity > 0
   and best_bid_price < best_ask_price is_valid from quotes)"""

ARRIVALS = QUOTES + """, arrivals as (
 select cast(instrument_id % 2 as bigint) venue_id, cast(instrument_id // 4 as bigint) feed_id,
  instrument_id, sequence_num input_index,
  sequence_num + (sequence_num * 31) % 11 - 5 sequence_num,
  source_timestamp_ns + ((sequence_num * 31) % 11 - 5) * 60000000000 source_timestamp_ns,
  receive_timestamp_ns, best_bid_price, best_bid_quantity, best_ask_price, best_ask_quantity
 from quotes)"""

MESSAGES = """messages as (
 select event_id + 1 input_index, 1 + event_id % 8 message_type,
  case when event_id % 211 = 0 then 2 else 1 end as version,
  cast(user_id % 2 as bigint) venue_id, cast(user_id % 3 as bigint) feed_id,
  cast(case when event_id % 223 = 0 then 0 else 1 + user_id % 8 end as bigint) instrument_id,
  case when event_id % 227 = 0 then 0 else event_id + 1 + (event_id * 31) % 7 - 3 end sequence_num,
  epoch_us(ts) * 1000 source_timestamp_ns, epoch_us(ts) * 1000 + 500000 receive_timestamp_ns,
  cast(round(value * 100) as bigint) - case when event_id % 229 = 0 then 60000 else 0 end price,
  case when event_id % 61 = 0 then 0 else 1 + event_id % 500 end quantity,
  event_id % 67 % 3 side,
  case when event_id % 71 = 0 then 0 else event_id + 7 end order_id,
  cast(round(value * 100) as bigint) - case when event_id % 73 = 0 then 60000 else 0 end
   best_bid_price,
  case when event_id % 79 = 0 then 0 else 100 end best_bid_quantity,
  cast(round(value * 100) as bigint) + event_id % 9 - 1 best_ask_price,
  case when event_id % 83 = 0 then 0 else 100 end best_ask_quantity,
  event_id % 13 bid_levels_count, event_id % 12 ask_levels_count, event_id % 5 status,
  event_id % 11 tick_size, event_id % 19 lot_size, event_id % 23 min_quantity,
  event_id % 97 max_quantity,
  case when event_id % 8 = 6 and event_id % 9 = 4 then event_id - 10 else 0 end
   last_included_sequence
 from events)"""

BOOK = """book_orders as (
 select o_custkey % 16 instrument_id, o_orderkey order_id,
  case when o_orderkey % 2 = 0 then 2 else 1 end side,
  case when o_orderkey % 2 = 0 then 10001 + o_orderkey % 50 else 10000 - o_orderkey % 50 end
   + case when o_orderkey % 101 = 0 then 5 else 0 end price,
  10 + o_orderkey % 97 qty, epoch_us(o_orderdate) t0,
  epoch_us(o_orderdate) + (1 + o_orderkey % 240) * 3600000000 t1 from orders),
book_log as (
 select instrument_id, 4 as action, order_id, side, price, qty quantity, t0 * 1000 ts_ns
  from book_orders
 union all
 select instrument_id, 5, order_id, side, price + order_id % 2, qty + order_id % 7 - 3,
  ((t0 + t1) // 2) * 1000 from book_orders where order_id % 3 = 0
 union all
 select instrument_id, 6, order_id, side, price, qty, t1 * 1000 from book_orders)"""

FILLS = """fills as (
 select o_custkey % 16 instrument_id, o_orderkey fill_seq,
  (epoch_us(o_orderdate) + 10650 * 86400000000 + (o_orderkey * 7919 % 86400) * 1000000) * 1000
   fill_timestamp_ns,
  case when o_orderkey % 3 = 0 then 'buy' when o_orderkey % 7 < 4 then 'sell' else 'buy' end side,
  cast(1 + o_orderkey * 37 % 1999 as bigint) quantity,
  cast(round(o_totalprice / 10) as bigint) + 1 price,
  cast(round(o_totalprice / 10) as bigint) + 1
   - case when o_orderkey % 3 = 0 or o_orderkey % 7 >= 4 then 1 + o_orderkey % 5 else 0 end
   quote_bid,
  cast(round(o_totalprice / 10) as bigint) + 1
   + case when o_orderkey % 3 = 0 or o_orderkey % 7 >= 4 then 0 else 1 + o_orderkey % 4 end
   quote_ask,
  case when o_orderkey % 11 = 0 then null else 50 + o_orderkey % 3000 end reference_volume,
  case when o_orderkey % 13 = 0 then 0.0 else (o_orderkey % 40) / 10000.0 end::double
   realized_volatility
 from orders)"""
