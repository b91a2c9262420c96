"""Fixed, versioned table contracts and codes."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, D, B, STR = (
    T.LongType(), T.IntegerType(), T.ShortType(), T.DoubleType(), T.BooleanType(), T.StringType()
)


def _schema(*fields, optional=()):
    return T.StructType([T.StructField(n, t, n in optional) for n, t in fields])


# The message contracts, column by column.
HEADER = [
    ("version", S), ("message_type", S), ("flags", I), ("venue_id", I), ("feed_id", I),
    ("instrument_id", L), ("checksum", I), ("sequence_num", L), ("source_timestamp_ns", L),
    ("receive_timestamp_ns", L),
]
LEVELS = T.ArrayType(
    T.StructType([T.StructField(c, L) for c in ("price", "quantity", "order_count")])
)
TRADE = _schema(
    *HEADER, ("trade_id", L), ("price", L), ("quantity", L), ("aggressor_side", S),
    ("maker_order_id", L), ("taker_order_id", L),
)
TOP_OF_BOOK = _schema(
    *HEADER, ("best_bid_price", L), ("best_bid_quantity", L), ("best_ask_price", L),
    ("best_ask_quantity", L),
)
BOOK_UPDATE = _schema(
    *HEADER, ("action", S), ("order_id", L), ("side", S), ("price", L), ("quantity", L),
    ("priority_rank", L), ("delta_quantity", L), optional=("priority_rank", "delta_quantity"),
)
BOOK_SNAPSHOT = _schema(
    *HEADER, ("last_included_sequence", L), ("bid_levels_count", L), ("ask_levels_count", L),
    ("bids", LEVELS), ("asks", LEVELS),
)
MARKET_STATUS = _schema(*HEADER, ("status", S), ("status_flags", L))
INSTRUMENT = _schema(
    *HEADER, ("tick_size", L), ("lot_size", L), ("min_quantity", L), ("max_quantity", L)
)
_REPLAY_PAYLOAD = [
    ("order_id", L), ("side", S), ("price", L), ("quantity", L), ("trade_id", L),
    ("aggressor_side", S), ("maker_order_id", L), ("taker_order_id", L), ("best_bid_price", L),
    ("best_bid_quantity", L), ("best_ask_price", L), ("best_ask_quantity", L),
    ("priority_rank", L), ("delta_quantity", L), ("status", S), ("status_flags", L),
    ("tick_size", L), ("lot_size", L), ("min_quantity", L), ("max_quantity", L),
]
_SNAPSHOT_PAYLOAD = [
    ("last_included_sequence", L), ("bid_levels_count", L), ("ask_levels_count", L),
    ("bids", LEVELS), ("asks", LEVELS),
]
REPLAY_V1_0 = _schema(
    *HEADER, ("source", S), ("input_index", L), *_REPLAY_PAYLOAD,
    optional=[n for n, _ in _REPLAY_PAYLOAD],
)
REPLAY_V1_1 = _schema(
    *HEADER, ("source", S), ("input_index", L), *_REPLAY_PAYLOAD, *_SNAPSHOT_PAYLOAD,
    optional=[n for n, _ in _REPLAY_PAYLOAD + _SNAPSHOT_PAYLOAD],
)
SIGNAL = _schema(
    ("decision_timestamp_ns", L), ("instrument_id", L), ("direction", T.ByteType()),
    ("target_weight", D), ("strength", D), ("confidence", D), ("is_valid", B),
)

# The feature contract (name to type) and the value each flag speaks for.
FEATURE_COLUMNS = {
    "instrument_id": "bigint", "sequence_num": "bigint", "event_timestamp_ns": "bigint",
    "source_timestamp_ns": "bigint", "decision_timestamp_ns": "bigint",
    "best_bid_price": "bigint", "best_bid_quantity": "bigint", "best_ask_price": "bigint",
    "best_ask_quantity": "bigint", "spread": "bigint", "relative_spread": "double",
    "mid_price": "double", "weighted_mid_price": "double", "book_imbalance_top": "double",
    "bid_depth_k": "bigint", "ask_depth_k": "bigint", "depth_imbalance_k": "double",
    "instant_ofi": "bigint", "rolling_ofi": "bigint", "last_signed_volume": "bigint",
    "rolling_trade_volume": "bigint", "rolling_buy_volume": "bigint",
    "rolling_sell_volume": "bigint", "trade_flow_imbalance": "double", "rolling_vwap": "double",
    "log_return": "double", "realized_volatility": "double", "roll_spread": "double",
    "vpin": "double",
    "has_bid": "boolean", "has_ask": "boolean", "is_crossed": "boolean", "has_spread": "boolean",
    "has_mid": "boolean", "has_weighted_mid": "boolean", "has_book_imbalance": "boolean",
    "has_depth_imbalance": "boolean", "has_instant_ofi": "boolean", "has_rolling_ofi": "boolean",
    "has_trade": "boolean", "has_trade_flow": "boolean", "has_vwap": "boolean",
    "has_log_return": "boolean", "has_realized_volatility": "boolean",
    "has_roll_spread": "boolean", "has_vpin": "boolean",
}
FEATURE_FLAGS = {
    "has_bid": "best_bid_price", "has_ask": "best_ask_price", "is_crossed": None,
    "has_spread": "spread", "has_mid": "mid_price", "has_weighted_mid": "weighted_mid_price",
    "has_book_imbalance": "book_imbalance_top", "has_depth_imbalance": "depth_imbalance_k",
    "has_instant_ofi": "instant_ofi", "has_rolling_ofi": "rolling_ofi",
    "has_trade": "last_signed_volume", "has_trade_flow": "trade_flow_imbalance",
    "has_vwap": "rolling_vwap", "has_log_return": "log_return",
    "has_realized_volatility": "realized_volatility", "has_roll_spread": "roll_spread",
    "has_vpin": "vpin",
}
FEATURES = T.StructType(
    [
        T.StructField(n, {"bigint": L, "double": D, "boolean": B}[t], t != "boolean")
        for n, t in FEATURE_COLUMNS.items()
    ]
)

# Status codes of message validation and of book updates, in code order.
VALIDATION = {
    "valid": 0, "instrument": 1, "venue": 2, "price": 3, "quantity": 4, "timestamp": 5,
    "sequence": 6, "version": 7, "payload": 8, "checksum": 9,
}
BOOK_STATUS = {
    "success": 0, "order_id": 1, "duplicate": 2, "not_found": 3, "price": 4, "quantity": 5,
    "exceeds_remaining": 6, "crossed_rejected": 7, "instrument": 8, "side": 9, "snapshot": 10,
}
MAX_SNAPSHOT_LEVELS = 10
