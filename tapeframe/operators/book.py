"""Order-book analytics from an L3 event log.

The book is never replayed: each accepted event opens an interval [start, end) of one order's state,
and every view (L3, L2, BBO, queue position) is a query over intervals. Actions: 3 trade against a
resting order, 4 add, 5 modify, 6 delete.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.contracts import BOOK_STATUS, MAX_SNAPSHOT_LEVELS
from tapeframe.operators.features import sorted_levels
from tapeframe.operators.scan import running, running_count, running_last, running_sum
from tapeframe.operators.tape import snapshot_is_monotone
from tapeframe.session import staged

KEY = ["instrument_id"]
TRADE, ADD, MODIFY, DELETE = 3, 4, 5, 6
BUY, SELL = 1, 2
CHUNK_EVENTS = 20_000


def with_log_sequence(
    log: DataFrame, order: Sequence[str] = ("ts_ns", "order_id", "action")
) -> DataFrame:
    return running(log, KEY, list(order), seq=running_count())


def _code(name: str) -> Column:
    return F.lit(BOOK_STATUS[name])


def with_update_status(log: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Book status of each event under the crossed-allowed policy.

    An order is live after its last well-formed add or delete says so: a second add is a duplicate
    but leaves it live, and an unknown delete leaves it dead, so the look-back needs no replay.
    ``scope`` adds key columns, such as a snapshot epoch, outside which orders do not exist.
    """
    bad = (
        F.when(F.col("order_id") == 0, _code("order_id"))
        .when((F.col("action") != DELETE) & (F.col("price") <= 0), _code("price"))
        .when((F.col("action") != DELETE) & (F.col("quantity") == 0), _code("quantity"))
        .when((F.col("action") == ADD) & ~F.col("side").isin(BUY, SELL), _code("side"))
        .otherwise(_code("success"))
    )
    w = Window.partitionBy(*KEY, *scope, "order_id").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1
    )
    out = log.withColumn("__bad", bad)
    flips = F.when((F.col("__bad") == 0) & F.col("action").isin(ADD, DELETE), F.col("action"))
    live = F.coalesce(F.last(flips, ignorenulls=True).over(w) == ADD, F.lit(False))
    status = (
        F.when(F.col("__bad") != 0, F.col("__bad"))
        .when((F.col("action") == ADD) & live, _code("duplicate"))
        .when((F.col("action") != ADD) & ~live, _code("not_found"))
        .otherwise(_code("success"))
    )
    return out.withColumn("book_status", status).drop("__bad")


def order_intervals(log: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """State intervals of every order: [start_seq, end_seq) with price, quantity and queue place.

    ``queue_seq`` moves to the back on an add, a price change or a quantity increase.
    """
    ok = with_update_status(log, scope).where(F.col("book_status") == 0)
    w = Window.partitionBy(*KEY, *scope, "order_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    reset = (F.col("action") == ADD) | (
        (F.col("action") == MODIFY)
        & ((F.col("price") != F.lag("price").over(w)) | (F.col("quantity") > F.lag("quantity").over(w)))
    )
    out = ok.withColumns(
        {
            "end_seq": F.lead("seq").over(w),
            "end_ts": F.lead("ts_ns").over(w),
            "__reset": F.when(reset, F.col("seq")),
            "side": F.last(F.when(F.col("action") == ADD, F.col("side")), ignorenulls=True).over(upto),
        }
    ).withColumn("queue_seq", F.last("__reset", ignorenulls=True).over(upto))
    return out.where(F.col("action") != DELETE).select(
        *KEY, *scope, "order_id", "side", "price", "quantity", "queue_seq",
        F.col("seq").alias("start_seq"), "end_seq", F.col("ts_ns").alias("start_ts"), "end_ts",
    )


def trade_reductions(log: DataFrame) -> DataFrame:
    """Remaining quantity and status of every event of an order, executions included.

    An execution larger than what remains is refused and changes nothing, so each order's own few
    events are folded in sequence.
    """
    event = F.struct("seq", "action", "price", "quantity")
    orders = log.groupBy(*KEY, "order_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    s = BOOK_STATUS
    code = f"""case
        when e.action = {ADD} then if(s.live, {s['duplicate']}, {s['success']})
        when e.action <> {DELETE} and e.quantity = 0 then {s['quantity']}
        when not s.live then {s['not_found']}
        when e.action = {TRADE} and e.quantity > s.left then {s['exceeds_remaining']}
        else {s['success']} end"""
    left = f"""case when e.action = {DELETE} then 0L when e.action = {TRADE}
        then s.left - e.quantity else e.quantity end"""
    fold = f"""aggregate(events,
        named_struct('live', false, 'left', 0L,
                     'out', cast(array() as array<struct<status:int,remaining:bigint>>)),
        (s, e) -> named_struct(
            'live', if(({code}) = 0, ({left}) > 0, s.live),
            'left', if(({code}) = 0, {left}, s.left),
            'out', concat(s.out, array(named_struct(
                'status', {code}, 'remaining', if(({code}) = 0, {left}, s.left))))),
        s -> s.out)"""
    each = orders.select(*KEY, "order_id", F.explode(F.arrays_zip("events", F.expr(fold).alias("out"))).alias("z"))
    return each.select(
        *KEY, "order_id", "z.events.seq", "z.events.action", "z.events.quantity",
        F.col("z.out.status").alias("book_status"), F.col("z.out.remaining").alias("remaining"),
    )


# --- views as of a time --------------------------------------------------------------------------


def l3_as_of(intervals: DataFrame, ts_ns: int) -> DataFrame:
    """Resting orders at ``ts_ns``, all events of that instant applied."""
    return intervals.where(
        (F.col("start_ts") <= ts_ns) & (F.col("end_ts").isNull() | (F.col("end_ts") > ts_ns))
    ).select(*KEY, "side", "price", "queue_seq", "order_id", "quantity")


def l2_depth(l3: DataFrame) -> DataFrame:
    """Total quantity and order count per price level."""
    return l3.groupBy(*KEY, "side", "price").agg(
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("order_count")
    )


def top_levels(l2: DataFrame, k: int) -> DataFrame:
    """Best ``k`` levels per side, ``level`` 1 being the best price."""
    better = F.when(F.col("side") == BUY, -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*KEY, "side").orderBy(better)
    return l2.withColumn("level", F.row_number().over(w).cast("long")).where(F.col("level") <= k)


def depth_quantity(l2: DataFrame, k: int) -> DataFrame:
    """Quantity of the best ``k`` levels and of the whole side."""
    top = top_levels(l2, k).groupBy(*KEY, "side").agg(F.sum("quantity").alias("top_quantity"))
    total = l2.groupBy(*KEY, "side").agg(F.sum("quantity").alias("total_quantity"))
    return total.join(top, [*KEY, "side"])


def snapshot_arrays(l2: DataFrame, k: int = MAX_SNAPSHOT_LEVELS) -> DataFrame:
    """The best ``k`` levels of both sides as snapshot arrays, best first."""
    level = F.struct("level", F.struct("price", "quantity", "order_count").alias("x"))

    def side(code):
        return F.transform(
            F.array_sort(F.collect_list(F.when(F.col("side") == code, level))), lambda s: s["x"]
        )

    return top_levels(l2, k).groupBy(*KEY).agg(side(BUY).alias("bids"), side(SELL).alias("asks"))


def flatten_snapshots(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per level, renumbered best first whatever the order in the arrays."""
    def side(name, code, descending):
        return snapshots.select(
            *keys, F.lit(code).cast("long").alias("side"),
            F.posexplode(sorted_levels(name, descending)).alias("pos", "x"),
        )

    both = side("bids", BUY, True).unionByName(side("asks", SELL, False))
    return both.select(*keys, "side", (F.col("pos") + 1).cast("long").alias("level"), "x.*")


def best_quotes(l2: DataFrame) -> DataFrame:
    """Best bid and offer, spread and crossed flag per instrument."""
    bid = F.when(F.col("side") == BUY, F.col("price"))
    ask = F.when(F.col("side") == SELL, F.col("price"))
    out = l2.groupBy(*KEY).agg(
        F.max(bid).alias("best_bid_price"),
        F.max_by("quantity", bid).alias("best_bid_quantity"),
        F.min(ask).alias("best_ask_price"),
        F.min_by("quantity", ask).alias("best_ask_quantity"),
    )
    return out.withColumns(
        {"spread": F.col("best_ask_price") - F.col("best_bid_price"),
         "is_crossed": F.coalesce(F.col("best_bid_price") >= F.col("best_ask_price"), F.lit(False))}
    )


def level_at(l2: DataFrame, price: int) -> DataFrame:
    return l2.where(F.col("price") == price)


def queue_positions(l3: DataFrame) -> DataFrame:
    """0-based queue place and quantity ahead of every resting order in its level."""
    out = running(
        l3, [*KEY, "side", "price"], ["queue_seq"],
        __n=running_count(), __ahead=running_sum("quantity", inclusive=False),
    )
    return out.withColumns(
        {"queue_position": F.col("__n") - 1, "quantity_ahead": F.coalesce("__ahead", F.lit(0))}
    ).drop("__n", "__ahead")


def orders_at_level(l3: DataFrame, price: int) -> DataFrame:
    return queue_positions(l3.where(F.col("price") == price)).select(
        *KEY, "side", "price", "queue_position", "order_id", "quantity"
    )


# --- timelines -----------------------------------------------------------------------------------


def level_timeline(intervals: DataFrame) -> DataFrame:
    """Quantity and order count of every price level after each event that changes it."""
    entry = intervals.select(
        *KEY, "side", "price", F.col("start_seq").alias("seq"), "quantity", F.lit(1).alias("n")
    )
    leave = intervals.where(F.col("end_seq").isNotNull()).select(
        *KEY, "side", "price", F.col("end_seq").alias("seq"), (-F.col("quantity")).alias("quantity"),
        F.lit(-1).alias("n"),
    )
    deltas = entry.unionByName(leave).groupBy(*KEY, "side", "price", "seq").agg(
        F.sum("quantity").alias("dq"), F.sum("n").alias("dn")
    )
    return running(
        deltas, [*KEY, "side", "price"], ["seq"],
        quantity=running_sum("dq"), order_count=running_sum("dn"),
    ).drop("dq", "dn")


def _best_after_each(pdf: pd.DataFrame) -> pd.DataFrame:
    """BBO changes of the chunks of a group: of each the levels live at its start (carried rows), then its level changes."""
    names = ["seq", "side", "price", "quantity", "order_count"]
    by_chunk = np.lexsort((pdf["seq"].to_numpy(), ~pdf["carried"].to_numpy(), pdf["chunk"].to_numpy()))
    chunk, carried, *columns = (pdf[c].to_numpy()[by_chunk] for c in ["chunk", "carried", *names])
    starts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
    ends = np.append(starts[1:], len(chunk))
    firsts = starts + np.add.reduceat(carried.astype("int64"), starts)
    columns = [c.tolist() for c in columns]
    out: list[tuple] = []
    for start, first, end in zip(starts.tolist(), firsts.tolist(), ends.tolist(), strict=True):
        _walk_chunk([c[start:first] for c in columns], [c[first:end] for c in columns], out)
    res = pd.DataFrame(
        out, columns=["seq", "best_bid_price", "best_bid_quantity", "best_bid_orders",
                      "best_ask_price", "best_ask_quantity", "best_ask_orders"]
    ).astype("Int64")
    res.insert(0, "instrument_id", pdf["instrument_id"].iloc[0])
    return res


def _walk_chunk(before: list[list], changes: list[list], out: list[tuple]) -> None:
    """Adds the BBO changes of one chunk to ``out``."""
    # Prices are negated on the bid side, so the best level is the smallest key on both sides.
    levels: tuple[dict, dict] = ({}, {})
    heaps: tuple[list, list] = ([], [])
    for _, side, price, qty, n in zip(*before, strict=True):
        key = -price if side == BUY else price
        levels[side - 1][key] = (qty, n)
        heaps[side - 1].append(key)
    for h in heaps:
        heapq.heapify(h)

    def best(s):
        heap, live = heaps[s], levels[s]
        while heap:
            if heap[0] in live:
                key = heap[0]
                return (-key if s == 0 else key, *live[key])
            heapq.heappop(heap)
        return (None, None, None)

    top = [best(0), best(1)]
    last = (*top[0], *top[1])
    following = [*changes[0][1:], None]
    for (seq, side, price, qty, n), upcoming in zip(
        zip(*changes, strict=True), following, strict=False
    ):
        s = side - 1
        key = -price if s == 0 else price
        live = levels[s]
        if qty > 0:
            if key not in live:
                heapq.heappush(heaps[s], key)
            live[key] = (qty, n)
        else:
            live.pop(key, None)
        at = top[s][0]
        if at is None or key <= (-at if s == 0 else at):
            top[s] = best(s)
        if upcoming == seq:  # one event may move an order between two levels
            continue
        now = (*top[0], *top[1])
        if now != last:
            out.append((seq, *now))
            last = now


def bbo_timeline(intervals: DataFrame, chunk_events: int = CHUNK_EVENTS, levels: DataFrame | None = None) -> DataFrame:
    """Best bid and offer after every event that changes them. ``levels`` is their level timeline, if at hand.

    Instruments are cut into runs of ``chunk_events`` sequence numbers. A chunk starts from the
    levels live just before its first event, which are level states that reach the boundary; so a
    group holds one chunk's changes plus one row per live price level, however long the instrument's
    log is, and the rows do not depend on where the cuts fall. Short chunks share a group, since each group
    has a cost of its own.
    """
    levels = level_timeline(intervals) if levels is None else levels
    spans = running(
        levels, [*KEY, "side", "price"], ["seq"], descending=True, next_seq=running_last("seq", inclusive=False),
    )
    # Every start and end of an interval is a change of a level. One row per instrument.
    ends = F.broadcast(levels.groupBy(*KEY).agg(F.max("seq").alias("last_seq")))
    # A chunk starts from the book just before its first event, so a level that this very event
    # changes is carried into it as well; the change then replaces it.
    spans = spans.join(ends, KEY).withColumns(
        {
            "home": F.expr(f"seq div {chunk_events}L"),
            "until": F.expr(
                f"if(quantity > 0, coalesce(next_seq, last_seq) div {chunk_events}L,"
                f" seq div {chunk_events}L)"
            ),
        }
    )
    rows = spans.withColumn("chunk", F.explode(F.sequence("home", F.greatest("home", "until")))).select(
        *KEY, "chunk", "seq", "side", "price", "quantity", "order_count",
        (F.col("chunk") > F.col("home")).alias("carried"),
    )
    together = max(1, CHUNK_EVENTS // chunk_events)
    return rows.groupBy(*KEY, F.expr(f"chunk div {together}L").alias("group")).applyInPandas(
        lambda pdf: _best_after_each(pdf),
        "instrument_id long, seq long, best_bid_price long, best_bid_quantity long,"
        " best_bid_orders long, best_ask_price long, best_ask_quantity long, best_ask_orders long",
    )


def change_feed(log: DataFrame, bbo: DataFrame) -> DataFrame:
    """Accepted order changes and BBO changes as one feed of (seq, kind)."""
    kinds = (
        F.when(F.col("action") == ADD, "added").when(F.col("action") == MODIFY, "modified")
        .otherwise("deleted")
    )
    orders = with_update_status(log).where(F.col("book_status") == 0).select(
        *KEY, "seq", kinds.alias("kind"), "order_id", "price", "quantity"
    )
    tops = bbo.select(*KEY, "seq", F.lit("bbo_changed").alias("kind"))
    return orders.unionByName(tops, allowMissingColumns=True)


def invariant_audit(intervals: DataFrame, levels: DataFrame, bbo: DataFrame) -> DataFrame:
    """Counts of broken book invariants, one row each."""
    order_rules = intervals.agg(
        F.count_if(F.col("price") <= 0).alias("order_price"),
        F.count_if(F.col("quantity") <= 0).alias("order_quantity"),
        F.count_if(F.col("end_seq") <= F.col("start_seq")).alias("order_span"),
    )
    level_rules = levels.agg(
        F.count_if(F.col("quantity") < 0).alias("level_quantity"),
        F.count_if(F.col("order_count") < 0).alias("level_count"),
        F.count_if((F.col("quantity") == 0) != (F.col("order_count") == 0)).alias("level_reconcile"),
    )
    top_rules = bbo.agg(
        F.count_if(F.col("best_bid_price") >= F.col("best_ask_price")).alias("crossed_states")
    )

    def long(df):
        return df.unpivot([], df.columns, "rule", "violations")

    return long(order_rules).unionByName(long(level_rules)).unionByName(long(top_rules))


# --- snapshots over increments -------------------------------------------------------------------


def with_snapshot_status(snapshots: DataFrame) -> DataFrame:
    """A snapshot is valid with at most ten levels a side in strict price order."""
    ok = (
        (F.size("bids") <= MAX_SNAPSHOT_LEVELS) & (F.size("asks") <= MAX_SNAPSHOT_LEVELS)
        & snapshot_is_monotone("bids", True) & snapshot_is_monotone("asks", False)
    )
    return snapshots.withColumn("is_valid_snapshot", ok)


def overlay_depth(log: DataFrame, snapshots: DataFrame, ts_ns: int) -> DataFrame:
    """L2 depth at ``ts_ns`` where each valid snapshot replaced all earlier state.

    Orders live between two snapshots only, so what the last valid snapshot of an instrument left behind is dropped
    before anything is ordered; its levels count as aggregate rows beside the orders that came after it.
    """
    good = with_snapshot_status(snapshots).where(F.col("is_valid_snapshot") & (F.col("ts_ns") <= ts_ns))
    cut = staged(good.groupBy(*KEY).agg(F.max("ts_ns").alias("cut_ns")), "cut")
    at, mark = F.struct("ts_ns", "order_id", "action"), F.struct("cut_ns", F.lit(0).cast("long"), F.lit(0).cast("long"))
    events = log.where(F.col("ts_ns") <= ts_ns).join(cut, KEY, "left").where(F.col("cut_ns").isNull() | (at > mark))
    events = with_log_sequence(events.drop("cut_ns"))
    l3 = l3_as_of(order_intervals(events), ts_ns)
    last = good.join(cut, KEY).where("ts_ns = cut_ns").groupBy(*KEY).agg(F.max(F.struct("bids", "asks")).alias("s"))
    levels = flatten_snapshots(last.select(*KEY, "s.*"), KEY).where((F.col("price") > 0) & (F.col("quantity") > 0))
    rows = l2_depth(l3).unionByName(
        levels.select(*KEY, "side", "price", "quantity",
                      F.greatest("order_count", F.lit(1)).alias("order_count"))
    )
    return rows.groupBy(*KEY, "side", "price").agg(
        F.sum("quantity").alias("quantity"), F.sum("order_count").alias("order_count")
    )
