"""Book views against a small sequential book, and fault statuses."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeframe.operators import book as ops
from tapeframe.streaming import streams

LOG = "instrument_id long, seq long, action long, order_id long, side long, price long, quantity long, ts_ns long"


def _random_log(seed, n=260):
    """Mostly well-formed events with unknown ids, duplicates and bad fields mixed in."""
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        rows.append((
            1 if rng.random() < 0.8 else 2, i, rng.choice([4, 4, 5, 6]), rng.randint(0, 25),
            rng.choice([1, 2, 2, 1, 0]), rng.choice([0, *range(95, 106)]), rng.randint(0, 6), i * 10,
        ))
    return rows


class Book:
    """Sequential book used only as the expected result."""

    def __init__(self, reject=False):
        self.orders, self.reject, self.tick = {}, reject, 0

    def best(self, side):
        prices = [o[1] for o in self.orders.values() if o[0] == side]
        if not prices:
            return (None, None, None)
        p = max(prices) if side == 1 else min(prices)
        q = [o[2] for o in self.orders.values() if o[0] == side and o[1] == p]
        return (p, sum(q), len(q))

    def crossing(self, side, price):
        other = self.best(3 - side)[0]
        return self.reject and other is not None and (price >= other if side == 1 else price <= other)

    def apply(self, action, oid, side, price, qty):
        self.tick += 1
        if oid == 0:
            return 1
        if action != 6 and price <= 0:
            return 4
        if action != 6 and qty == 0:
            return 5
        if action == 4:
            if side not in (1, 2):
                return 9
            if oid in self.orders:
                return 2
            if self.crossing(side, price):
                return 7
            self.orders[oid] = [side, price, qty, self.tick]
        elif oid not in self.orders:
            return 3
        elif action == 6:
            del self.orders[oid]
        else:
            o = self.orders[oid]
            if price != o[1] and self.crossing(o[0], price):
                return 7
            if price != o[1] or qty > o[2]:
                o[3] = self.tick
            o[1], o[2] = price, qty
        return 0


def _replay(rows, reject=False):
    books, status, bbo = {}, {}, {}
    for inst, seq, action, oid, side, price, qty, _ in rows:
        b = books.setdefault(inst, Book(reject))
        before = (*b.best(1), *b.best(2))
        status[seq] = b.apply(action, oid, side, price, qty)
        now = (*b.best(1), *b.best(2))
        if now != before:
            bbo[seq] = now
    return books, status, bbo


def _bbo_map(df):
    return {
        r.seq: (r.best_bid_price, r.best_bid_quantity, r.best_bid_orders, r.best_ask_price,
                r.best_ask_quantity, r.best_ask_orders) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_status_bbo_and_queue(spark, both_plans, seed):
    rows = _random_log(seed)
    log = spark.createDataFrame(rows, LOG)
    books, status, bbo = _replay(rows)
    got = {r.seq: r.book_status for r in ops.with_update_status(log).collect()}
    assert got == status
    iv = ops.order_intervals(log)
    for chunk in (1, 2, 7, 20, 50, 10_000):
        assert _bbo_map(ops.bbo_timeline(iv, chunk)) == bbo
    l3 = ops.l3_as_of(iv, 10**9)
    place = {(r.instrument_id, r.order_id): (r.queue_position, r.quantity_ahead)
             for r in ops.queue_positions(l3).collect()}
    for inst, b in books.items():
        for oid, (side, price, _, tick) in b.orders.items():
            ahead = [o[2] for o in b.orders.values() if o[0] == side and o[1] == price and o[3] < tick]
            assert place.pop((inst, oid)) == (len(ahead), sum(ahead))
    assert not place


def test_a_chunk_starts_from_the_book_before_its_first_event(spark):
    """The event at a cut takes the best level away, or leaves the book's top as it was."""
    rows = [(1, 8, 4, 1, 1, 100, 5, 8), (1, 9, 4, 2, 1, 99, 5, 9), (1, 9, 4, 3, 2, 110, 5, 9), (1, 10, 6, 1, 1, 100, 5, 10),
            (1, 11, 4, 4, 1, 90, 1, 11)]
    log = ops.with_log_sequence(spark.createDataFrame(rows, LOG).drop("seq")).withColumn("seq", F.col("seq") + 6)
    iv = ops.order_intervals(log)
    want = _bbo_map(ops.bbo_timeline(iv, 10_000))
    assert want[10] == (99, 5, 1, 110, 5, 1) and 11 not in want
    for chunk in (1, 2, 3, 5, 10, 11):
        assert _bbo_map(ops.bbo_timeline(iv, chunk)) == want


def test_reject_policy_stream(spark):
    rows = _random_log(9)
    log = spark.createDataFrame(rows, LOG)
    _, status, bbo = _replay(rows, reject=True)
    assert 7 in status.values()
    out = streams.run_in_steps(
        [log.where(F.col("seq") <= 120), log.where(F.col("seq") > 120)],
        lambda s: streams.bbo_feed(s, "reject"), "test-reject")
    assert _bbo_map(out) == bbo


def test_decrease_keeps_place_increase_loses_it(spark):
    rows = [(1, 1, 4, 1, 1, 100, 5, 1), (1, 2, 4, 2, 1, 100, 5, 2), (1, 3, 4, 3, 1, 100, 5, 3),
            (1, 4, 5, 1, 1, 100, 3, 4), (1, 5, 5, 2, 1, 100, 9, 5)]
    l3 = ops.l3_as_of(ops.order_intervals(spark.createDataFrame(rows, LOG)), 10)
    got = ops.orders_at_level(l3, 100).orderBy("queue_position").collect()
    assert [(r.order_id, r.quantity) for r in got] == [(1, 3), (3, 5), (2, 9)]


def test_executions(spark):
    rows = [(1, 1, 4, 1, 1, 100, 5, 1), (1, 2, 3, 1, 1, 100, 2, 2), (1, 3, 3, 1, 1, 100, 4, 3),
            (1, 4, 3, 1, 1, 100, 3, 4), (1, 5, 5, 1, 1, 100, 3, 5)]
    got = ops.trade_reductions(spark.createDataFrame(rows, LOG)).orderBy("seq").collect()
    assert [(r.book_status, r.remaining) for r in got] == [(0, 5), (0, 3), (6, 3), (0, 0), (3, 0)]


def test_snapshot_status(spark):
    level = "array<struct<price:long,quantity:long,order_count:long>>"
    rows = [(1, [(10, 1, 1), (9, 1, 1)], [(11, 1, 1)]), (2, [(9, 1, 1), (9, 1, 1)], []),
            (3, [(20 - i, 1, 1) for i in range(11)], []), (4, [], [])]
    df = spark.createDataFrame(rows, f"id long, bids {level}, asks {level}")
    got = {r.id: r.is_valid_snapshot for r in ops.with_snapshot_status(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_short_chunks_share_a_group(spark):
    """Chunks of 50 events are not a Python call each, and each still starts from its own carried levels."""
    def walk(pdf):
        walk.groups += 1
        return ops._best_after_each(pdf)

    walk.groups = 0
    frame = pd.DataFrame(
        [(1, 1, 50, 1, 100, 5, 1, False), (1, 2, 50, 1, 100, 5, 1, True), (1, 2, 100, 1, 100, 0, 0, False),
         (1, 2, 100, 1, 101, 5, 1, False), (1, 3, 100, 1, 101, 5, 1, True), (1, 3, 150, 1, 101, 5, 1, False)],
        columns=["instrument_id", "chunk", "seq", "side", "price", "quantity", "order_count", "carried"])
    got = walk(frame.sample(frac=1, random_state=3))
    assert got[["seq", "best_bid_price"]].to_numpy().tolist() == [[50, 100], [100, 101]] and walk.groups == 1
    iv = ops.order_intervals(spark.createDataFrame(_random_log(1), LOG))
    plan = ops.bbo_timeline(iv, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [instrument_id" in plan and ", group#" in plan


class Counted:
    """A map state that counts its look-ups."""

    def __init__(self, held=()):
        self.held, self.lookups = dict(held), 0

    def iterator(self):
        return iter(list(self.held.items()))

    def containsKey(self, key):
        self.lookups += 1
        return key in self.held

    def getValue(self, key):
        self.lookups += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


def test_the_book_stream_reads_its_state_as_a_whole():
    """A look-up per order would be a round trip each; what is kept is the live orders and levels."""
    from tapeframe.streaming.processors import BookKeeper

    rows = [r for r in _random_log(9) if r[0] == 1]
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")])
    keeper = BookKeeper("reject")
    keeper.orders, keeper.levels = Counted(), Counted()
    for part in (frame.iloc[:90], frame.iloc[90:]):
        list(keeper.handleInputRows((1,), iter([part]), None))
    book = _replay(rows, reject=True)[0][1]
    assert keeper.orders.lookups == keeper.levels.lookups == 0
    assert keeper.orders.held == {(oid,): tuple(o[:3]) for oid, o in book.orders.items()}
    assert {k for k in keeper.levels.held} == {(o[0], o[1]) for o in book.orders.values()}


def test_overlay_orders_only_what_came_after_the_snapshot(spark, monkeypatch):
    """Three instruments: one with a late snapshot, one whose only snapshot is out of order, one with none."""
    level = "array<struct<price:bigint,quantity:bigint,order_count:bigint>>"
    log = spark.createDataFrame(
        [(i, 4, o, 1, 90 + o % 3, 10, o * 10) for i in (1, 2, 3) for o in range(1, 41)] + [(1, 6, 39, 1, 90, 10, 405)],
        "instrument_id long, action long, order_id long, side long, price long, quantity long, ts_ns long")
    snaps = spark.createDataFrame(
        [(1, 370, [(95, 7, 2), (94, 5, 0)], []), (1, 100, [(80, 1, 1)], []), (1, 900, [(81, 1, 1)], []),
         (2, 370, [(94, 1, 1), (95, 1, 1)], [])],
        f"instrument_id long, ts_ns long, bids {level}, asks {level}")
    ordered, plain = [], ops.running

    def counted(df, *args, **carries):
        ordered.append(df.count())
        return plain(df, *args, **carries)

    monkeypatch.setattr(ops, "running", counted)
    got = {(r.instrument_id, r.price): (r.quantity, r.order_count) for r in ops.overlay_depth(log, snaps, 500).collect()}
    whole = {90: (130, 13), 91: (140, 14), 92: (130, 13)}
    # At 370 the snapshot sorts before the order of that instant; order 39 is deleted again.
    late = {91: (20, 2), 92: (10, 1), 95: (7, 2), 94: (5, 1)}
    assert got == {(1, p): x for p, x in late.items()} | {(i, p): x for i in (2, 3) for p, x in whole.items()}
    assert ordered == [5 + 40 + 40]


def test_the_audit_works_its_levels_out_once(spark, monkeypatch):
    """The level timeline is a scan of the whole log; its counts and the BBO read one and the same."""
    from tapeframe.plans import book as plan

    calls, plain = [], ops.level_timeline

    def counted(intervals):
        calls.append(1)
        return plain(intervals)

    monkeypatch.setattr(ops, "level_timeline", counted)
    got = {r.rule: r.violations for r in plan.book_invariants(spark, "/root/testdata/sf0.001").collect()}
    assert len(calls) == 1 and len(got) == 7 and not any(v for k, v in got.items() if k != "crossed_states")
