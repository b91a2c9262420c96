"""Affine scans against a loop, and the maker's account that rests on them."""

import random

import pytest
from tapeframe.operators import affine, quoting


@pytest.mark.parametrize("block, n", [(64, 1), (64, 64), (4, 300), (2, 33)])
def test_affine_scan_matches_loop(spark, both_plans, monkeypatch, block, n):
    monkeypatch.setattr(affine, "BLOCK", block)
    rng = random.Random(n)
    rows = [(k, t, i, rng.choice([0.0, 0.5, 1.0, -1.0, 0.9]), rng.choice([0.0, 1.0, -2.5])) for k in range(3) for i, t in enumerate(
        sorted(rng.randrange(50) for _ in range(n if k else 1)))]
    want = {}
    for k in range(3):
        x = 7.0
        for _, t, i, a, b in sorted(r for r in rows if r[0] == k):
            x = a * x + b
            want[k, i] = x
    df = spark.createDataFrame(rows, "k long, t long, i long, a double, b double").repartition(4)
    got = affine.affine_scan(df, ["k"], ["t", "i"], "a", "b", "x", 7.0).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.x == pytest.approx(want[r.k, r.i], abs=1e-9)
    assert affine.affine_scan(df.limit(0), ["k"], ["t", "i"], "a", "b", "x").collect() == []


def test_account_at_each_quote_matches_loop(spark, both_plans):
    rng = random.Random(2)
    fills = [(1, t, s, rng.choice([-1, 1]) * rng.randint(1, 9), rng.randint(900, 1100)) for s, t in enumerate(sorted(rng.randrange(100) for _ in range(60)))]
    quotes = [(1, s, t, 1000 if s % 7 else 0, 1004) for s, t in enumerate(range(-5, 110, 3))]
    f = spark.createDataFrame(fills, "instrument_id long, fill_ts long, fill_seq long, signed_quantity long, price long").selectExpr(
        "*", "0.003D * abs(signed_quantity) transaction_cost")
    q = spark.createDataFrame(quotes, "instrument_id long, sequence_num long, ts long, best_bid_price long, best_ask_price long")
    got = {r.sequence_num: r for r in quoting.account_as_of(q, f, ["instrument_id"], "ts", "fill_ts", ["fill_seq"], 500.0).collect()}
    assert len(got) == len(quotes)
    for _, s, at, bid, ask in quotes:
        held, entry, cash, realised = 0, 0.0, 500.0, 0.0
        for _, t, _, sq, ticks in fills:
            if t > at:
                continue
            price = ticks / 100.0
            cash -= sq * price + 0.003 * abs(sq)
            if held * sq < 0:
                realised += min(abs(held), abs(sq)) * (price - entry if held > 0 else entry - price)
            new = held + sq
            if new == 0:
                entry = 0.0
            elif held * new <= 0:
                entry = price
            elif held * sq > 0:
                entry = (abs(held) * entry + abs(sq) * price) / abs(new)
            held = new
        r = got[s]
        assert r.inventory == held and r.cash == pytest.approx(cash) and r.average_entry_price == pytest.approx(entry)
        assert r.realized_pnl == pytest.approx(realised)
        marked = held * ((bid + ask) / 200.0 - entry) if bid > 0 and held else 0.0
        assert r.unrealized_pnl == pytest.approx(marked)
