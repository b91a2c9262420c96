"""Keyed state for the streaming operators.

Spark does not order rows inside a micro-batch, so every processor sorts a key's rows before it
advances the state, and the state after a batch is all a later batch needs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUY = 1


#: A key's rows are worked off in slices of so many, so that helper arrays do not grow with a batch.
SLICE_ROWS = 100_000


def _gather(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def _slices(rows: Iterator[pd.DataFrame], order: list[str]) -> Iterator[pd.DataFrame]:
    """A key's rows in ``order``, slice by slice; only the rows themselves are held as a whole, and once."""
    whole = pd.concat(list(rows), ignore_index=True)
    at = np.lexsort([whole[c].to_numpy() for c in reversed(order)])
    for start in range(0, len(at), SLICE_ROWS):
        yield whole.iloc[at[start:start + SLICE_ROWS]].reset_index(drop=True)


class RunningMax(StatefulProcessor):
    """Maximum of a column over all earlier rows of the key, in arrival order."""

    def __init__(self, value: str, order: str, start: int | None):
        self.value, self.order, self.start = value, order, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen long")

    def before_each(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(maximum before the row, whether there was an earlier row); advances the state."""
        values = pdf[self.value].to_numpy(dtype="int64")
        old = self.seen.get()[0] if self.seen.exists() else self.start
        low = np.iinfo("int64").min
        running = np.maximum.accumulate(np.concatenate(([low if old is None else old], values)))
        known = np.ones(len(values), dtype=bool)
        known[0] = old is not None
        self.seen.update((int(running[-1]),))
        return running[:-1], known

    def close(self) -> None:
        pass


class LateGuard(RunningMax):
    """Keeps rows not older than an earlier arrival of their instrument."""

    def __init__(self):
        super().__init__("source_timestamp_ns", "input_index", None)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in _slices(rows, ["input_index"]):
            before, known = self.before_each(pdf)
            keep = ~known | (pdf["source_timestamp_ns"].to_numpy() >= before)
            yield pdf[keep]


class SequenceGuard(RunningMax):
    """Sequence status per feed; gaps move the expectation forward."""

    def __init__(self):
        super().__init__("sequence_num", "input_index", 0)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in _slices(rows, ["input_index"]):
            m, _ = self.before_each(pdf)
            seq = pdf["sequence_num"].to_numpy()
            pdf["previous_sequence"] = m
            pdf["sequence_status"] = np.select(
                [seq == m + 1, seq > m + 1, seq == m], ["expected", "gap", "duplicate"], "out_of_order"
            )
            yield pdf


class QuoteFeatures(StatefulProcessor):
    """Quote features with the bounded history they need: one quote, and the last window of values."""

    def __init__(self, ofi_window: int, vol_window: int, lookback: int):
        self.ofi_window, self.vol_window, self.lookback = ofi_window, vol_window, lookback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "history",
            "quote array<long>, ofi array<long>, mids array<double>, returns array<double>,"
            " last_return double, last_vol double",
        )

    def handleInputRows(self, key, rows, timerValues):
        for pdf in _slices(rows, ["source_timestamp_ns", "sequence_num"]):
            yield self.with_features(pdf)

    def with_features(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows with their features; advances the state."""
        if self.state.exists():
            quote, ofi_old, mids_old, rets_old, last_ret, last_vol = self.state.get()
        else:
            quote, ofi_old, mids_old, rets_old, last_ret, last_vol = None, [], [], [], None, None
        bp, bq, ap, aq = (
            pdf[c].to_numpy(dtype="int64")
            for c in ("best_bid_price", "best_bid_quantity", "best_ask_price", "best_ask_quantity")
        )
        valid = (bp > 0) & (bq > 0) & (ap > 0) & (aq > 0) & (bp < ap)

        def shift(a, first):
            return np.concatenate(([first], a[:-1]))

        pbp, pbq, pap, paq, pv = (
            shift(a, quote[i] if quote else 0) for i, a in enumerate((bp, bq, ap, aq, valid))
        )
        flow = np.where(bp > pbp, bq, np.where(bp == pbp, bq - pbq, -pbq)) + np.where(
            ap < pap, -aq, np.where(ap == pap, paq - aq, paq)
        )
        has_ofi = valid & (pv != 0)
        n = self.ofi_window
        seq = np.concatenate((np.asarray(ofi_old, dtype="int64"), flow[has_ofi]))
        rolled = pd.Series(seq).rolling(n).sum().to_numpy()[len(ofi_old):]
        instant = pd.array(flow, dtype="Int64")
        instant[~has_ofi] = pd.NA
        rolling = pd.array([pd.NA] * len(pdf), dtype="Int64")
        full = np.flatnonzero(has_ofi)[~np.isnan(rolled)]
        rolling[full] = rolled[~np.isnan(rolled)].astype("int64")

        mids = np.concatenate((np.asarray(mids_old, dtype="float64"), (bp + ap)[valid] / 2.0))
        rets = np.full(len(mids), np.nan)
        k = self.lookback
        rets[k:] = np.log(mids[k:] / mids[:-k])
        fresh = rets[len(mids_old):]
        series = np.concatenate((np.asarray(rets_old, dtype="float64"), fresh[~np.isnan(fresh)]))
        vols = pd.Series(series).rolling(self.vol_window).apply(lambda w: w.std(ddof=1), raw=True)
        vol = np.full(len(fresh), np.nan)
        vol[~np.isnan(fresh)] = vols.to_numpy()[len(rets_old):]
        out_ret, out_vol = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
        out_ret[valid], out_vol[valid] = fresh, vol

        def carried(a, last):
            head = np.nan if last is None else last
            return pd.Series(np.concatenate(([head], a))).ffill().to_numpy()[1:]

        out_ret, out_vol = carried(out_ret, last_ret), carried(out_vol, last_vol)
        pdf["instant_ofi"], pdf["rolling_ofi"] = instant, rolling
        pdf["log_return"], pdf["realized_volatility"] = out_ret, out_vol
        tail = [int(x) for x in (bp[-1], bq[-1], ap[-1], aq[-1], valid[-1])]

        def last(x):
            return None if np.isnan(x) else float(x)

        self.state.update(
            (
                tail, [int(x) for x in seq[max(0, len(seq) - n + 1):]],
                [float(x) for x in mids[-k:]],
                [float(x) for x in series[max(0, len(series) - self.vol_window + 1):]],
                last(out_ret[-1]), last(out_vol[-1]),
            )
        )
        return pdf

    def close(self) -> None:
        pass


class BookKeeper(StatefulProcessor):
    """Live orders and price levels of one instrument; emits the BBO after each change of it.

    Under the ``reject`` policy an add or a price change that would cross the other side is refused;
    that depends on the book at that moment, which is why it exists only as keyed state.
    """

    def __init__(self, policy: str = "allow"):
        if policy not in ("allow", "reject"):
            raise ValueError(f"unknown crossed-book policy {policy!r}")
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.orders = handle.getMapState("orders", "order_id long", "side long, price long, quantity long")
        self.levels = handle.getMapState("levels", "side long, price long", "quantity long, n long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _gather(rows, ["seq"])
        levels: dict[tuple[int, int], list[int]] = {
            (int(k[0]), int(k[1])): [int(v[0]), int(v[1])] for k, v in self.levels.iterator()
        }
        heaps = {1: [-p for s, p in levels if s == 1], 2: [p for s, p in levels if s == 2]}
        for h in heaps.values():
            heapq.heapify(h)
        # The state holds live orders only; it is read as a whole, since every single look-up is a round trip.
        known = {int(k[0]): tuple(int(x) for x in v) for k, v in self.orders.iterator()}
        known_levels = set(levels)
        touched, orders = set(), dict(known)

        def shift(side, price, dq, dn):
            at = (side, price)
            if at not in levels:
                levels[at] = [0, 0]
                heapq.heappush(heaps[side], -price if side == BUY else price)
            levels[at][0] += dq
            levels[at][1] += dn
            touched.add(at)
            if levels[at][1] == 0:
                del levels[at]

        def best(side):
            heap = heaps[side]
            while heap:
                price = -heap[0] if side == BUY else heap[0]
                if (side, price) in levels:
                    return (price, *levels[(side, price)])
                heapq.heappop(heap)
            return (None, None, None)

        def crosses(side, price):
            other = best(3 - side)[0]
            if self.policy == "allow" or other is None:
                return False
            return price >= other if side == BUY else price <= other

        def apply(action, oid, side, price, quantity):
            if oid == 0:
                return
            live = orders.get(oid)
            if action == 4:
                if price > 0 and quantity > 0 and side in (1, 2) and not live and not crosses(side, price):
                    orders[oid] = (side, price, quantity)
                    shift(side, price, quantity, 1)
            elif action == 5:
                if price > 0 and quantity > 0 and live:
                    if price != live[1] and crosses(live[0], price):
                        return
                    shift(live[0], live[1], -live[2], -1)
                    shift(live[0], price, quantity, 1)
                    orders[oid] = (live[0], price, quantity)
            elif action == 6 and live:
                shift(live[0], live[1], -live[2], -1)
                del orders[oid]

        out, last = [], (*best(1), *best(2))
        columns = ["seq", "action", "order_id", "side", "price", "quantity"]
        for seq, *event in pdf[columns].itertuples(index=False):
            apply(*(int(x) for x in event))
            now = (*best(1), *best(2))
            if now != last:
                out.append((seq, *now))
                last = now
        for oid, o in orders.items():
            if known.get(oid) != o:
                self.orders.updateValue((oid,), o)
        for oid in known.keys() - orders.keys():
            self.orders.removeKey((oid,))
        for at in touched:
            if at in levels:
                self.levels.updateValue(at, tuple(levels[at]))
            elif at in known_levels:
                self.levels.removeKey(at)
        names = ["seq", "best_bid_price", "best_bid_quantity", "best_bid_orders", "best_ask_price",
                 "best_ask_quantity", "best_ask_orders"]
        res = pd.DataFrame(out, columns=names).astype("Int64")
        res.insert(0, "instrument_id", int(key[0]))
        yield res

    def close(self) -> None:
        pass
