"""The state of recorded orders, as a stream keyed by account.

The input is a log of what happened to orders; nothing is matched here. The state of an
account is a map of its active orders. An order is ``submitting`` until it is accepted
(``not_traded``), then ``part_traded`` or ``all_traded`` by its fills; it ends when all of
it is traded, when it is cancelled or rejected, or at its time of expiry. Orders that have
ended leave the state, so that it grows with the active orders alone.

Every event gives one row: the order as it is afterwards and the ``effect`` (opened,
accepted, filled, cancelled, rejected, or ignored where the order is not active or, of a
second submission, is still active; a rejection counts only before anything was traded). An
expiry is a row of its own at the order's time of expiry, before any later event of its
account, or when the watermark has passed it. A fill of more than is left counts as what is
left. An id can be used again once its order has ended; ``opened`` tells such orders apart.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

CHANGES = "account long, order_id string, opened long, ts timestamp, seq long, effect string, status string, side string, qty double, filled double, avg_price double"
ORDER = "opened long, status string, side string, qty double, filled double, notional double, expires long"
Event = namedtuple("Event", "at seq kind order_id side qty price")


class Account:
    """Active orders of one account: id to [opened, status, side, qty, filled, notional, expires in microseconds]."""

    def __init__(self, account: int, active: dict[str, list], ttl: int) -> None:
        self.account, self.active, self.ttl = account, active, ttl
        self.stored, self.alarm = set(active), self.next_expiry()
        self.changed: set[str] = set()

    def next_expiry(self) -> int | None:
        """When the first of the active orders ends, in milliseconds, as timers have them."""
        return min((-(-o[6] // 1000) for o in self.active.values()), default=None)

    def row(self, order_id: str, order: list | None, at: int, seq: int | None, effect: str) -> tuple:
        opened, status, side, qty, filled, notional, _ = order or [None] * 7
        average = notional / filled if filled else None
        return self.account, order_id, opened, at, seq, effect, status, side, qty, filled, average

    def close(self, order_id: str, status: str) -> list:
        order = self.active.pop(order_id)
        order[1] = status
        self.changed.add(order_id)
        return order

    def expire(self, upto: int) -> Iterator[tuple]:
        """Orders whose time of expiry is not after ``upto``, in the order of that time."""
        for _, order_id in sorted((o[6], i) for i, o in self.active.items() if o[6] <= upto):
            order = self.close(order_id, "cancelled")
            yield self.row(order_id, order, order[6], None, "expired")

    def apply(self, e) -> tuple:
        """What one event does."""
        at, order = e.at, self.active.get(e.order_id)
        if e.kind == "submit" and order is None:
            order = self.active[e.order_id] = [e.seq, "submitting", e.side, e.qty, 0.0, 0.0, at + self.ttl]
            effect = "opened"
        elif order is not None and e.kind == "accept" and order[1] == "submitting":
            order[1], effect = "not_traded", "accepted"
        elif order is not None and e.kind == "fill":
            n = min(e.qty, order[3] - order[4])
            order[4], order[5] = order[4] + n, order[5] + n * e.price
            order[1], effect = "part_traded", "filled"
            if order[4] >= order[3]:
                order = self.close(e.order_id, "all_traded")
        elif order is not None and e.kind == "cancel":
            order, effect = self.close(e.order_id, "cancelled"), "cancelled"
        elif order is not None and e.kind == "reject" and order[4] == 0:
            order, effect = self.close(e.order_id, "rejected"), "rejected"
        else:
            return self.row(e.order_id, order, at, e.seq, "ignored")
        self.changed.add(e.order_id)
        return self.row(e.order_id, order, at, e.seq, effect)


class OrderStates(StatefulProcessor):
    """Keeps the map of active orders and one timer, for the next expiry among them.

    Only what differs from the stored state is sent to it: orders that open and end within a
    micro-batch never reach it, and their expiry needs no timer.
    """

    columns = [c.split()[0] for c in CHANGES.split(", ")]

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.orders = handle.getMapState("active", "order_id string", ORDER)

    def load(self, account: int) -> Account:
        return Account(account, {k[0]: list(v) for k, v in self.orders.iterator()}, self.ttl)

    def save(self, account: Account) -> None:
        for order_id in account.changed:
            if order_id in account.active:
                self.orders.updateValue((order_id,), tuple(account.active[order_id]))
            elif order_id in account.stored:
                self.orders.removeKey((order_id,))
        alarm = account.next_expiry()
        if alarm != account.alarm:
            if account.alarm is not None:
                self.handle.deleteTimer(account.alarm)
            if alarm is not None:
                self.handle.registerTimer(alarm)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        account, out = self.load(key[0]), []
        # An account's rows of one micro-batch are put in order; maxFilesPerTrigger bounds them.
        parts = [[f[c].to_numpy() for c in Event._fields] for f in rows]
        columns = dict(zip(Event._fields, (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True))
        order = np.lexsort((columns["seq"], columns["at"]))
        for e in map(Event, *(c[order].tolist() for c in columns.values())):
            out += account.expire(e.at)
            out.append(account.apply(e))
        self.save(account)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        account = self.load(key[0])
        # All that the watermark has passed, so that the next timer lies ahead of it.
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        out = list(account.expire(upto * 1000))
        account.alarm = None  # has gone off
        self.save(account)
        yield self.frame(out)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.columns)
        return out.assign(ts=pd.to_datetime(out["ts"], unit="us"))

    def close(self) -> None:
        pass


def order_changes(log: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Changes of orders from a stream (account, seq, ts, kind, order_id, side, qty, price).

    ``kind`` is submit, accept, fill, cancel or reject. Micro-batches follow one another in
    time; rows behind the watermark are dropped. The state store must be RocksDB
    (:func:`tidemark.streaming.flows.disk_state`).
    """
    timed = log.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("account").transformWithStateInPandas(OrderStates(ttl_seconds), CHANGES, "Append", "EventTime")


def last_states(changes: DataFrame) -> DataFrame:
    """Every order as its last change left it."""
    known = changes.where("effect <> 'ignored'")
    newest = F.struct("ts", F.coalesce("seq", F.lit(-1)), "effect")
    value = F.struct("status", "side", "qty", "filled", "avg_price", "effect")
    g = known.groupBy("account", "order_id", "opened").agg(F.max_by(value, newest).alias("v"), F.count(F.lit(1)).alias("n_changes"))
    return g.select("account", "order_id", "opened", "v.status", "v.side", "v.qty", "v.filled", "v.avg_price", (F.col("v.effect") == "expired").alias("expired"), "n_changes")
