"""Streams that are fed in several parts, restarted and replayed."""

import datetime as dt

import pytest

from tidemark.streaming import flows, orders

T = dt.datetime(2024, 1, 1)
LOG = "account long, seq long, ts timestamp, kind string, order_id string, side string, qty double, price double"


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def stream_of(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def states(changes):
    keys = ["order_id", "opened", "status", "filled", "avg_price", "expired", "n_changes"]
    return sorted(tuple(r[k] for k in keys) for r in orders.last_states(changes).collect())


EVENTS = [
    (1, 1, at(0), "submit", "a", "buy", 10.0, 1.0),
    (1, 2, at(1), "fill", "a", "buy", 4.0, 10.0),
    (1, 3, at(1), "submit", "b", "sell", 5.0, 1.0),
    (1, 4, at(2), "submit", "b", "sell", 9.0, 1.0),  # still active: ignored
    (1, 5, at(3), "reject", "b", "sell", 0.0, 1.0),
    (1, 6, at(4), "fill", "b", "sell", 1.0, 1.0),  # no longer active: ignored
    (2, 7, at(5), "submit", "c", "buy", 3.0, 1.0),
    (2, 8, at(6), "accept", "c", "buy", 0.0, 1.0),
    (1, 9, at(10), "fill", "a", "buy", 100.0, 20.0),  # more than is left
    (1, 10, at(11), "submit", "b", "buy", 2.0, 1.0),  # the id again
    (1, 11, at(12), "cancel", "b", "buy", 0.0, 1.0),
    (1, 12, at(13), "submit", "d", "buy", 2.0, 1.0),
    (2, 13, at(500), "submit", "e", "buy", 1.0, 1.0),
    (3, 14, at(502), "cancel", "x", "buy", 1.0, 1.0),  # never seen
]
WANT = sorted([
    ("a", 1, "all_traded", 10.0, 16.0, False, 3),
    ("b", 3, "rejected", 0.0, None, False, 2),
    ("b", 10, "cancelled", 0.0, None, False, 2),
    ("c", 7, "cancelled", 0.0, None, True, 3),
    ("d", 12, "cancelled", 0.0, None, True, 2),  # nothing of its account comes after it: a timer ends it
    ("e", 13, "submitting", 0.0, None, False, 1),
])


@pytest.mark.parametrize("cuts", [[14], [5, 9, 14], [1, 2, 3, 12, 14]])
def test_order_states_do_not_depend_on_micro_batches_or_restarts(spark, tmp_path, cuts):
    log, out, before = str(tmp_path / "log"), str(tmp_path / "run"), 0
    for cut in cuts:
        put(spark, EVENTS[before:cut], LOG, log)
        before = cut
        with flows.disk_state(spark):  # a new query from the checkpoint each time
            changes = flows.drain(orders.order_changes(stream_of(spark, log, LOG), 3600), out)
    assert states(changes) == WANT
    effects = {r.seq: r.effect for r in changes.where("seq is not null").collect()}
    assert len(effects) == len(EVENTS) and [s for s, e in sorted(effects.items()) if e == "ignored"] == [4, 6, 14]
    expired = {r.order_id: r.ts for r in changes.where("effect = 'expired'").collect()}
    assert expired == {"c": at(65), "d": at(73)}


def test_the_state_of_an_account_is_its_active_orders():
    account = orders.Account(1, {}, 60_000_000)
    event = lambda seq, minute, kind: type("E", (), {"seq": seq, "at": minute * 60_000_000, "kind": kind, "order_id": "a", "side": "buy", "qty": 1.0, "price": 2.0})
    assert account.apply(event(1, 0, "submit"))[5:7] == ("opened", "submitting")
    assert account.apply(event(2, 0, "accept"))[5:7] == ("accepted", "not_traded")
    assert account.apply(event(3, 0, "accept"))[5:7] == ("ignored", "not_traded")
    assert [r[5] for r in account.expire(59_999_999)] == [] and [r[5] for r in account.expire(60_000_000)] == ["expired"]
    assert account.active == {}


def test_only_active_orders_and_one_timer_reach_the_state():
    """What an account's micro-batch asks of the state store grows with its active orders, not with its events."""
    import pandas as pd

    calls, held = [], {}

    class Map:
        iterator = lambda self: iter(list(held.items()))
        containsKey = lambda self, k: calls.append("has") or k in held  # noqa: E731, N815
        updateValue = lambda self, k, v: calls.append("put") or held.__setitem__(k, v)  # noqa: E731, N815
        removeKey = lambda self, k: calls.append("drop") or held.pop(k)  # noqa: E731, N815

    class Handle:
        getMapState = lambda self, *a: Map()  # noqa: E731, N815
        registerTimer = lambda self, ms: calls.append(("timer", ms))  # noqa: E731, N815
        deleteTimer = lambda self, ms: calls.append(("no timer", ms))  # noqa: E731, N815

    def events(first, n, left):
        rows = [(1, s, None, kind, f"o{i}", "buy", 1.0, 2.0, (s + 1) * 1_000_000) for i in range(n) for s, kind in ((first + 2 * i, "submit"), (first + 2 * i + 1, "cancel")) if kind == "submit" or i >= left]
        return iter([pd.DataFrame(rows, columns="account seq ts kind order_id side qty price at".split())])

    states = orders.OrderStates(3600)
    states.init(Handle())
    out = pd.concat(states.handleInputRows((1,), events(0, 50, 2), None))
    assert len(out) == 98 and sorted(k[0] for k in held) == ["o0", "o1"]
    assert calls == ["put", "put", ("timer", 3_601_000)]
    calls.clear()
    passed = type("T", (), {"getCurrentWatermarkInMs": lambda self: 3_602_000})()
    fired = type("I", (), {"getExpiryTimeInMs": lambda self: 3_601_000})()
    out = pd.concat(states.handleExpiredTimer((1,), passed, fired))
    assert list(out.effect) == ["expired"] and list(held) == [("o1",)] and calls == ["drop", ("timer", 3_603_000)]
