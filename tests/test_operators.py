"""Hand-computed cases of the engine's operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs, joins, portfolio, simulation, stats, upsert

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_asof_backward_strict_and_forward(spark):
    q = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 50.0), ("b", 3, 30.0)], "k string, t int, v double")
    p = spark.createDataFrame([("a", 0), ("a", 5), ("a", 9), ("c", 4)], "k string, t int")
    back = joins.asof_join(p, q, "k", "t", ["v"])
    assert rows(back.select("k", "t", "v"), "k", "t") == [("a", 0, None), ("a", 5, 50.0), ("a", 9, 50.0), ("c", 4, None)]
    strict = joins.asof_join(p, q, "k", "t", ["v"], strict=True)
    assert rows(strict.select("k", "t", "v"), "k", "t") == [("a", 0, None), ("a", 5, 10.0), ("a", 9, 50.0), ("c", 4, None)]
    ahead = joins.asof_join(p, q, "k", "t", ["v"], direction="forward")
    assert rows(ahead.select("k", "t", "v"), "k", "t") == [("a", 0, 10.0), ("a", 5, 50.0), ("a", 9, None), ("c", 4, None)]
    later = joins.asof_join(p, q, "k", "t", ["v"], direction="forward", strict=True)
    assert rows(later.select("k", "t", "v"), "k", "t")[1] == ("a", 5, None)


def test_joins_plan_without_cartesian_products(spark):
    q = spark.createDataFrame([("a", 1, 10.0)], "k string, t long, v double")
    p = spark.createDataFrame([("a", 5, 0, 9)], "k string, t long, lo long, hi long")
    for df in (joins.asof_join(p, q, "k", "t", ["v"]), joins.range_join(p.drop("t"), q, "k", "t", "lo", "hi", 4)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_range_join_covers_bucket_borders(spark):
    left = spark.createDataFrame([("a", 3, 8)], "k string, lo long, hi long")
    right = spark.createDataFrame([("a", t) for t in range(12)] + [("b", 5)], "k string, t long")
    assert [r.t for r in joins.range_join(left, right, "k", "t", "lo", "hi", 4).orderBy("t").collect()] == [3, 4, 5, 6, 7, 8]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert rows(upsert.upsert_last(old, new, ["id"]), "id") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(upsert.insert_ignore(old, new, ["id"], [F.col("v")]), "id") == [(1, "a"), (2, "b"), (3, "d")]


def test_netting_of_two_sleeves(spark):
    v = spark.createDataFrame([("s1", "m", 1.0, "AAPL", D(2024, 6, 7), 1.0, False), ("s1", "m", 1.0, "MSFT", D(2024, 6, 7), 1.0, False), ("s2", "m", 1.0, "MSFT", D(2024, 6, 7), -1.0, False)], "strategy string, model string, weight double, ticker string, d date, value double, abstained boolean")
    out = portfolio.net(portfolio.blend(v), {"s1": 3.0, "s2": 1.0})
    assert rows(out.select("ticker", "weight"), "ticker") == [("AAPL", 0.375), ("MSFT", 0.125)]


def test_blend_leaves_abstained_views_out(spark):
    v = spark.createDataFrame([("s", "a", 3.0, "X", D(2024, 1, 1), 1.0, False), ("s", "b", 1.0, "X", D(2024, 1, 1), 0.0, False), ("s", "c", 9.0, "X", D(2024, 1, 1), -1.0, True)], "strategy string, model string, weight double, ticker string, d date, value double, abstained boolean")
    assert portfolio.blend(v).first()["conviction"] == 0.75


def test_fund_fold_golden(spark):
    days = [(D(2024, 6, 7), 100.0), (D(2024, 6, 14), 105.0), (D(2024, 6, 21), 95.0)]
    r = spark.createDataFrame([("f", d, "A", 1.0, p) for d, p in days], "fund string, d date, ticker string, weight double, mark double")
    out = simulation.fund_fold(r, 100_000.0).orderBy("d").collect()
    assert [x.equity for x in out] == [100_000.0, 105_000.0, 95_000.0]
    assert sum(x.n_orders for x in out) == 1


def test_a_fund_that_cannot_be_valued_ends_alone(spark):
    days = [D(2024, 6, 7), D(2024, 6, 14), D(2024, 6, 21)]
    hole = [("f", d, t, 0.5, 100.0) for d in days for t in "AB" if (d, t) != (days[1], "B")]
    broke = [("g", days[0], "A", 1.0, 100.0), ("g", days[0], "B", -3.0, 100.0), ("g", days[1], "A", 1.0, 10.0), ("g", days[1], "B", 1.0, 200.0)]
    whole = [("h", d, "A", 1.0, 50.0) for d in days]
    rows_ = simulation.fund_fold(spark.createDataFrame(hole + broke + whole, "fund string, d date, ticker string, weight double, mark double"), 1000.0)
    got = [(r.fund, r.d, r.equity, r.error) for r in rows_.orderBy("fund", "d").collect()]
    assert got == [("f", days[0], 1000.0, None), ("f", days[1], None, "no mark of B"), ("g", days[0], 1000.0, None), ("g", days[1], None, "no equity left"), *[("h", d, 1000.0, None) for d in days]]
    with pytest.raises(ValueError, match="f: no mark of B on 2024-06-14"):
        simulation.strictly(rows_)
    assert simulation.strictly(rows_.where("fund = 'h'")).count() == 3


def test_edge_trades_do_not_overlap(spark):
    r = spark.createDataFrame([("T", D(2024, 1, 1) + dt.timedelta(i), 50.0, 1) for i in range(30)], "ticker string, d date, close double, signal int")
    out = simulation.edge_trades(r, 5, 10_000.0).collect()
    assert len(out) == 1 and out[0].shares == 200


def test_margin_book_short_and_cover(spark):
    r = spark.createDataFrame([("T", D(2024, 1, 1), 100.0, "short", 10.0), ("T", D(2024, 1, 2), 90.0, "cover", 10.0)], "ticker string, d date, price double, action string, qty double")
    last = simulation.margin_book(r, 10_000.0).orderBy("d").collect()[-1]
    assert last.realised == pytest.approx(100.0) and last.cash == pytest.approx(10_100.0) and last.margin == 0


def test_two_fills_average(spark, tmp_path):
    from tidemark.plans import books

    t = dt.datetime(2024, 1, 1)
    rows_ = [(1, t, 2, "X", 100.0, '{"k": 10}'), (2, t, 4, "X", 200.0, '{"k": 10}'), (3, t, 1, "X", 50.0, '{"k": 1}')]
    spark.createDataFrame(rows_, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.direction: (r.volume, r.avg_price, r.n) for r in books.oms(spark, str(tmp_path)).collect()}
    assert got == {"long": (20.0, 150.0, 2), "short": (1.0, 50.0, 1)}


def test_limit_order_fills_at_its_price(spark):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([("S", t, 1, "limit", "buy", 140.0, 1.0), ("S", t + dt.timedelta(1), 2, "bar", "buy", 135.0, 1.0)], "symbol string, ts timestamp, seq long, kind string, side string, price double, qty double")
    out = simulation.paper_match(r, 1000.0).collect()
    assert [(x.status, x.price) for x in out] == [("filled", 140.0)]


def test_t_distribution_and_tiers(spark):
    assert stats.t_p_value(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.t_p_value(0.0, 5) == pytest.approx(1.0)
    x = spark.createDataFrame([(49_999.0,), (50_000.0,), (2e6,)], "n double")
    assert [r[0] for r in x.select(costs.maintenance_rate(F.col("n"))).collect()] == [0.005, 0.010, 0.025]


def match(spark, orders, cash=1000.0):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([("S", t + dt.timedelta(i), i, *o) for i, o in enumerate(orders)], "symbol string, ts timestamp, seq long, kind string, side string, price double, qty double")
    return [(x.seq, x.status, x.price, x.filled) for x in simulation.paper_match(r, cash).collect()]


def test_paper_orders_fill_at_once_wait_or_are_rejected(spark):
    assert match(spark, [("bar", "buy", 135.0, 0.0), ("limit", "buy", 140.0, 1.0)]) == [(1, "filled", 140.0, 1.0)]
    assert match(spark, [("market", "buy", 50.0, 2.0)]) == [(0, "filled", 50.0, 2.0)]
    assert match(spark, [("limit", "buy", 90.0, 1.0), ("bar", "buy", 100.0, 0.0)]) == [(0, "waiting", 90.0, 0.0)]
    assert match(spark, [("bar", "buy", 600.0, 0.0), ("market", "buy", 1.0, 2.0), ("market", "sell", 1.0, 2.0)]) == [(1, "rejected", 600.0, 0.0), (2, "rejected", 600.0, 0.0)]


def test_waiting_orders_fill_as_a_walk_over_all_of_them_would(spark):
    import random

    rng = random.Random(5)
    orders = [(rng.choice(["bar", "limit", "limit", "market"]), rng.choice(["buy", "sell"]), float(rng.randrange(80, 120)), float(rng.randrange(1, 4))) for _ in range(400)]
    cash, held, last, queue, want = 2000.0, 0.0, None, [], []

    def fill(seq, side, price, qty):
        nonlocal cash, held
        n = (qty if price * qty <= cash else 0.0) if side == "buy" else min(qty, held)
        cash, held = (cash - price * n, held + n) if side == "buy" else (cash + price * n, held - n)
        want.append((seq, "filled" if n else "rejected", price, n))

    crossed = lambda side, price: last is not None and (last <= price if side == "buy" else last >= price)
    for seq, (kind, side, price, qty) in enumerate(orders):
        if kind == "bar":
            last = price
            now = [q for q in queue if crossed(q[1], q[2])]
            queue = [q for q in queue if q not in now]
            for q in now:
                fill(*q)
        elif kind == "limit" and not crossed(side, price):
            queue.append((seq, side, price, qty))
        else:
            fill(seq, side, price if kind == "limit" or not last else last, qty)
    want += [(q[0], "waiting", q[2], 0.0) for q in queue]
    assert match(spark, orders, 2000.0) == want


def test_folds_carry_their_state_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    t = dt.datetime(2024, 1, 1)
    rows_ = [(k, t + dt.timedelta(minutes=7 * i), float(i)) for k in ("a", "b", "c") for i in range(200)]
    d = spark.createDataFrame(rows_, "k string, ts timestamp, v double")
    want = []
    for k in ("a", "b", "c"):
        last = None
        for kk, at, v in rows_:
            if kk == k and (last is None or (at - last).total_seconds() >= 3600):
                last = at
                want.append((k, v))
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert rows(simulation.cooldown(d, "k", "ts", 3600).select("k", "v"), "k", "v") == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


PERP = "symbol string, ts timestamp, price double, rate double, side int, adds boolean"


def test_additions_average_the_entry_and_the_other_side_closes(spark):
    t = dt.datetime(2024, 1, 1)
    steps = [(100.0, 0.0, 1, False), (110.0, 0.0, 1, True), (110.0, 0.001, 1, False), (120.0, 0.0, -1, False)]
    r = spark.createDataFrame([("S", t + dt.timedelta(hours=i), *x) for i, x in enumerate(steps)], PERP)
    one, two, three, four = simulation.perp_ledger(r, 10_000.0, 5.0, simulation.margin_rate, fee=0.0).orderBy("ts").collect()
    size = 5_000 / 100 + 4_500 / 110
    assert (one.cash, two.event, two.cash) == (9_000.0, "added", 8_100.0)
    assert three.cash == pytest.approx(8_100 - size * 110 * 0.001)
    closed = three.cash + 1_900 + size * 120 - 9_500
    assert four.event == "reversed" and four.cash == pytest.approx(closed * 0.9) and four.equity == pytest.approx(closed)


def test_a_liquidated_position_pays_no_funding(spark):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([("S", t, 100.0, 0.0, 1, False), ("S", t + dt.timedelta(hours=8), 50.0, 0.01, 1, True)], PERP)
    first, second = simulation.perp_ledger(r, 10_000.0, 5.0, simulation.margin_rate, fee=0.0).orderBy("ts").collect()
    assert (first.event, second.event) == ("opened", "liquidated") and second.cash == first.cash == second.equity == 9_000.0


def test_a_fund_cannot_value_a_held_ticker_without_a_mark(spark):
    r = spark.createDataFrame([("f", D(2024, 6, 7), "A", 1.0, 10.0), ("f", D(2024, 6, 14), "B", 1.0, 10.0)], "fund string, d date, ticker string, weight double, mark double")
    with pytest.raises(ValueError, match="no mark of A"):
        simulation.strictly(simulation.fund_fold(r, 1000.0))


def test_orders_sell_first_and_close_what_is_no_longer_wanted(spark):
    d = D(2024, 6, 7)
    want = spark.createDataFrame([(d, "B", 5), (d, "A", 7)], "d date, ticker string, shares long")
    held = spark.createDataFrame([(d, "B", 9), (d, "Z", 3)], "d date, ticker string, shares long")
    assert rows(portfolio.orders(want, held).select("ordinal", "ticker", "qty"), "ordinal") == [(1, "B", -4), (2, "Z", -3), (3, "A", 7)]


def test_asof_join_over_spans_equals_a_search(spark):
    import random

    rng = random.Random(3)
    q = [(rng.choice("ab"), rng.randrange(0, 2000), float(i)) for i in range(60)]
    p = [(rng.choice("abc"), rng.randrange(0, 2000), i) for i in range(200)]
    quotes, probes = spark.createDataFrame(q, "k string, t long, v double"), spark.createDataFrame(p, "k string, t long, id long")
    for back in (True, False):
        for strict in (True, False):
            got = {r.id: r.quote_t for r in joins.asof_join(probes, quotes, "k", "t", ["v"], "backward" if back else "forward", strict, span=50).collect()}
            for k, t, i in p:
                fit = [x for kk, x, _ in q if kk == k and ((x < t or x == t and not strict) if back else (x > t or x == t and not strict))]
                assert got[i] == ((max if back else min)(fit) if fit else None)


def test_bootstrap_does_not_depend_on_partitions(spark):
    import numpy as np

    values = [float(i) for i in range(200)]
    d = spark.createDataFrame([("a", v, f"id{i}") for i, v in enumerate(values)] + [("b", None, "x"), ("b", 1.0, "y")], "g string, v double, id string")
    one, two = ({r.g: r for r in stats.bootstrap_ci(d.repartition(n), ["g"], "v", "id", 2000).collect()} for n in (1, 5))
    assert one["a"].n == 200 and one["b"].n == 1 and one["b"].ci_low == one["b"].ci_high == 1.0
    assert one["a"].ci_low == pytest.approx(two["a"].ci_low) and one["a"].ci_high == pytest.approx(two["a"].ci_high)
    means = np.random.default_rng(1).choice(values, (2000, 200)).mean(axis=1)
    low, high = np.quantile(means, [0.025, 0.975])
    assert abs(one["a"].ci_low - low) < 2 and abs(one["a"].ci_high - high) < 2


def test_rank_sums_over_bins_equal_plain_ranks(spark):
    rows_ = [("s", i % 2, float((i * 37) % 23)) for i in range(100)]
    got = stats.mann_whitney(spark.createDataFrame(rows_, "s string, g int, v double"), ["s"], "g", "v").first()
    ones, zeros = [v for _, g, v in rows_ if g], [v for _, g, v in rows_ if not g]
    assert got.u == sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) and 0 < got.p < 1


def test_nested_books_are_levels_in_order(spark):
    from tidemark.plans import market

    level = "array<struct<price: double, size: double>>"
    b = spark.createDataFrame([("X", 1, [(10.0, 1.0), (9.0, 2.0)], [(11.0, 3.0)]), ("Y", 1, [], None)], f"symbol string, h int, bids {level}, asks {level}")
    got = rows(market.nested_levels(b), "symbol", "book_side", "level")
    assert got == [("X", 1, "ask", 0, 11.0, 3.0), ("X", 1, "bid", 0, 10.0, 1.0), ("X", 1, "bid", 1, 9.0, 2.0)]


def test_optional_bounds(spark):
    from tidemark.plans import stores

    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "v int, k string")
    assert rows(stores.optional(d, k="a", v_from=2, v_to=None), "v") == [(3, "a")]
    assert stores.optional(d, k=None).count() == 3


def test_zipped_candles_skip_headers_and_odd_times(spark, tmp_path):
    import zipfile

    from tidemark.sources import files

    line = "{},1,2,0.5,1.5,10,0,0,3,4,0,0"
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("m.csv", "\n".join(["open_time,open,high", line.format(1_704_067_200_000), line.format(1_704_067_260_000_000), line.format(5), "junk"]))
    got = files.klines_zip(spark, str(tmp_path)).orderBy("ts").collect()
    assert [r.ts for r in got] == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 1)] and got[0].taker_ratio == 0.4


def test_chain_metrics_of_two_providers(spark, tmp_path):
    from tidemark.sources import files

    (tmp_path / "chart").mkdir()
    (tmp_path / "node").mkdir()
    (tmp_path / "chart" / "a.json").write_text('{"asset": "X", "prices": [[1704067200000, 5.0], [1704153600000, null], [1]], "market_caps": [[1704067200000, 9.0]]}\n')
    (tmp_path / "node" / "b.json").write_text('{"asset": "X", "metric": "price", "t": 1704067200, "v": 7.0}\n{"asset": "X", "metric": "price", "t": 1704153600, "v": 8.0}\n{"asset": "X", "metric": "mvrv", "t": null, "v": 1.0}\n')
    paths = {k: str(tmp_path / k) for k in ("chart", "node")}
    got = sorted(map(tuple, files.chain_metrics(spark, paths).collect()))
    assert got == [("X", "mcap", 1_704_067_200_000, 9.0), ("X", "price", 1_704_067_200_000, 5.0), ("X", "price", 1_704_153_600_000, 8.0)]
    other = files.chain_metrics(spark, dict(reversed(paths.items()))).where("ts_ms = 1704067200000 and metric = 'price'")
    assert [r.value for r in other.collect()] == [7.0]


def test_json_arrays_keep_what_was_collected_last(spark, tmp_path):
    from tidemark.sources import files

    (tmp_path / "a.json").write_text('[{"date": "2024-01-01", "symbol": "X", "close": 1, "collected_at": "2024-01-01"}, {"date": "2024-01-01", "symbol": "X", "close": 2, "collected_at": "2024-01-02"}, {"date": null}]')
    assert [(r.symbol, r.d, r.close, r.open) for r in files.ohlcv_json(spark, str(tmp_path)).collect()] == [("X", D(2024, 1, 1), 2.0, None)]
