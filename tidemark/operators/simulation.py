"""Sequential books as grouped folds.

What a day trades depends on the cash that the days before left, so a book is a fold
over its own rows. Books are independent: one Arrow group is one book (a fund, a
ticker, a parameter set), whose size is its number of days, and a cluster runs as many
as it has cores. Folds over ticks (:func:`in_order`) hold their state and one batch of
sorted rows only. Everything before the fold (signals, weights, marks) is set-based.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def fund_fold(rows: DataFrame, capital: float) -> DataFrame:
    """Rebalance each fund on its dates: (fund, d, cash, equity, n_orders, long, short, error).

    ``rows`` has (fund, d, ticker, weight, mark): target weights and marks of the tickers
    that can be valued on a date. A fund that cannot be valued, because a held ticker has no
    mark or nothing is left of its equity, ends with a row whose ``error`` says so and whose
    equity is null; the other funds go on (:func:`strictly` raises instead). Shares are cut
    toward zero; fills are at the mark; cash may go below 0. ``long`` and ``short`` are
    exposures after the trades.
    """
    columns = ["fund", "d", "cash", "equity", "n_orders", "long", "short", "error"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, held, out = capital, {}, []
        fund = pdf.fund.iloc[0]
        for d, day in pdf.sort_values(["d", "ticker"]).groupby("d", sort=True):
            mark = dict(zip(day.ticker, day.mark, strict=True))
            lost = sorted(t for t, q in held.items() if q and t not in mark)
            equity = cash + sum(q * mark[t] for t, q in held.items() if q) if not lost else None
            if lost or equity <= 0:
                error = f"no mark of {', '.join(lost)}" if lost else "no equity left"
                out.append((fund, d, cash, None, 0, None, None, error))
                break
            n = 0
            for t, w in zip(day.ticker, day.weight, strict=True):
                want = int(w * equity / mark[t])
                delta = want - held.get(t, 0)
                if delta:
                    cash -= delta * mark[t]
                    held[t] = want
                    n += 1
            values = [q * mark[t] for t, q in held.items() if q]
            out.append((fund, d, cash, equity, n, sum(v for v in values if v > 0), -sum(v for v in values if v < 0), None))
        return pd.DataFrame(out, columns=columns)

    return rows.groupBy("fund").applyInPandas(run, "fund string, d date, cash double, equity double, n_orders long, long double, short double, error string")


def strictly(cycles: DataFrame) -> DataFrame:
    """The cycles without their error column; raises in the driver if a fund could not be valued."""
    first = cycles.where("error is not null").orderBy("d", "fund").first()
    if first:
        raise ValueError(f"{first.fund}: {first.error} on {first.d}")
    return cycles.drop("error")


def edge_trades(rows: DataFrame, hold: int, per_trade: float) -> DataFrame:
    """Trades of each ticker: a signal that turns on opens one for ``hold`` bars; none overlap.

    ``rows`` has (ticker, d, close, signal in -1, 0, 1). Shares are whole.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d").reset_index(drop=True)
        out, i, n, armed = [], 0, len(pdf), True
        sig, close = pdf.signal.to_numpy(), pdf.close.to_numpy()
        while i < n:
            if sig[i] == 0:
                armed = True
            elif armed and i + hold < n:
                shares = int(per_trade / close[i])
                if shares:
                    j = i + hold
                    out.append((pdf.ticker.iloc[0], pdf.d[i], pdf.d[j], int(sig[i]), shares, round((close[j] - close[i]) * shares * sig[i], 4)))
                    i, armed = j, False
                    continue
            i += 1
        return pd.DataFrame(out, columns=["ticker", "entry", "exit", "side", "shares", "pnl"])

    return rows.groupBy("ticker").applyInPandas(run, "ticker string, entry date, exit date, side int, shares long, pnl double")


class Book:
    """One ticker's long and short position with cash and margin."""

    def __init__(self, cash: float, margin_ratio: float) -> None:
        self.cash, self.ratio = cash, margin_ratio
        self.long = self.short = self.long_cost = self.short_cost = self.margin = self.gain = 0.0

    def buy(self, q: float, price: float) -> float:
        q = min(q, self.cash / price) if q > 0 and self.cash > 0 else 0.0
        if q > 0:
            self.long_cost = (self.long_cost * self.long + q * price) / (self.long + q)
            self.long += q
            self.cash -= q * price
        return q

    def sell(self, q: float, price: float) -> float:
        q = min(q, self.long) if q > 0 else 0.0
        if q > 0:
            self.gain += (price - self.long_cost) * q
            self.long -= q
            self.cash += q * price
            self.long_cost = self.long_cost if self.long else 0.0
        return q

    def open_short(self, q: float, price: float) -> float:
        """Free cash (less margin in use) decides whether all of it fits; otherwise all cash sizes it."""
        if q > 0 and q * price * self.ratio > max(0.0, self.cash - self.margin):
            q = max(0.0, self.cash / (price * self.ratio)) if self.ratio > 0 else 0.0
        if q > 0:
            need = q * price * self.ratio
            self.short_cost = (self.short_cost * self.short + q * price) / (self.short + q)
            self.short += q
            self.margin += need
            self.cash += q * price - need
        return max(q, 0.0)

    def cover(self, q: float, price: float) -> float:
        q = min(q, self.short) if q > 0 else 0.0
        if q > 0:
            freed = self.margin * q / self.short
            self.gain += (self.short_cost - price) * q
            self.short -= q
            self.margin -= freed
            self.cash += freed - q * price
            if not self.short:
                self.short_cost = self.margin = 0.0
        return q

    def value(self, price: float) -> float:
        """Cash, margin and open positions; inferred, as the source of this rule is not public."""
        return self.cash + self.margin + self.long * price - self.short * price


class DailyBook:
    """A margin book fed day by day."""

    columns = ["ticker", "d", "filled", "cash", "margin", "long", "short", "realised", "equity"]

    def __init__(self, capital: float, margin_ratio: float) -> None:
        self.book = Book(capital, margin_ratio)
        self.act = {"buy": self.book.buy, "sell": self.book.sell, "short": self.book.open_short, "cover": self.book.cover}

    def step(self, _: str, part: pd.DataFrame) -> pd.DataFrame:
        b, out = self.book, []
        for r in part.itertuples(index=False):
            filled = self.act[r.action](r.qty, r.price) if r.action in self.act else 0.0
            out.append((r.ticker, r.d, filled, b.cash, b.margin, b.long, b.short, b.gain, b.value(r.price)))
        return pd.DataFrame(out, columns=self.columns)

    def end(self, _: str) -> pd.DataFrame:
        return pd.DataFrame([], columns=self.columns)


def margin_book(rows: DataFrame, capital: float, margin_ratio: float = 0.5) -> DataFrame:
    """Daily books of (ticker, d, price, action, qty) with actions buy, sell, short, cover, hold."""
    schema = "ticker string, d date, filled double, cash double, margin double, long double, short double, realised double, equity double"
    return in_order(rows, "ticker", ["d"], schema, lambda: DailyBook(capital, margin_ratio))


#: Of the free cash, the part that goes into the margin of a position, and again into each addition to it.
MARGIN_PART = 0.1


class Ledger:
    """Cash and the isolated-margin position of one symbol: (side, size, entry, margin, liquidation price)."""

    columns = ["symbol", "ts", "event", "cash", "equity"]

    def __init__(self, capital: float, leverage: float, rate_of, fee: float) -> None:
        self.cash, self.leverage, self.rate_of, self.fee, self.pos = capital, leverage, rate_of, fee, None

    def opened(self, side: int, size: float, entry: float, margin: float) -> tuple:
        return side, size, entry, margin, entry * (1 - side * (1 / self.leverage - self.rate_of(size * entry)))

    def held(self, r) -> str:
        """What a mark does to the open position."""
        side, size, entry, margin, liq = self.pos
        if (r.price <= liq) if side > 0 else (r.price >= liq):
            self.pos = None
            return "liquidated"
        self.cash -= side * size * r.price * r.rate
        if r.side != side:
            self.cash += margin + side * size * (r.price - entry) - size * r.price * self.fee
            self.pos = None
            return "closed"
        if not r.adds:
            return "hold"
        put = max(self.cash, 0.0) * MARGIN_PART
        more = put * self.leverage / r.price
        if not put or put + more * r.price * self.fee > self.cash:
            return "rejected"
        self.cash -= put + more * r.price * self.fee
        self.pos = self.opened(side, size + more, (entry * size + r.price * more) / (size + more), margin + put)
        return "added"

    def step(self, _: str, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in part.itertuples(index=False):
            event = self.held(r) if self.pos else "hold"
            if self.pos is None and r.side != 0 and event != "liquidated" and self.cash > 0:
                put = self.cash * MARGIN_PART
                self.cash -= put + put * self.leverage * self.fee
                self.pos = self.opened(r.side, put * self.leverage / r.price, r.price, put)
                event = "opened" if event == "hold" else "reversed"
            value = self.pos[3] + self.pos[0] * self.pos[1] * (r.price - self.pos[2]) if self.pos else 0.0
            out.append((r.symbol, r.ts, event, self.cash, self.cash + value))
        return pd.DataFrame(out, columns=self.columns)

    def end(self, _: str) -> pd.DataFrame:
        return pd.DataFrame([], columns=self.columns)


def perp_ledger(rows: DataFrame, capital: float, leverage: float, rate_of, fee: float = 0.0005) -> DataFrame:
    """Isolated-margin perpetual positions: (symbol, ts, price, rate, side, adds) in time order.

    A mark beyond the liquidation price loses the margin, before any funding is due; then
    funding is paid on the notional, by longs at positive rates; then a side other than
    the open one closes and opens, and ``adds`` adds to an open position of the same side at
    the mean entry, or is rejected where the cash does not suffice for margin and fee.
    """
    schema = "symbol string, ts timestamp, event string, cash double, equity double"
    return in_order(rows, "symbol", ["ts"], schema, lambda: Ledger(capital, leverage, rate_of, fee))


def margin_rate(notional: float) -> float:
    """Maintenance rate of a notional."""
    from tidemark.operators.costs import LAST_TIER, MARGIN_TIERS

    return next((r for below, r in MARGIN_TIERS if notional < below), LAST_TIER)


#: Parameter sets of one grid search.
MOST_SETS = 10_000


def crossing_book(close: np.ndarray, fast: np.ndarray, slow: np.ndarray, capital: float) -> tuple[np.ndarray, int]:
    """Equity after every bar, and trades, of a book that holds whole shares while fast is above slow.

    Only the bars on which the means cross are walked through; between them cash and shares
    stay as they are.
    """
    up = (fast[:-1] <= slow[:-1]) & (fast[1:] > slow[1:])
    down = (fast[:-1] >= slow[:-1]) & (fast[1:] < slow[1:])
    cash, shares = np.full(len(close), capital), np.zeros(len(close))
    now, held, n = capital, 0, 0
    for i in (np.flatnonzero(up | down) + 1).tolist():
        if up[i - 1] and not held:
            held = int(now / close[i])
            now -= held * close[i]
        elif down[i - 1] and held:
            now += held * close[i]
            held = 0
        else:
            continue
        n += 1
        cash[i:], shares[i:] = now, held
    return cash + shares * close, n


def grid_search(bars: DataFrame, params: DataFrame, capital: float) -> DataFrame:
    """Every (symbol, fast, slow): a dual-EMA long-only book in whole shares.

    A symbol's bars go to one task once, and all sets of parameters run on them there. A set
    that fails keeps its row with the error.
    """
    sets = [(r.fast, r.slow) for r in params.select("fast", "slow").limit(MOST_SETS + 1).collect()]
    if len(sets) > MOST_SETS:
        raise ValueError(f"a grid has at most {MOST_SETS} sets of parameters")
    cols = ["symbol", "fast", "slow", "total_return", "sharpe", "n_trades", "error"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        symbol, close, out = pdf.symbol.iloc[0], pdf.close.to_numpy(), []
        means = {n: pdf.close.ewm(span=n, adjust=False).mean().to_numpy() for n in {n for pair in sets for n in pair}}
        for fast, slow in sets:
            if fast >= slow:
                out.append((symbol, fast, slow, None, None, None, "fast must be below slow"))
                continue
            e, n = crossing_book(close, means[fast], means[slow], capital)
            r = e[1:] / e[:-1] - 1
            sharpe = float(r.mean() / r.std(ddof=1) * np.sqrt(252)) if len(r) > 1 and r.std(ddof=1) > 0 else None
            out.append((symbol, fast, slow, float(e[-1] / capital - 1), sharpe, n, None))
        return pd.DataFrame(out, columns=cols)

    return bars.groupBy("symbol").applyInPandas(run, "symbol string, fast int, slow int, total_return double, sharpe double, n_trades long, error string")


def in_order(rows: DataFrame, by: str, order: list[str], schema, make) -> DataFrame:
    """Fold the rows of each key in order, with only the state and one Arrow batch in memory.

    ``make`` gives a fold: ``step(key, frame)`` returns the rows for a stretch of one key,
    and ``end(key)`` those that are left when the key is over.
    """

    def run(frames):
        fold, key = None, None
        for pdf in frames:
            edges = np.flatnonzero(pdf[by].to_numpy()[1:] != pdf[by].to_numpy()[:-1]) + 1
            for first, last in zip([0, *edges], [*edges, len(pdf)], strict=True):
                part = pdf.iloc[first:last]
                if len(part) and (fold is None or part[by].iloc[0] != key):
                    if fold is not None:
                        yield fold.end(key)
                    fold, key = make(), part[by].iloc[0]
                if len(part):
                    yield fold.step(key, part)
        if fold is not None:
            yield fold.end(key)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


class Cooldown:
    """Lets an alert through if the last one that was let through is far enough back."""

    def __init__(self, ts: str, seconds: float) -> None:
        self.ts, self.wait, self.last = ts, np.timedelta64(int(seconds * 1e6), "us"), None

    def step(self, _: str, part: pd.DataFrame) -> pd.DataFrame:
        keep = np.zeros(len(part), bool)
        for i, t in enumerate(part[self.ts].to_numpy()):
            if self.last is None or t - self.last >= self.wait:
                self.last, keep[i] = t, True
        self.none = part.iloc[:0]
        return part[keep]

    def end(self, _: str) -> pd.DataFrame:
        return self.none


def cooldown(rows: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """Of each key's alerts those at least ``seconds`` after the last one that was let through."""
    rest = [c for c in rows.columns if c not in (by, ts)]
    return in_order(rows, by, [ts, *rest], rows.schema, lambda: Cooldown(ts, seconds))


class Matching:
    """Paper account of one symbol: cash, shares, the last price and the limits that wait.

    Waiting buys are a heap from the highest limit, sells from the lowest, so that a bar
    looks only at the orders that it fills; these fill in the order of their arrival.
    """

    columns = ["symbol", "seq", "ts", "status", "price", "filled", "cash", "held"]

    def __init__(self, cash: float) -> None:
        self.cash, self.held, self.last, self.arrived = cash, 0.0, None, 0
        self.waiting: dict[bool, list[tuple]] = {True: [], False: []}

    def row(self, o, ts, price: float, status: str | None = None) -> tuple:
        """Fill the order at the price (or give it the status without a fill)."""
        n = 0.0
        if status is None:
            if o.side == "buy":
                n = o.qty if price * o.qty <= self.cash else 0.0
                self.cash, self.held = self.cash - price * n, self.held + n
            else:
                n = min(o.qty, self.held)
                self.cash, self.held = self.cash + price * n, self.held - n
            status = "filled" if n else "rejected"
        return o.symbol, o.seq, ts, status, price, n, self.cash, self.held

    def crossed(self, o) -> bool:
        return self.last is not None and (self.last <= o.price if o.side == "buy" else self.last >= o.price)

    def step(self, _: str, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for o in part.itertuples(index=False):
            if o.kind == "bar":
                self.last = o.price
                now = []
                for heap in self.waiting.values():
                    while heap and self.crossed(heap[0][2]):
                        now.append(heapq.heappop(heap)[1:])
                out += [self.row(q, o.ts, q.price) for _, q in sorted(now, key=lambda x: x[0])]
            elif o.kind == "limit" and not self.crossed(o):
                buys = o.side == "buy"
                heapq.heappush(self.waiting[buys], (-o.price if buys else o.price, self.arrived, o))
                self.arrived += 1
            else:  # at once: a limit that the last price satisfies, or a market order
                price = o.price if o.kind == "limit" or not self.last or self.last <= 0 else self.last
                out.append(self.row(o, o.ts, price))
        return pd.DataFrame(out, columns=self.columns)

    def end(self, _: str) -> pd.DataFrame:
        left = sorted((x[1:] for heap in self.waiting.values() for x in heap), key=lambda x: x[0])
        return pd.DataFrame([self.row(q, q.ts, q.price, "waiting") for _, q in left], columns=self.columns)


def paper_match(orders: DataFrame, cash: float) -> DataFrame:
    """Paper matching of (symbol, ts, seq, kind in market, limit, bar; side, price, qty), an account for each symbol.

    Market orders fill at the last bar's price, before any bar at the price they name. Limits
    fill at their own price: at once if the last price satisfies them, else when a bar
    crosses them; those that never do stay as ``waiting``. A buy without the cash is
    rejected; a sell is cut to what is held.
    """
    schema = "symbol string, seq long, ts timestamp, status string, price double, filled double, cash double, held double"
    return in_order(orders, "symbol", ["ts", "seq"], schema, lambda: Matching(cash))
