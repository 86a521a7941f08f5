"""Plans of target books, backtests, costs, metrics, grids and order state."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import costs, joins, metrics, portfolio, simulation
from tidemark.sources import adapters as A
from tidemark.sources.adapters import with_views
from tidemark.sources.tables import table

QUERIES, SQL = {}, {}
CAPITAL = 1_000_000.0


def plan(name: str, sql: str | None, views: str = ""):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_views(views, sql) if views else sql
        return fn

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


BLEND = """c AS (SELECT strategy, d, ticker, coalesce(sum(weight * value) FILTER (NOT abstained) / sum(weight) FILTER (NOT abstained), 0) AS conviction FROM views GROUP BY 1, 2, 3),
    n AS (SELECT *, conviction - avg(conviction) OVER (PARTITION BY strategy, d) AS x FROM c),
    b AS (SELECT strategy, d, ticker, conviction, CASE WHEN sum(abs(conviction)) OVER (PARTITION BY strategy, d) < 1e-9 THEN 0 ELSE conviction / sum(abs(conviction)) OVER (PARTITION BY strategy, d) END AS weight,
      CASE WHEN sum(abs(x)) OVER (PARTITION BY strategy, d) < 1e-9 THEN 0 ELSE x / sum(abs(x)) OVER (PARTITION BY strategy, d) END AS nweight FROM n),
    net AS (SELECT d, ticker, sum(weight * CASE strategy WHEN 's1' THEN 0.75 ELSE 0.25 END) AS weight FROM b GROUP BY 1, 2),
    cap AS (SELECT *, sign(weight) * least(abs(weight), 0.2) AS capped FROM net),
    lim AS (SELECT *, CASE WHEN sum(abs(capped)) OVER (PARTITION BY d) > 0.8 THEN 0.8 / sum(abs(capped)) OVER (PARTITION BY d) ELSE 1 END AS scale FROM cap)"""


@plan("blend", f"WITH {BLEND} SELECT strategy, d, ticker, round(conviction, 6) AS conviction, round(weight, 6) AS weight FROM b", "views")
def blend(spark, sf):
    b = portfolio.blend(A.model_views(spark, sf))
    return b.select("strategy", "d", "ticker", r6(F.col("conviction"), "conviction"), r6(F.col("weight"), "weight"))


@plan("blend_neutral", f"WITH {BLEND} SELECT strategy, d, ticker, round(nweight, 6) AS weight FROM b", "views")
def blend_neutral(spark, sf):
    return portfolio.blend(A.model_views(spark, sf), neutral=True).select("strategy", "d", "ticker", r6(F.col("weight"), "weight"))


def netted(spark, sf):
    return portfolio.net(portfolio.blend(A.model_views(spark, sf)), A.SLICES)


@plan("net_sleeves", f"WITH {BLEND} SELECT d, ticker, round(weight, 6) AS weight FROM net", "views")
def net_sleeves(spark, sf):
    return netted(spark, sf).select("d", "ticker", r6(F.col("weight"), "weight"))


def limited(spark, sf):
    return portfolio.limit(netted(spark, sf), 0.2, 0.8)


@plan("risk_limits", f"WITH {BLEND} SELECT d, ticker, round(capped * scale, 6) AS weight FROM lim", "views")
def risk_limits(spark, sf):
    return limited(spark, sf).select("d", "ticker", r6(F.col("final"), "weight"))


@plan("clamp_audit", f"""WITH {BLEND} SELECT d, ticker, 'position' AS rule, round(weight, 6) AS before, round(capped, 6) AS after FROM lim WHERE abs(weight - capped) > 1e-9
    UNION ALL SELECT d, 'BOOK', 'gross', round(sum(abs(capped)), 6), round(sum(abs(capped * scale)), 6) FROM lim GROUP BY d HAVING min(scale) < 1 - 1e-9""", "views")
def clamp_audit(spark, sf):
    x = limited(spark, sf)
    each = x.where(F.abs(F.col("weight") - F.col("capped")) > 1e-9).select("d", "ticker", F.lit("position").alias("rule"), r6(F.col("weight"), "before"), r6(F.col("capped"), "after"))
    book = x.groupBy("d").agg(F.sum(F.abs("capped")).alias("b"), F.sum(F.abs("final")).alias("a"), F.min("scale").alias("s")).where(F.col("s") < 1 - 1e-9)
    return each.union(book.select("d", F.lit("BOOK"), F.lit("gross"), r6(F.col("b"), "before"), r6(F.col("a"), "after")))


#: The part of its equity that the example fund puts at risk: its prices rise and fall tenfold within weeks.
INVESTED = 0.02
GRID = f"""grid AS (SELECT max(d) AS g FROM bench GROUP BY date_trunc('month', d)),
    book AS (SELECT g AS d, ticker, weight, mark FROM (SELECT g, l.ticker, round(capped * scale * {INVESTED}, 9) AS weight, CASE WHEN g - b.d <= 7 THEN round(b.close, 2) END AS mark
      FROM (SELECT g, ticker, capped, scale FROM lim JOIN grid ON lim.d = date_trunc('month', g)::DATE) l ASOF LEFT JOIN bars b ON b.symbol = l.ticker AND l.g >= b.d) WHERE mark IS NOT NULL)"""
MARK_DAYS = 7


def rebalance_days(spark, sf, unit: str):
    """The last trading day of each period."""
    return A.bench_1d(spark, sf).groupBy(F.date_trunc(unit, "d").alias("period")).agg(F.max("d").alias("g"))


def book_rows(spark, sf):
    """Target weight and mark of each ticker on the last trading day of each month.

    The mark is the last close on or before that day, at most ``MARK_DAYS`` days old, to the
    cent; tickers without one are left out.
    """
    grid = rebalance_days(spark, sf, "month").select(F.to_date("period").alias("d"), "g")
    t = limited(spark, sf).join(grid, "d").select("ticker", F.col("g").alias("d"), F.round(F.col("final") * INVESTED, 9).alias("final"))
    m = joins.asof_join(t.withColumnRenamed("ticker", "symbol"), A.bars_1d(spark, sf), "symbol", "d", ["close"])
    return m.where(F.date_diff("d", "quote_d") <= MARK_DAYS).select("d", F.col("symbol").alias("ticker"), "final", F.round("close", 2).alias("mark"))


@plan("target_shares", f"""WITH {BLEND}, {GRID}, want AS (SELECT d, ticker, trunc(weight * 1000000 / mark)::BIGINT AS want FROM book), nx AS (SELECT g, lead(g) OVER (ORDER BY g) AS after FROM grid),
    held AS (SELECT after AS d, ticker, want AS shares FROM want JOIN nx ON d = g WHERE after IS NOT NULL), o AS (SELECT d, ticker, coalesce(want, 0) - coalesce(shares, 0) AS qty FROM want FULL JOIN held USING (d, ticker))
    SELECT d, ticker, qty, CASE WHEN qty > 0 THEN 'buy' ELSE 'sell' END AS side, row_number() OVER (PARTITION BY d ORDER BY qty > 0, ticker) AS ordinal FROM o WHERE qty <> 0""", "views bench")
def target_shares(spark, sf):
    """Orders from the shares of one rebalance date to those of the next, for a book of constant equity."""
    want = portfolio.target_shares(book_rows(spark, sf), CAPITAL)
    g = rebalance_days(spark, sf, "month")
    after = g.select(F.col("g").alias("d"), F.lead("g").over(W.orderBy("g")).alias("after")).where("after is not null")
    held = want.join(after, "d").select(F.col("after").alias("d"), "ticker", "shares")
    return portfolio.orders(want, held).select("d", "ticker", "qty", "side", "ordinal")


@plan("rebalance_grid", "SELECT max(d) AS d, 'weekly' AS cadence FROM bench GROUP BY date_trunc('week', d) UNION ALL SELECT max(d), 'monthly' FROM bench GROUP BY date_trunc('month', d)", "bench")
def rebalance_grid(spark, sf):
    parts = [rebalance_days(spark, sf, u).select(F.col("g").alias("d"), F.lit(c).alias("cadence")) for u, c in (("week", "weekly"), ("month", "monthly"))]
    return parts[0].union(parts[1])


def backtest(spark, sf):
    """Equity of the example fund at every rebalance date."""
    rows = book_rows(spark, sf).select(F.lit("fund").alias("fund"), "d", "ticker", F.col("final").alias("weight"), "mark")
    return simulation.fund_fold(rows, CAPITAL)


def valued(spark, sf):
    """The cycles of the example fund that could be valued."""
    return backtest(spark, sf).where("error is null")


FUND = f"""WITH RECURSIVE {BLEND}, {GRID}, pos AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS k FROM (SELECT DISTINCT ticker FROM book)),
    days AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM book)),
    arr AS MATERIALIZED (SELECT i, days.d, list(pos.ticker ORDER BY k) AS names, list(coalesce(weight, 0) ORDER BY k) AS w, list(coalesce(mark, 0) ORDER BY k) AS m FROM days CROSS JOIN pos LEFT JOIN book ON book.d = days.d AND book.ticker = pos.ticker GROUP BY 1, 2),
    f AS (SELECT 0::BIGINT AS i, NULL::DATE AS d, {CAPITAL!r}::DOUBLE AS cash, {CAPITAL!r}::DOUBLE AS equity, [0.0::DOUBLE for x in range((SELECT count(*) FROM pos))] AS held, 0::BIGINT AS n, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, NULL::VARCHAR AS error
      UNION ALL SELECT i, d, CASE WHEN error IS NULL THEN cash - list_sum([(want[j] - held[j]) * m[j] for j in range(1, len(m) + 1)]) ELSE cash END, CASE WHEN error IS NULL THEN equity END, want, CASE WHEN error IS NULL THEN list_sum([CASE WHEN want[j] <> held[j] THEN 1 ELSE 0 END for j in range(1, len(m) + 1)]) ELSE 0 END::BIGINT,
        CASE WHEN error IS NULL THEN list_sum([greatest(want[j] * m[j], 0) for j in range(1, len(m) + 1)]) END, CASE WHEN error IS NULL THEN -list_sum([least(want[j] * m[j], 0) for j in range(1, len(m) + 1)]) END, error
      FROM (SELECT *, [CASE WHEN error IS NULL AND m[j] > 0 THEN trunc(w[j] * equity / m[j]) ELSE held[j] END for j in range(1, len(m) + 1)] AS want
        FROM (SELECT *, CASE WHEN len(lost) > 0 THEN 'no mark of ' || array_to_string(lost, ', ') WHEN equity <= 0 THEN 'no equity left' END AS error
        FROM (SELECT a.i, a.d, a.w, a.m, f.cash, f.held, [a.names[j] for j in range(1, len(a.m) + 1) if f.held[j] <> 0 AND a.m[j] = 0] AS lost, f.cash + list_sum([f.held[j] * a.m[j] for j in range(1, len(a.m) + 1)]) AS equity FROM f JOIN arr a ON a.i = f.i + 1 WHERE f.error IS NULL))))"""


@plan("fund_backtest", f"{FUND} SELECT 'fund' AS fund, d, round(cash, 2) AS cash, round(equity, 2) AS equity, n AS n_orders, error FROM f WHERE i > 0", "views bench")
def fund_backtest(spark, sf):
    """The fund's cycles; one that cannot be valued is the last and says why."""
    return backtest(spark, sf).select("fund", "d", F.round("cash", 2).alias("cash"), F.round("equity", 2).alias("equity"), "n_orders", "error")


@plan("fund_exposure", f"{FUND} SELECT 'fund' AS fund, d, round(up, 2) AS long, round(down, 2) AS short, round(up + down, 2) AS gross, round(up - down, 2) AS net, round((up + down) / equity, 6) AS gross_share FROM f WHERE i > 0 AND error IS NULL", "views bench")
def fund_exposure(spark, sf):
    """Long, short, gross and net exposure after each rebalance."""
    u, v = F.col("long"), F.col("short")
    return valued(spark, sf).select("fund", "d", F.round(u, 2).alias("long"), F.round(v, 2).alias("short"), F.round(u + v, 2).alias("gross"), F.round(u - v, 2).alias("net"), r6((u + v) / F.col("equity"), "gross_share"))


FUND_CURVE = f"{FUND}, v AS (SELECT *, equity / lag(equity) OVER (ORDER BY i) - 1 AS r, equity / max(equity) OVER (ORDER BY i) - 1 AS dd FROM f WHERE error IS NULL)"


def fund_curve(spark, sf):
    """The fund's curve with its starting capital as cycle 0, returns and drawdowns."""
    c = valued(spark, sf).select("fund", "d", "equity", "n_orders", F.row_number().over(W.partitionBy("fund").orderBy("d")).alias("i"))
    start = c.where("i = 1").select("fund", F.lit(None).cast("date"), F.lit(CAPITAL), F.lit(0).cast("long"), F.lit(0))
    return metrics.curve(c.union(start), "fund", "i", "equity")


@plan("fund_running", f"""{FUND_CURVE} SELECT 'fund' AS fund, d, round(equity / {CAPITAL!r} - 1, 6) AS total_return, round(-min(dd) OVER w, 6) AS max_drawdown,
    round(CASE WHEN count(r) OVER w > 1 AND stddev_samp(r) OVER w > 1e-12 THEN avg(r) OVER w / stddev_samp(r) OVER w * sqrt(12) ELSE 0 END, 6) AS sharpe, (sum(n) OVER w)::BIGINT AS n_orders FROM v WINDOW w AS (ORDER BY i) QUALIFY i > 0""", "views bench")
def fund_running(spark, sf):
    """The fund's metrics as they stood after every cycle."""
    w = W.partitionBy("fund").orderBy("i")
    sd = F.stddev_samp("ret").over(w)
    x = fund_curve(spark, sf).select("fund", "i", "d", r6(F.col("equity") / CAPITAL - 1, "total_return"), r6(-F.min("dd").over(w), "max_drawdown"), F.round(F.when((F.count("ret").over(w) > 1) & (sd > 1e-12), F.avg("ret").over(w) / sd * F.sqrt(F.lit(12.0))).otherwise(0.0), 6).alias("sharpe"), F.sum("n_orders").over(w).alias("n_orders"))
    return x.where("i > 0").drop("i")


@plan("fund_metrics", f"""{FUND_CURVE}, g AS (SELECT arg_max(equity, i) / {CAPITAL!r} - 1 AS total, greatest(date_diff('day', min(d), max(d)) / 365.25, 0.01) AS years, CASE WHEN count(r) > 1 AND stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(12) ELSE 0 END AS sharpe, -min(dd) AS dd, max(i) AS n, sum(n) AS orders, min(d) AS a, max(d) AS b FROM v),
    m AS (SELECT (SELECT close FROM bench JOIN g ON bench.d = g.b) / (SELECT close FROM bench JOIN g ON bench.d = g.a) - 1 AS bench)
    SELECT 'fund' AS fund, round(total, 6) AS total_return, round(pow(1 + total, 1 / years) - 1, 6) AS annualised, round(sharpe, 6) AS sharpe, round(dd, 6) AS max_drawdown, round(bench, 6) AS benchmark_return, round(total - bench, 6) AS excess_return, n AS n_cycles, orders::BIGINT AS n_orders FROM g CROSS JOIN m""", "views bench")
def fund_metrics(spark, sf):
    """Total, annualised and excess return, Sharpe over the curve from the starting capital on, and the largest drawdown."""
    c = fund_curve(spark, sf)
    sd = F.stddev_samp("ret")
    sharpe = F.when((F.count("ret") > 1) & (sd > 1e-12), F.avg("ret") / sd * F.sqrt(F.lit(12.0))).otherwise(0.0)
    years = F.greatest(F.date_diff(F.max("d"), F.min("d")) / 365.25, F.lit(0.01))
    g = c.groupBy("fund").agg((F.max_by("equity", "i") / CAPITAL - 1).alias("total"), years.alias("years"), sharpe.alias("sharpe"), (-F.min("dd")).alias("dd"), F.max("i").cast("long").alias("n_cycles"), F.sum("n_orders").alias("n_orders"), F.min("d").alias("a"), F.max("d").alias("b"))
    b = A.bench_1d(spark, sf)
    first, last = b.select(F.col("d").alias("a"), F.col("close").alias("c0")), b.select(F.col("d").alias("b"), F.col("close").alias("c1"))
    g = g.join(first, "a", "left").join(last, "b", "left").withColumn("bench", F.col("c1") / F.col("c0") - 1)
    total = F.col("total")
    return g.select("fund", r6(total, "total_return"), r6(F.pow(1 + total, 1 / F.col("years")) - 1, "annualised"), r6(F.col("sharpe"), "sharpe"), r6(F.col("dd"), "max_drawdown"), r6(F.col("bench"), "benchmark_return"), r6(total - F.col("bench"), "excess_return"), "n_cycles", "n_orders")


def crossed(spark, sf):
    """Daily sign of the 20-day mean crossing: +1 above, -1 below by more than 5 %, else 0."""
    w = X.series()
    m = X.roll(F.avg, F.col("close"), w, 20)
    x = A.bars_1d(spark, sf).select(F.col("symbol").alias("ticker"), "d", "close", F.coalesce(F.try_divide(F.col("close"), m) - 1, F.lit(0.0)).alias("gap"))
    return x.withColumn("signal", F.when(F.col("gap") > 0.05, 1).when(F.col("gap") < -0.05, -1).otherwise(0))


CROSSED = """x AS (SELECT symbol AS ticker, d, close, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n,
      coalesce(CASE WHEN count(close) OVER r >= 20 THEN close / avg(close) OVER r - 1 END, 0) AS gap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d), r AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    s AS MATERIALIZED (SELECT *, CASE WHEN gap > 0.05 THEN 1 WHEN gap < -0.05 THEN -1 ELSE 0 END AS signal FROM x)"""
EDGE = f"""WITH RECURSIVE {CROSSED}, e AS (SELECT DISTINCT ticker, -1::BIGINT AS i, true AS armed, 0::BIGINT AS busy, false AS opened FROM s
      UNION ALL SELECT ticker, i, CASE WHEN skip THEN armed WHEN signal = 0 THEN true WHEN opens THEN false ELSE armed END, CASE WHEN opens THEN i + 20 ELSE busy END, opens
      FROM (SELECT s.ticker, s.i, s.signal, e.armed, e.busy, s.i < e.busy AS skip, s.i >= e.busy AND s.signal <> 0 AND e.armed AND s.i + 20 < s.n AND trunc(10000 / s.close) > 0 AS opens FROM e JOIN s ON s.ticker = e.ticker AND s.i = e.i + 1)),
    t AS (SELECT a.ticker, a.d AS entry, b.d AS exit, a.signal AS side, trunc(10000 / a.close)::BIGINT AS shares, round((b.close - a.close) * trunc(10000 / a.close) * a.signal, 4) AS pnl
      FROM e JOIN s a ON a.ticker = e.ticker AND a.i = e.i JOIN s b ON b.ticker = a.ticker AND b.i = a.i + 20 WHERE e.opened)"""


@plan("edge_trigger_trades", f"{EDGE} SELECT * FROM t", "bars")
def edge(spark, sf):
    return simulation.edge_trades(crossed(spark, sf).select("ticker", "d", "close", "signal"), 20, 10_000.0)


@plan("trade_metrics", f"""{EDGE}, c AS (SELECT *, pnl / 10000 AS r, 10000 + sum(pnl) OVER (PARTITION BY ticker ORDER BY entry) AS equity FROM t), m AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY ticker ORDER BY entry)) AS peak FROM c),
    g AS (SELECT ticker, count(*) AS n, greatest(date_diff('day', min(entry), max(exit)) / 365.25, 0.01) AS years, avg(r) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(r) ELSE 1 END AS sd, sum(pnl) / 10000 AS total, max((peak - equity) / peak) AS dd,
      avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win, sum(greatest(pnl, 0)) AS up, -sum(least(pnl, 0)) AS down, avg(pnl) AS avg_pnl, count(*) FILTER (side = 1) AS n_long, avg(exit - entry) AS held FROM m GROUP BY 1)
    SELECT ticker, n, n_long, n - n_long AS n_short, round(total, 6) AS total_return, CASE WHEN total > -1 THEN round(pow(1 + total, 1 / years) - 1, 6) END AS annualised, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(n / years) ELSE 0 END, 4) AS sharpe, round(dd, 6) AS max_drawdown,
      round(win, 6) AS win_rate, CASE WHEN down > 1e-9 THEN round(up / down, 6) END AS profit_factor, round(avg_pnl, 4) AS avg_pnl, round(held, 1) AS avg_days FROM g""", "bars")
def trade_metrics(spark, sf):
    """Returns, Sharpe by trades per year, drawdown of the curve of closed trades, win rate, profit factor and averages of the edge-triggered trades."""
    t = edge(spark, sf)
    w = W.partitionBy("ticker").orderBy("entry")
    t = t.withColumn("equity", 10_000 + F.sum("pnl").over(w)).withColumn("peak", F.greatest(F.lit(10_000.0), F.max("equity").over(w)))
    r = F.col("pnl") / 10_000
    win, loss = F.sum(F.greatest("pnl", F.lit(0.0))), -F.sum(F.least("pnl", F.lit(0.0)))
    g = t.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("side") == 1).cast("long")).alias("n_long"), F.greatest(F.date_diff(F.max("exit"), F.min("entry")) / 365.25, F.lit(0.01)).alias("years"),
        F.avg(r).alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp(r)).otherwise(1.0).alias("sd"), F.sum(r).alias("total"), F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("dd"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win"), F.when(loss > 1e-9, F.round(win / loss, 6)).alias("profit_factor"), F.round(F.avg("pnl"), 4).alias("avg_pnl"), F.round(F.avg(F.date_diff("exit", "entry")), 1).alias("avg_days"),
    )
    annual = F.when(F.col("total") > -1, F.round(F.pow(1 + F.col("total"), 1 / F.col("years")) - 1, 6))
    sharpe = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt(F.col("n") / F.col("years"))).otherwise(0.0)
    return g.select("ticker", "n", "n_long", (F.col("n") - F.col("n_long")).alias("n_short"), r6(F.col("total"), "total_return"), annual.alias("annualised"), F.round(sharpe, 4).alias("sharpe"), r6(F.col("dd"), "max_drawdown"), r6(F.col("win"), "win_rate"), "profit_factor", "avg_pnl", "avg_days")


V1 = f"""WITH RECURSIVE {CROSSED}, a AS MATERIALIZED (SELECT ticker, d, i, close AS p, CASE WHEN signal = 1 AND turn > 0 THEN 'buy' WHEN signal = -1 AND turn < 0 THEN 'short' WHEN signal = 0 AND turn < 0 THEN 'sell' WHEN signal = 0 AND turn > 0 THEN 'cover' ELSE 'hold' END AS action
      FROM (SELECT *, signal - coalesce(lag(signal) OVER (PARTITION BY ticker ORDER BY d), 0) AS turn FROM s)),
    b AS (SELECT DISTINCT ticker, NULL::DATE AS d, -1::BIGINT AS i, 0.0::DOUBLE AS p, 0.0::DOUBLE AS filled, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS margin, 0.0::DOUBLE AS lq, 0.0::DOUBLE AS sq, 0.0::DOUBLE AS lc, 0.0::DOUBLE AS sc, 0.0::DOUBLE AS gain FROM a
      UNION ALL SELECT ticker, d, i, p, q, CASE action WHEN 'buy' THEN cash - q * p WHEN 'sell' THEN cash + q * p WHEN 'short' THEN cash + q * p - q * p * 0.5 WHEN 'cover' THEN cash + CASE WHEN q > 0 THEN margin * q / sq ELSE 0 END - q * p ELSE cash END,
        CASE action WHEN 'short' THEN margin + q * p * 0.5 WHEN 'cover' THEN CASE WHEN q > 0 AND q = sq THEN 0 WHEN q > 0 THEN margin - margin * q / sq ELSE margin END ELSE margin END,
        CASE action WHEN 'buy' THEN lq + q WHEN 'sell' THEN lq - q ELSE lq END, CASE action WHEN 'short' THEN sq + q WHEN 'cover' THEN sq - q ELSE sq END,
        CASE WHEN action = 'buy' AND q > 0 THEN (lc * lq + q * p) / (lq + q) WHEN action = 'sell' AND q > 0 AND q = lq THEN 0 ELSE lc END, CASE WHEN action = 'short' AND q > 0 THEN (sc * sq + q * p) / (sq + q) WHEN action = 'cover' AND q > 0 AND q = sq THEN 0 ELSE sc END,
        CASE WHEN action = 'sell' AND q > 0 THEN gain + (p - lc) * q WHEN action = 'cover' AND q > 0 THEN gain + (sc - p) * q ELSE gain END
      FROM (SELECT b.*  EXCLUDE (d, i, p, filled), a.d, a.i, a.p, a.action, CASE a.action WHEN 'buy' THEN CASE WHEN cash > 0 THEN least(10, cash / a.p) ELSE 0 END WHEN 'sell' THEN least(10, lq) WHEN 'cover' THEN least(10, sq)
          WHEN 'short' THEN CASE WHEN 10 * a.p * 0.5 > greatest(0, cash - margin) THEN greatest(0, cash / (a.p * 0.5)) ELSE 10 END ELSE 0 END AS q FROM b JOIN a ON a.ticker = b.ticker AND a.i = b.i + 1))"""


@plan("v1_book", f"""{V1} SELECT ticker, d, round(filled, 4) AS filled, round(cash, 4) AS cash, round(margin, 4) AS margin, round(lq, 4) AS long, round(sq, 4) AS short, round(gain, 4) AS realised, round(cash + margin + lq * p - sq * p, 4) AS equity FROM b WHERE i >= 0""", "bars")
def margin_book(spark, sf):
    x = crossed(spark, sf)
    turn = F.col("signal") - F.coalesce(F.lag("signal").over(W.partitionBy("ticker").orderBy("d")), F.lit(0))
    action = F.when((F.col("signal") == 1) & (turn > 0), "buy").when((F.col("signal") == -1) & (turn < 0), "short").when((F.col("signal") == 0) & (turn < 0), "sell").when((F.col("signal") == 0) & (turn > 0), "cover").otherwise("hold")
    b = simulation.margin_book(x.select("ticker", "d", F.col("close").alias("price"), action.alias("action"), F.lit(10.0).alias("qty")), 100_000.0)
    return b.select("ticker", "d", *[F.round(c, 4).alias(c) for c in ("filled", "cash", "margin", "long", "short", "realised", "equity")])


def mmr_sql(notional: str) -> str:
    return f"CASE WHEN {notional} < 50000 THEN 0.005 WHEN {notional} < 250000 THEN 0.01 WHEN {notional} < 1000000 THEN 0.015 ELSE 0.025 END::DOUBLE"


PERP = f"""WITH RECURSIVE h AS (SELECT symbol, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_min(price, (ts, trade_id)) AS p FROM trades GROUP BY 1, 2),
    x AS (SELECT symbol, ts, p, rate, sign(p - avg(p) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))::INT AS side FROM h JOIN funding USING (symbol, ts) WHERE p > 0),
    n AS MATERIALIZED (SELECT *, hour(ts) = 0 AS adds, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM x),
    l AS (SELECT DISTINCT symbol, NULL::TIMESTAMP AS ts, 0::BIGINT AS i, 0.0::DOUBLE AS p, 'start' AS event, 10000.0::DOUBLE AS cash, 0 AS pos, 0.0::DOUBLE AS size, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS held, 0.0::DOUBLE AS liq FROM n
      UNION ALL SELECT symbol, ts, i, p, CASE WHEN opens AND pos <> 0 THEN 'reversed' WHEN opens THEN 'opened' WHEN hit THEN 'liquidated' WHEN closes THEN 'closed' WHEN grows THEN 'added' WHEN asks THEN 'rejected' ELSE 'hold' END,
        CASE WHEN opens THEN c2 - m2 - m2 * 5 * 0.0005 WHEN grows THEN c2 - m1 - m1 * 5 / p * p * 0.0005 ELSE c2 END, CASE WHEN opens THEN side WHEN hit OR closes THEN 0 ELSE pos END, s2, e2, CASE WHEN opens THEN m2 WHEN grows THEN held + m1 WHEN hit OR closes THEN 0 ELSE held END,
        CASE WHEN opens OR grows THEN e2 * (1 - (CASE WHEN opens THEN side ELSE pos END) * (1 / 5.0::DOUBLE - {mmr_sql('s2 * e2')})) ELSE liq END
      FROM (SELECT *, CASE WHEN opens THEN m2 * 5 / p WHEN grows THEN size + m1 * 5 / p WHEN hit OR closes THEN 0 ELSE size END AS s2, CASE WHEN opens THEN p WHEN grows THEN (entry * size + p * (m1 * 5 / p)) / (size + m1 * 5 / p) WHEN hit OR closes THEN 0 ELSE entry END AS e2
      FROM (SELECT *, asks AND m1 > 0 AND m1 + m1 * 5 / p * p * 0.0005 <= c2 AS grows, (pos = 0 OR closes) AND NOT hit AND side <> 0 AND c2 > 0 AS opens, c2 * 0.1 AS m2
      FROM (SELECT *, pos <> 0 AND NOT hit AND NOT closes AND adds AS asks, greatest(c2, 0) * 0.1 AS m1
      FROM (SELECT *, CASE WHEN closes THEN c1 + held + pos * size * (p - entry) - size * p * 0.0005 ELSE c1 END AS c2
      FROM (SELECT *, pos <> 0 AND NOT hit AND side <> pos AS closes, cash - CASE WHEN pos <> 0 AND NOT hit THEN pos * size * p * rate ELSE 0 END AS c1
      FROM (SELECT l.symbol, n.ts, n.i, n.p, n.rate, n.side, n.adds, l.cash, l.pos, l.size, l.entry, l.held, l.liq, l.pos > 0 AND n.p <= l.liq OR l.pos < 0 AND n.p >= l.liq AS hit FROM l JOIN n ON n.symbol = l.symbol AND n.i = l.i + 1)))))))"""


@plan("perp_ledger", f"{PERP} SELECT symbol, ts, event, round(cash, 4) AS cash, round(cash + CASE WHEN pos <> 0 THEN held + pos * size * (p - entry) ELSE 0 END, 4) AS equity FROM l WHERE i > 0", "trades funding")
def perp(spark, sf):
    f = A.funding(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    h = A.trades(spark, sf).groupBy("symbol", F.window("ts", "8 hours").start.alias("ts")).agg(F.min_by("price", F.struct("ts", "trade_id")).alias("price"))
    x = h.join(f, ["symbol", "ts"]).where("price > 0")
    side = F.signum(F.col("price") - F.avg("price").over(W.partitionBy("symbol").orderBy("ts").rowsBetween(-5, 0))).cast("int")
    x = x.select("symbol", "ts", "price", "rate", side.alias("side"), (F.hour("ts") == 0).alias("adds"))
    b = simulation.perp_ledger(x, 10_000.0, 5.0, simulation.margin_rate)
    return b.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "event", F.round("cash", 4).alias("cash"), F.round("equity", 4).alias("equity"))


FEE = "CASE market WHEN 'perp' THEN 0.0004 ELSE 0.001 END"


@plan("fees_slippage", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'perp' ELSE 'spot' END AS market FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(n * {FEE} * 0.75, 8) AS fee, round(n * (2 + n / 15e9 * 1e4) / 1e4, 6) AS slippage FROM x""")
def fees(spark, sf):
    market = F.when(F.col("l_linenumber") % 2 == 0, "perp").otherwise("spot")
    n = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(costs.fee(n, market, 1, False, 0.25), 8).alias("fee"), r6(costs.slippage(n), "slippage"))


@plan("liquidation_tiers", """WITH x AS (SELECT o_orderkey, o_totalprice AS p, CASE WHEN o_orderkey % 2 = 0 THEN true ELSE false END AS long, CASE WHEN o_totalprice < 50000 THEN 0.005 WHEN o_totalprice < 250000 THEN 0.01 WHEN o_totalprice < 1000000 THEN 0.015 ELSE 0.025 END AS r FROM orders)
    SELECT o_orderkey, r::DOUBLE AS rate, round(CASE WHEN long THEN p * (1 - 1 / 5.0::DOUBLE + r::DOUBLE) ELSE p * (1 + 1 / 5.0::DOUBLE - r::DOUBLE) END, 6) AS liquidation FROM x""")
def liquidation(spark, sf):
    p = F.col("o_totalprice")
    rate = costs.maintenance_rate(p)
    return table(spark, sf, "orders").select("o_orderkey", rate.alias("rate"), r6(costs.liquidation_price(p, F.lit(5.0), F.col("o_orderkey") % 2 == 0, rate), "liquidation"))


@plan("funding_cost", "SELECT symbol, count(*) AS n, round(-10 * sum(rate), 6) AS long_cost, round(10 * sum(rate), 6) AS short_cost FROM funding WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1", "funding")
def funding_cost(spark, sf):
    f = A.funding(spark, sf).where("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-20'")
    return f.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(-10 * F.sum("rate"), "long_cost"), r6(10 * F.sum("rate"), "short_cost"))


CURVE = "v AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r, close / max(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS dd, close FROM bars)"


@plan("three_sharpes", f"""WITH {CURVE} SELECT symbol, round((avg(r) - 0.0434 / 252) / stddev_samp(r) * sqrt(252), 6) AS excess_sharpe, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS daily_sharpe, round(avg(r) / stddev_samp(r) * sqrt(52), 6) AS weekly_sharpe FROM v GROUP BY 1""", "bars")
def sharpes(spark, sf):
    c = metrics.curve(A.bars_1d(spark, sf), "symbol", "d", "close")
    r = F.col("ret")
    return c.groupBy("symbol").agg(r6(metrics.sharpe(r, 252, metrics.RISK_FREE), "excess_sharpe"), r6(metrics.sharpe(r, 252), "daily_sharpe"), r6(metrics.sharpe(r, 52), "weekly_sharpe"))


@plan("sortino_calmar", f"""WITH {CURVE} SELECT symbol, round(avg(r - 0.0434 / 252) / sqrt(avg(pow(least(r - 0.0434 / 252, 0), 2))) * sqrt(252), 6) AS sortino,
    round((pow(arg_max(close, d) / arg_min(close, d), 365.0 / date_diff('day', min(d), max(d))) - 1) / abs(min(dd)), 6) AS calmar, round(min(dd) * 100, 6) AS max_drawdown_pct, arg_min(d, dd) AS trough FROM v GROUP BY 1""", "bars")
def sortino_calmar(spark, sf):
    c = metrics.curve(A.bars_1d(spark, sf), "symbol", "d", "close")
    days = F.date_diff(F.max("d"), F.min("d"))
    return c.groupBy("symbol").agg(r6(metrics.sortino(F.col("ret"), 252), "sortino"), r6(metrics.calmar(F.min_by("close", "d"), F.max_by("close", "d"), days, F.min("dd")), "calmar"), r6(F.min("dd") * 100, "max_drawdown_pct"), F.min_by("d", "dd").alias("trough"))


@plan("trade_stats", f"WITH {CURVE} SELECT symbol, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) FILTER (r IS NOT NULL), 6) AS win_rate, round(sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0), 6) AS profit_factor FROM v GROUP BY 1", "bars")
def trade_stats(spark, sf):
    c = metrics.curve(A.bars_1d(spark, sf), "symbol", "d", "close").where("ret is not null")
    r = F.col("ret")
    return c.groupBy("symbol").agg(r6(F.avg(F.when(r > 0, 1.0).otherwise(0.0)), "win_rate"), r6(F.sum(F.when(r > 0, r)) / -F.sum(F.when(r < 0, r)), "profit_factor"))


SYMBOLS = ("AF", "AO", "NF", "NO", "RF", "RO")


@plan("equity_curve_pivot", "SELECT date_trunc('month', d)::DATE AS m, " + ", ".join(f"round(max(close) FILTER (symbol = '{x}'), 6) AS {x.lower()}" for x in SYMBOLS) + " FROM bars GROUP BY 1", "bars")
def equity_pivot(spark, sf):
    p = A.bars_1d(spark, sf).groupBy(F.trunc("d", "month").alias("m")).pivot("symbol", list(SYMBOLS)).agg(F.max("close"))
    return p.select("m", *[r6(F.col(x), x.lower()) for x in SYMBOLS])


def parameters(spark):
    return spark.createDataFrame([(f, s) for f in (8, 21, 34) for s in (21, 55, 89)], "fast int, slow int")


GRID_RUN = """WITH RECURSIVE n AS MATERIALIZED (SELECT symbol, d, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM bars),
    p AS (SELECT fast::BIGINT AS fast, slow::BIGINT AS slow FROM (VALUES (8), (21), (34)) a(fast) CROSS JOIN (VALUES (21), (55), (89)) b(slow)),
    g AS (SELECT symbol, fast, slow, i, close AS f, close AS s, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS shares, 0::BIGINT AS k, 100000.0::DOUBLE AS equity FROM n CROSS JOIN p WHERE i = 1 AND fast < slow
      UNION ALL SELECT symbol, fast, slow, i, f2, s2, CASE WHEN buys THEN cash - trunc(cash / c) * c WHEN sells THEN cash + shares * c ELSE cash END, CASE WHEN buys THEN trunc(cash / c) WHEN sells THEN 0 ELSE shares END,
        k + CASE WHEN buys OR sells THEN 1 ELSE 0 END, cash + shares * c
      FROM (SELECT *, f <= s AND f2 > s2 AND shares = 0 AS buys, f >= s AND f2 < s2 AND shares <> 0 AS sells
        FROM (SELECT g.*  EXCLUDE (i), n.i, n.close AS c, 2.0 / (fast + 1) * n.close + (1 - 2.0 / (fast + 1)) * f AS f2, 2.0 / (slow + 1) * n.close + (1 - 2.0 / (slow + 1)) * s AS s2 FROM g JOIN n ON n.symbol = g.symbol AND n.i = g.i + 1))),
    r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol, fast, slow ORDER BY i) - 1 AS ret FROM g),
    o AS (SELECT symbol, fast::INT AS fast, slow::INT AS slow, round(arg_max(equity, i) / 100000 - 1, 6) AS total_return, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) END, 6) AS sharpe, max(k) AS n_trades, NULL::VARCHAR AS error FROM r GROUP BY 1, 2, 3
      UNION ALL SELECT symbol, fast::INT, slow::INT, NULL, NULL, NULL, 'fast must be below slow' FROM (SELECT DISTINCT symbol FROM n) CROSS JOIN p WHERE fast >= slow)"""


@plan("grid_search", f"{GRID_RUN} SELECT * FROM o", "bars")
def grid(spark, sf):
    g = simulation.grid_search(A.bars_1d(spark, sf).select("symbol", "d", "close"), parameters(spark), 100_000.0)
    return g.select("symbol", "fast", "slow", r6(F.col("total_return"), "total_return"), r6(F.col("sharpe"), "sharpe"), "n_trades", "error")


@plan("param_heatmap", GRID_RUN + " SELECT fast, " + ", ".join(f'round(avg(sharpe) FILTER (slow = {n}), 6) AS "{n}"' for n in (21, 55, 89)) + " FROM o GROUP BY 1", "bars")
def heatmap(spark, sf):
    return grid(spark, sf).groupBy("fast").pivot("slow", [21, 55, 89]).agg(r6(F.avg("sharpe"), "s"))


@plan("oms_positions", "SELECT symbol, CASE side WHEN 'buy' THEN 'long' ELSE 'short' END AS direction, round(sum(amount), 6) AS volume, round(sum(price * amount) / nullif(sum(amount), 0), 6) AS avg_price, count(*) AS n FROM trades GROUP BY 1, 2", "trades")
def oms(spark, sf):
    t = A.trades(spark, sf)
    return t.groupBy("symbol", F.when(F.col("side") == "buy", "long").otherwise("short").alias("direction")).agg(r6(F.sum("amount"), "volume"), r6(F.try_divide(F.sum(F.col("price") * F.col("amount")), F.sum("amount")), "avg_price"), F.count(F.lit(1)).alias("n"))


@plan("oms_latest", "SELECT symbol, arg_max(price, (ts, trade_id)) AS last_price, arg_max(side, (ts, trade_id)) AS last_side, max(ts) AS ts FROM trades GROUP BY 1", "trades")
def latest(spark, sf):
    k = F.struct("ts", "trade_id")
    return A.trades(spark, sf).groupBy("symbol").agg(F.max_by("price", k).alias("last_price"), F.max_by("side", k).alias("last_side"), F.max("ts").cast("timestamp_ntz").alias("ts"))


@plan("paper_match", None)
def paper(spark, sf):
    t = A.trades(spark, sf).where("price > 0")
    kind = F.when(F.col("trade_id") % 10 == 3, "market").when(F.col("trade_id") % 10 == 7, "limit").otherwise("bar")
    price = F.when(kind == "limit", F.col("price") * F.when(F.col("side") == "buy", 0.9).otherwise(1.1)).otherwise(F.col("price"))
    return simulation.paper_match(t.select("symbol", "ts", F.col("trade_id").alias("seq"), kind.alias("kind"), "side", price.alias("price"), F.lit(1.0).alias("qty")), 5_000.0)


@plan("alert_cooldown", """WITH RECURSIVE a AS MATERIALIZED (SELECT symbol, ts, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, price) AS i FROM trades WHERE price > 100),
    c AS (SELECT symbol, ts, price, i, ts AS last, true AS fires FROM a WHERE i = 1 UNION ALL
      SELECT a.symbol, a.ts, a.price, a.i, CASE WHEN a.ts - c.last >= INTERVAL 1 DAY THEN a.ts ELSE c.last END, a.ts - c.last >= INTERVAL 1 DAY FROM c JOIN a ON a.symbol = c.symbol AND a.i = c.i + 1)
    SELECT symbol, ts, price FROM c WHERE fires""", "trades")
def alerts(spark, sf):
    t = A.trades(spark, sf).where("price > 100").select("symbol", "ts", "price")
    return simulation.cooldown(t, "symbol", "ts", 86_400).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@plan("top_events", "SELECT trade_id, symbol, price FROM trades ORDER BY price DESC, trade_id LIMIT 20", "trades")
def top(spark, sf):
    return A.trades(spark, sf).select("trade_id", "symbol", "price").orderBy(F.desc("price"), "trade_id").limit(20)


@plan("paged_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def paged(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(200).limit(100)


@plan("traded_days_intersect", "SELECT d FROM bars INTERSECT SELECT d FROM bench", "bars bench")
def common_days(spark, sf):
    return A.bars_1d(spark, sf).select("d").intersect(A.bench_1d(spark, sf).select("d"))
