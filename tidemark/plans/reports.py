"""Plans of reports, risk sizing, calendars and order life cycles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import alerts, costs, joins, metrics, signals
from tidemark.plans import books, indicators, research, stream
from tidemark.plans.indicators import P, full
from tidemark.sources import adapters as A
from tidemark.sources.adapters import with_views
from tidemark.sources.tables import table

QUERIES, SQL = {}, {}


def plan(name: str, sql: str | None, views: str = ""):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_views(views, sql) if views else sql
        return fn

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


# Sentiment


VERDICTS = """llm AS (SELECT source, CASE WHEN x > 0.1 THEN 'bullish' WHEN x < -0.1 THEN 'bearish' ELSE 'neutral' END AS verdict, floor(round(abs(x) * 100, 6)) AS conf
    FROM (SELECT source, avg(quality) - avg(toxic) - 0.4 AS x FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY 1))"""


def verdicts(spark, sf):
    """Verdicts (source, verdict, conf) of the recorded labels: the share of good less that of toxic texts, against 0.4."""
    d = table(spark, sf, "documents").where("source is not null").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    x = d.groupBy("source").agg((F.avg("quality") - F.avg("toxic") - 0.4).alias("x"))
    v = F.when(F.col("x") > 0.1, "bullish").when(F.col("x") < -0.1, "bearish").otherwise("neutral")
    return x.select("source", v.alias("verdict"), F.floor(F.round(F.abs("x") * 100, 6)).alias("conf"))


@plan("sentiment_layers", f"""WITH {research.LEX}, {VERDICTS}, g AS (SELECT source, sum(CASE label WHEN 'bullish' THEN confidence WHEN 'bearish' THEN -confidence ELSE 0 END) / sum(confidence) AS score FROM l GROUP BY 1),
    c AS (SELECT source, score, 0.4 * CASE WHEN score > 0.1 THEN 1 WHEN score < -0.1 THEN -1 ELSE 0 END + 0.6 * CASE verdict WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS x, 0.4 * abs(score) * 100 + 0.6 * conf AS k FROM g JOIN llm USING (source))
    SELECT source, CASE WHEN x > 0.15 THEN 'bullish' WHEN x < -0.15 THEN 'bearish' ELSE 'neutral' END AS signal, floor(round(k, 6))::BIGINT AS confidence FROM c""")
def sentiment_layers(spark, sf):
    """The lexicon's layer and the verdict of the labels as one signal, weighted 0.4 and 0.6."""
    s = signals.lexicon_sentiment(table(spark, sf, "documents").select("doc_id", "source", "text"), "text", research.UP, research.DOWN)
    g = signals.aggregate_sentiment(s, ["source"]).select("source", "score", "label").join(verdicts(spark, sf), "source")
    sign = lambda c: F.when(F.col(c) == "bullish", 1).when(F.col(c) == "bearish", -1).otherwise(0)
    x = 0.4 * sign("label") + 0.6 * sign("verdict")
    conf = signals.whole(0.4 * F.abs("score") * 100 + 0.6 * F.col("conf"))
    return g.select("source", F.when(x > 0.15, "bullish").when(x < -0.15, "bearish").otherwise("neutral").alias("signal"), conf.alias("confidence"))


def has_word(sep: str) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in signals.RISK_WORDS)


@plan("risk_keywords", f"SELECT doc_id, lang FROM documents WHERE {has_word('')}")
def risk_keywords(spark, sf):
    """Documents with one of the substrings that mark a risk market, whatever the case."""
    q, hit = F.lower("text"), F.lit(False)
    for w in signals.RISK_WORDS:
        hit = hit | q.contains(w)
    return table(spark, sf, "documents").where(hit).select("doc_id", "lang")


WORDS_UP, WORDS_DOWN = (f"[{', '.join(repr(w) for w in ws)}]" for ws in (signals.BULLISH, signals.BEARISH))


@plan("market_sentiment", f"""WITH x AS (SELECT conv_id, turn, len(list_intersect(w, {WORDS_UP})) AS u, len(list_intersect(w, {WORDS_DOWN})) AS v FROM (SELECT conv_id, turn, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM conversations))
    SELECT conv_id, turn, CASE WHEN u > v THEN 'bullish' WHEN u < v THEN 'bearish' ELSE 'neutral' END AS label, round(CASE WHEN u = v THEN 0.5 ELSE least(0.5 + 0.1 * abs(u - v), 0.9) END::DOUBLE, 6) AS confidence FROM x""")
def market_sentiment(spark, sf):
    """Label of every turn by the market words."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return signals.lexicon_sentiment(c, "text", signals.BULLISH, signals.BEARISH).select("conv_id", "turn", "label", r6(F.col("confidence"), "confidence"))


# Risk


@plan("crypto_risk", f"""WITH {P}, a AS (SELECT symbol, d, close, {full('stddev_samp(ret)', 21, 'ret')} AS vol, {full('avg(tr)', 14, 'tr')} AS atr, close / max(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS dd FROM p)
    SELECT symbol, d, round(vol * sqrt(365), 6) AS annual_vol, round(atr, 5) AS atr, CASE WHEN atr IS NOT NULL THEN round(least(100000 * 0.02 / atr, 100000 * 0.4) / close * greatest(0, 1 + dd / 0.20), 6) END AS size FROM a""", "bars")
def crypto_risk(spark, sf):
    """Annual volatility, average range and the position size: two parts in a hundred at risk, four in ten at most, less in a drawdown."""
    w = X.series()
    c = F.col("close")
    x = indicators.priced(spark, sf).select("symbol", "d", "close", X.roll(F.stddev_samp, F.col("ret"), w, 21).alias("vol"), X.roll(F.avg, F.col("tr"), w, 14).alias("atr"), X.drawdown(c, w).alias("dd"))
    size = F.least(F.try_divide(F.lit(100_000 * 0.02), F.col("atr")), F.lit(100_000 * 0.4)) / c * F.greatest(F.lit(0.0), 1 + F.col("dd") / 0.20)
    return x.select("symbol", "d", r6(F.col("vol") * F.sqrt(F.lit(365.0)), "annual_vol"), F.round("atr", 5).alias("atr"), F.round(F.when(F.col("atr").isNotNull(), size), 6).alias("size"))


@plan("cost_summary", f"""WITH x AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'perp' ELSE 'spot' END AS market, l_extendedprice AS n, l_discount - 0.05 AS edge FROM lineitem)
    SELECT market, count(*) AS n_trades, round(sum(n * {books.FEE} * 0.75), 2) AS fees, round(sum(n * (2 + n / 15e9 * 1e4) / 1e4), 2) AS slippage, round(sum(n * edge) - sum(n * {books.FEE} * 0.75) - sum(n * (2 + n / 15e9 * 1e4) / 1e4), 2) AS net_pnl FROM x GROUP BY 1""")
def cost_summary(spark, sf):
    """Fees, slippage and what is left of the gross result, by market."""
    market = F.when(F.col("l_linenumber") % 2 == 0, "perp").otherwise("spot")
    n = F.col("l_extendedprice")
    x = table(spark, sf, "lineitem").select(market.alias("market"), costs.fee(n, market, 1, False, 0.25).alias("fee"), costs.slippage(n).alias("slip"), (n * (F.col("l_discount") - 0.05)).alias("gross"))
    return x.groupBy("market").agg(F.count(F.lit(1)).alias("n_trades"), F.round(F.sum("fee"), 2).alias("fees"), F.round(F.sum("slip"), 2).alias("slippage"), F.round(F.sum("gross") - F.sum("fee") - F.sum("slip"), 2).alias("net_pnl"))


@plan("top_markets", f"""WITH m AS (SELECT token_id, max(ts) AS t FROM prob GROUP BY 1), v AS (SELECT token_id, avg(p) FILTER (ts > t - INTERVAL 1 HOUR) AS now, avg(p) FILTER (ts > t - INTERVAL 24 HOUR AND ts <= t - INTERVAL 1 HOUR) AS old FROM prob JOIN m USING (token_id) GROUP BY 1),
    z AS (SELECT token_id, round(now, 6) AS p, round(now - coalesce(old, now), 6) AS velocity FROM v)
    SELECT token_id, p, velocity, rank FROM (SELECT *, row_number() OVER (ORDER BY abs(velocity) DESC, token_id) AS rank FROM z) WHERE rank <= 5""", "prob")
def top_markets(spark, sf):
    """The five markets that moved most."""
    z = research.velocities(A.prob_ticks(spark, sf)).select("token_id", r6(F.col("now"), "p"), r6(F.col("v"), "velocity"))
    top = z.orderBy(F.abs("velocity").desc(), "token_id").limit(5)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.abs("velocity").desc(), "token_id")))


# Statistics


@plan("anomaly_stats", f"""WITH z AS (SELECT symbol, d, (high - low) / open AS iv, CASE WHEN count(*) OVER w >= 10 THEN (volume - avg(volume) OVER w) / (stddev_samp(volume) OVER w + 1e-9) END AS vz FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT symbol, coalesce(abs(vz) > 2, false) AS anomaly, count(*) AS n, round(avg(iv), 6) AS mean, round(max(iv), 6) AS highest, round(min(iv), 6) AS lowest, round(stddev_samp(iv), 6) AS sd FROM z GROUP BY 1, 2""", "bars")
def anomaly_stats(spark, sf):
    """Range within the day on days of unusual volume against the others."""
    w = X.series()
    x = A.bars_1d(spark, sf).select("symbol", ((F.col("high") - F.col("low")) / F.col("open")).alias("iv"), F.coalesce(F.abs(X.z_score(F.col("volume"), w, 60, 10)) > 2, F.lit(False)).alias("anomaly"))
    return x.groupBy("symbol", "anomaly").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("iv"), "mean"), r6(F.max("iv"), "highest"), r6(F.min("iv"), "lowest"), r6(F.stddev_samp("iv"), "sd"))


@plan("day_summary", """SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n, max(price) AS highest, arg_max(trade_id, (price, -trade_id)) AS highest_id, min(price) AS lowest, arg_min(trade_id, (price, trade_id)) AS lowest_id FROM trades GROUP BY 1, 2""", "trades")
def day_summary(spark, sf):
    """Extremes of each day and the trades that made them, the earliest of equal ones."""
    g = A.trades(spark, sf).groupBy("symbol", F.to_date("ts").alias("day"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("highest"), F.max_by("trade_id", F.struct("price", -F.col("trade_id"))).alias("highest_id"), F.min("price").alias("lowest"), F.min_by("trade_id", F.struct("price", "trade_id")).alias("lowest_id"))


@plan("freshness", """WITH m AS (SELECT user_id, max(ts) AS last FROM trades GROUP BY 1), n AS (SELECT max(last) AS now FROM m)
    SELECT CASE WHEN now - last < INTERVAL 1 HOUR THEN 'hour' WHEN now - last < INTERVAL 24 HOUR THEN 'day' ELSE 'stale' END AS bucket, count(*) AS n FROM m CROSS JOIN n GROUP BY 1""", "trades")
def freshness(spark, sf):
    """How many users were seen within an hour, within a day or before, against the newest trade."""
    t = A.trades(spark, sf)
    now = t.agg(F.max("ts").alias("now"))
    m = t.groupBy("user_id").agg(F.max("ts").alias("last")).join(now, F.lit(True))
    age = F.unix_micros("now") - F.unix_micros("last")
    hour = 3_600_000_000
    return m.groupBy(F.when(age < hour, "hour").when(age < 24 * hour, "day").otherwise("stale").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@plan("metric_comparison", f"""WITH {books.CURVE}, m AS (SELECT symbol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, min(dd) AS drawdown, arg_max(close, d) / arg_min(close, d) - 1 AS total FROM v GROUP BY 1),
    u AS (UNPIVOT m ON sharpe, drawdown, total INTO NAME metric VALUE value)
    SELECT metric, {", ".join(f"round(max(value) FILTER (symbol = '{s}'), 6) AS {s.lower()}" for s in books.SYMBOLS)} FROM u GROUP BY 1""", "bars")
def metric_comparison(spark, sf):
    """One row for each metric, one column for each series."""
    g = metrics.curve(A.bars_1d(spark, sf), "symbol", "d", "close").groupBy("symbol")
    m = g.agg(metrics.sharpe(F.col("ret"), 252).alias("sharpe"), F.min("dd").alias("drawdown"), (F.max_by("close", "d") / F.min_by("close", "d") - 1).alias("total"))
    u = m.unpivot("symbol", ["sharpe", "drawdown", "total"], "metric", "value")
    p = u.groupBy("metric").pivot("symbol", list(books.SYMBOLS)).agg(F.max("value"))
    return p.select("metric", *[r6(F.col(s), s.lower()) for s in books.SYMBOLS])


@plan("car_by_source", f"""WITH {research.EVENTS}, u AS (SELECT source_type, unnest(['car_0_1', 'car_0_5', 'car_0_20']) AS win, unnest([c1, c5, c20]) AS car FROM car)
    SELECT source_type, win, round(avg(car) * 100, 2) AS mean_pct, round(1.96 * stddev_samp(car) / sqrt(count(car)) * 100, 2) AS half_width_pct, round(avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END) FILTER (car IS NOT NULL), 4) AS share_up FROM u GROUP BY 1, 2 HAVING count(car) >= 2""", "bars bench filings")
def car_by_source(spark, sf):
    """Mean abnormal return in percent with the half width of its normal interval, and the share of rises."""
    g = research.unpivoted(spark, sf).where("car is not null").groupBy("source_type", "win")
    return g.agg(F.count("car").alias("n"), F.round(F.avg("car") * 100, 2).alias("mean_pct"), F.round(1.96 * F.stddev_samp("car") / F.sqrt(F.count("car")) * 100, 2).alias("half_width_pct"), F.round(F.avg((F.col("car") > 0).cast("double")), 4).alias("share_up")).where("n >= 2").drop("n")


# Curves and calendars


@plan("cumulative_growth", f"""WITH {P} SELECT symbol, d, round(exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY symbol ORDER BY d)), 6) AS growth FROM p""", "bars")
def cumulative_growth(spark, sf):
    """Running product of 1 + r."""
    w = X.series()
    return indicators.priced(spark, sf).select("symbol", "d", r6(F.exp(F.sum(F.ln(1 + F.coalesce("ret", F.lit(0.0)))).over(w)), "growth"))


@plan("trade_equity", f"""{books.EDGE} SELECT ticker, exit, round(10000 + sum(sum(pnl)) OVER (PARTITION BY ticker ORDER BY exit), 2) AS equity FROM t GROUP BY 1, 2""", "bars")
def trade_equity(spark, sf):
    """Capital and the results of all trades closed so far."""
    t = books.edge(spark, sf).groupBy("ticker", "exit").agg(F.sum("pnl").alias("pnl"))
    return t.select("ticker", "exit", F.round(10_000 + F.sum("pnl").over(W.partitionBy("ticker").orderBy("exit")), 2).alias("equity"))


@plan("benchmark_nav", f"SELECT d, round(close / first_value(close) OVER (ORDER BY d), 4) * {books.CAPITAL!r} AS nav FROM (SELECT max(d) AS d, arg_max(close, d) AS close FROM bench GROUP BY date_trunc('month', d))", "bench")
def benchmark_nav(spark, sf):
    """What the capital would be worth in the benchmark at every month's end."""
    m = A.bench_1d(spark, sf).groupBy(F.date_trunc("month", "d").alias("m")).agg(F.max("d").alias("d"), F.max_by("close", "d").alias("close"))
    return m.select("d", (F.round(F.col("close") / F.first("close").over(W.orderBy("d")), 4) * books.CAPITAL).alias("nav"))


@plan("resampled_curve", """WITH n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
    g AS (SELECT symbol, k, k * (n - 1) / 49.0::DOUBLE AS x FROM (SELECT DISTINCT symbol, n FROM n) CROSS JOIN range(50) r(k))
    SELECT g.symbol, k, round(a.close + (x - floor(x)) * (coalesce(b.close, a.close) - a.close), 6) AS value FROM g JOIN n a ON a.symbol = g.symbol AND a.i = floor(x) LEFT JOIN n b ON b.symbol = g.symbol AND b.i = floor(x) + 1""", "bars")
def resampled_curve(spark, sf):
    """Each series at 50 points of equal distance, linear in between."""
    w = W.partitionBy("symbol").orderBy("d")
    n = A.bars_1d(spark, sf).select("symbol", "close", F.lead("close").over(w).alias("next"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(W.partitionBy("symbol")).alias("n"))
    g = n.groupBy("symbol").agg(F.max("n").alias("n")).select("symbol", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("k"))
    g = g.withColumn("x", F.col("k") * (F.col("n") - 1) / F.lit(49.0)).withColumn("i", F.floor("x")).drop("n")
    part = F.col("x") - F.floor("x")
    return g.join(n, ["symbol", "i"]).select("symbol", "k", r6(F.col("close") + part * (F.coalesce("next", "close") - F.col("close")), "value"))


@plan("calendar_union", "SELECT d FROM bars UNION SELECT d FROM bench UNION SELECT filing_date FROM filings", "bars bench filings")
def calendar_union(spark, sf):
    """Every day that any store knows."""
    parts = [A.bars_1d(spark, sf).select("d"), A.bench_1d(spark, sf).select("d"), A.filings(spark, sf).select(F.col("filing_date").alias("d"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@plan("three_way_outer", """WITH t AS (SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n_trades FROM trades WHERE price > 50 GROUP BY 1, 2), f AS (SELECT symbol, CAST(ts AS DATE) AS day, max(rate) AS rate FROM funding WHERE rate > 0 GROUP BY 1, 2),
    a AS (SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n_alerts FROM trades WHERE price > 200 GROUP BY 1, 2)
    SELECT symbol, day, coalesce(n_trades, 0) AS n_trades, rate, coalesce(n_alerts, 0) AS n_alerts FROM t FULL JOIN f USING (symbol, day) FULL JOIN a USING (symbol, day)""", "trades funding")
def three_way_outer(spark, sf):
    """Trades, funding and alerts of each symbol and day; any of them can be missing."""
    t, day = A.trades(spark, sf), F.to_date("ts").alias("day")
    n = t.where("price > 50").groupBy("symbol", day).agg(F.count(F.lit(1)).alias("n_trades"))
    a = t.where("price > 200").groupBy("symbol", day).agg(F.count(F.lit(1)).alias("n_alerts"))
    f = A.funding(spark, sf).where("rate > 0").groupBy("symbol", day).agg(F.max("rate").alias("rate"))
    x = n.join(f, ["symbol", "day"], "full_outer").join(a, ["symbol", "day"], "full_outer")
    return x.select("symbol", "day", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "rate", F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"))


@plan("complete_days", "SELECT d, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)", "bars")
def complete_days(spark, sf):
    """Days on which every symbol has a bar; others are left out of a daily loop."""
    b = A.bars_1d(spark, sf)
    every = b.agg(F.count_distinct("symbol").alias("every"))
    return b.groupBy("d").agg(F.count(F.lit(1)).alias("n")).join(every, F.col("n") == F.col("every")).select("d", "n")


@plan("trim_trailing", "SELECT symbol, d, round(close, 6) AS close FROM bars JOIN (SELECT symbol, max(d) AS last FROM bars GROUP BY 1) USING (symbol) WHERE d > last - 365", "bars")
def trim_trailing(spark, sf):
    """What a store keeps of each symbol: the year up to its last day."""
    last = F.max("d").over(W.partitionBy("symbol"))
    return A.bars_1d(spark, sf).withColumn("last", last).where(F.date_diff("last", "d") < 365).select("symbol", "d", r6(F.col("close"), "close"))


@plan("top_params", f"{books.GRID_RUN} SELECT symbol, fast, slow, sharpe, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC NULLS LAST, fast, slow) AS rank FROM o) WHERE rank <= 3", "bars")
def top_params(spark, sf):
    """The three best parameter sets of each symbol; those without a Sharpe ratio come last."""
    w = W.partitionBy("symbol").orderBy(F.col("sharpe").desc_nulls_last(), "fast", "slow")
    return books.grid(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("symbol", "fast", "slow", "sharpe", "rank")


# Orders, alerts and text


@plan("symbol_normalise", r"SELECT DISTINCT p_name, upper(split_part(regexp_replace(p_name, ':.*$', ''), ' ', 1)) AS base FROM part")
def symbol_normalise(spark, sf):
    """Base asset of a pair's name: what stands before a colon, then before the first separator."""
    plain = F.regexp_replace("p_name", ":.*$", "")
    return table(spark, sf, "part").select("p_name", F.upper(F.split_part(plain, F.lit(" "), F.lit(1))).alias("base")).distinct()


@plan("order_lifecycle", f"""{stream.ORDER_STATES} SELECT account, status, count(*) AS n_orders, sum(filled) AS filled, max(opened) AS last_order, sum(n_changes)::BIGINT AS n_changes FROM orders_now GROUP BY 1, 2""", "order_log")
def order_lifecycle(spark, sf):
    """How the recorded orders of each account stand: their number, what was filled and the newest, by status."""
    g = stream.order_states_now(spark, sf).groupBy("account", "status")
    return g.agg(F.count(F.lit(1)).alias("n_orders"), F.sum("filled").alias("filled"), F.max("opened").alias("last_order"), F.sum("n_changes").alias("n_changes"))


@plan("signal_targets", f"""{indicators.CROSS}, a AS (SELECT *, count(*) FILTER (action <> 'hold') OVER (PARTITION BY symbol ORDER BY d) AS g FROM x),
    v AS (SELECT symbol, d, action, coalesce(CASE first_value(action) OVER (PARTITION BY symbol, g ORDER BY d) WHEN 'buy' THEN 1 WHEN 'sell' THEN 0 END, 0) AS target FROM a)
    SELECT symbol, d, action, target, target - coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY d), 0) AS order_qty FROM v""", "bars")
def signal_targets(spark, sf):
    """Target position after each crossing (a hold keeps it) and the order that leads from the last target to it."""
    w = W.partitionBy("symbol").orderBy("d")
    said = F.when(F.col("action") == "buy", 1).when(F.col("action") == "sell", 0)
    t = indicators.ema_cross(spark, sf).withColumn("target", F.coalesce(F.last(said, ignorenulls=True).over(w), F.lit(0)))
    return t.select("symbol", "d", "action", "target", (F.col("target") - F.coalesce(F.lag("target").over(w), F.lit(0))).alias("order_qty"))


@plan("alert_list", """WITH l AS (SELECT user_id, arg_max(symbol, (ts, trade_id)) AS action, max(ts) AS log_ts FROM trades WHERE symbol IN ('error', 'signup') GROUP BY 1),
    a AS (SELECT trade_id, symbol, CASE WHEN price > 250 THEN 'critical' WHEN price > 150 THEN 'warning' ELSE 'info' END AS severity, coalesce(action = 'error' AND log_ts >= ts, false) AS acknowledged FROM trades LEFT JOIN l USING (user_id) WHERE price > 100)
    SELECT *, count(*) FILTER (NOT acknowledged) OVER (PARTITION BY symbol) AS unacknowledged FROM a""", "trades")
def alert_list(spark, sf):
    """Alerts by severity with what the log of acknowledgements says of them, and how many of the symbol's are open."""
    p, t = F.col("price"), A.trades(spark, sf)
    action = F.when(F.col("symbol") == "error", "ack").when(F.col("symbol") == "signup", "reopen")
    log = t.select("user_id", F.col("ts").alias("log_ts"), F.col("trade_id").alias("log_seq"), action.alias("action")).where("action is not null")
    severity = F.when(p > 250, "critical").when(p > 150, "warning").otherwise("info")
    x = alerts.acknowledged(t.where("price > 100").withColumn("severity", severity), log, ["user_id"])
    return x.select("trade_id", "symbol", "severity", "acknowledged", F.count_if(~F.col("acknowledged")).over(W.partitionBy("symbol")).alias("unacknowledged"))


@plan("position_lines", """WITH g AS (SELECT symbol, round(sum(amount), 2) AS v, round(sum(price * amount) / nullif(sum(amount), 0), 2) AS a FROM trades WHERE side = 'buy' GROUP BY 1)
    SELECT symbol, symbol || ': ' || printf('%.2f', v) || ' @ ' || printf('%.2f', a) AS line FROM g""", "trades")
def position_lines(spark, sf):
    """One line of text for each bought position."""
    g = A.trades(spark, sf).where("side = 'buy'").groupBy("symbol").agg(F.round(F.sum("amount"), 2).alias("v"), F.round(F.try_divide(F.sum(F.col("price") * F.col("amount")), F.sum("amount")), 2).alias("a"))
    return g.select("symbol", F.format_string("%s: %.2f @ %.2f", "symbol", "v", "a").alias("line"))


@plan("market_fallback", """WITH k AS (SELECT ticker, report_period, bvps FROM fundamentals WHERE filing_date <= DATE '1996-06-30'), f AS (SELECT ticker, bvps AS facts FROM k WHERE report_period = DATE '1996-01-01'), m AS (SELECT ticker, arg_max(bvps, report_period) AS metric FROM k GROUP BY 1)
    SELECT s_suppkey AS ticker, round(coalesce(facts, metric), 6) AS book_value, CASE WHEN facts IS NOT NULL THEN 'facts' WHEN metric IS NOT NULL THEN 'metrics' ELSE 'none' END AS origin FROM supplier LEFT JOIN f ON f.ticker = s_suppkey LEFT JOIN m ON m.ticker = s_suppkey""", "fundamentals")
def market_fallback(spark, sf):
    """A value with a chain of fallbacks, all as known on a date: the facts of its last closed quarter, else the newest metric, else nothing."""
    known = A.fundamentals(spark, sf).where("filing_date <= date'1996-06-30'")
    facts = known.where("report_period = date'1996-01-01'").select("ticker", F.col("bvps").alias("facts"))
    metric = known.groupBy("ticker").agg(F.max_by("bvps", "report_period").alias("metric"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker")).join(facts, "ticker", "left").join(metric, "ticker", "left")
    origin = F.when(F.col("facts").isNotNull(), "facts").when(F.col("metric").isNotNull(), "metrics").otherwise("none")
    return s.select("ticker", r6(F.coalesce("facts", "metric"), "book_value"), origin.alias("origin"))


@plan("filings_range", """SELECT ticker, filing_id, filing_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, filing_id) AS n FROM filings WHERE filing_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') WHERE n <= 10""", "filings")
def filings_range(spark, sf):
    """The newest ten filings of each ticker within a closed range of filing dates."""
    f = A.filings(spark, sf).where("filing_date between date'1996-01-01' and date'1996-12-31'")
    return joins.latest_per_key(f, ["ticker"], [F.desc("filing_date"), F.col("filing_id")], 10).select("ticker", "filing_id", "filing_date")


@plan("unrealised", """WITH l AS (SELECT symbol, arg_max(price, (ts, trade_id)) AS mark FROM trades GROUP BY 1), p AS (SELECT symbol, side, sum(amount) AS q, sum(price * amount) / nullif(sum(amount), 0) AS entry FROM trades GROUP BY 1, 2)
    SELECT symbol, round(sum(CASE WHEN side = 'buy' THEN q * (mark - entry) ELSE q * (entry - mark) END), 4) AS pnl, round(sum(q * entry / 5), 4) AS margin FROM p JOIN l USING (symbol) GROUP BY 1""", "trades")
def unrealised(spark, sf):
    """Result of the open positions at the last price, and the margin they lock at five times leverage."""
    t = A.trades(spark, sf)
    mark = t.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "trade_id")).alias("mark"))
    p = t.groupBy("symbol", "side").agg(F.sum("amount").alias("q"), F.try_divide(F.sum(F.col("price") * F.col("amount")), F.sum("amount")).alias("entry")).join(mark, "symbol")
    gain = F.col("q") * (F.col("mark") - F.col("entry"))
    return p.groupBy("symbol").agg(F.round(F.sum(F.when(F.col("side") == "buy", gain).otherwise(-gain)), 4).alias("pnl"), F.round(F.sum(F.col("q") * F.col("entry") / 5), 4).alias("margin"))


@plan("ema_sized", f"""{indicators.CROSS} SELECT symbol, d, trunc(100000 * 0.95 / close)::BIGINT AS shares, round(floor(round(100000 * 0.95 / close / 0.001, 6)) * 0.001, 8) AS lots FROM x JOIN bars USING (symbol, d) WHERE action = 'buy'""", "bars")
def ema_sized(spark, sf):
    """Sizes of the buys at a crossing: whole shares, and multiples of the smallest lot for crypto assets."""
    c = F.col("close")
    x = indicators.ema_cross(spark, sf).where("action = 'buy'").join(A.bars_1d(spark, sf).select("symbol", "d", "close"), ["symbol", "d"])
    return x.select("symbol", "d", (100_000 * 0.95 / c).cast("long").alias("shares"), F.round(F.floor(F.round(100_000 * 0.95 / c / 0.001, 6)) * 0.001, 8).alias("lots"))
