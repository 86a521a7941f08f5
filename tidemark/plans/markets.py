"""Plans over all markets at once: anomaly windows, signal drivers with their gaps, plug-in models, the memo."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import joins, memo, models, portfolio, runs
from tidemark.plans import books, indicators, market, reports
from tidemark.plans.stream import folder
from tidemark.sources import adapters as A
from tidemark.sources.adapters import with_views

QUERIES, SQL = {}, {}


def plan(name, sql=None, views="trades"):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_views(views, sql) if views else sql
        return fn

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


# Anomalies of all markets and what two assets did around them

#: Ticks that a market must have, and the assets whose candles are looked at.
LEAST_TICKS, ASSETS = 25, ("purchase", "click")
HOUR = 3_600_000_000
ZOOM = ("2024-01-10", "2024-01-17")


def candles(ticks):
    """Hourly candles with the range within the hour, and running sums of it."""
    k = F.struct("ts", "trade_id")
    g = ticks.where(F.col("symbol").isin(*ASSETS)).groupBy(F.col("symbol").alias("asset"), F.date_trunc("hour", "ts").alias("ts"))
    g = g.agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"))
    g = g.withColumn("range", F.try_divide(F.col("high") - F.col("low"), "open") * 100)
    w = W.partitionBy("asset").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return g.select("asset", F.unix_micros("ts").alias("at"), "close", "range", F.sum(F.coalesce("range", F.lit(0.0))).over(w).alias("total"), F.count("range").over(w).alias("n"))


def anomalies(ticks, limit: float):
    """Jumps of a market's probability: its change in rolling standard deviations of the last 20 (5 at least), over the limit."""
    w = W.partitionBy("token_id").orderBy("ts", "trade_id")
    x = ticks.withColumn("dp", F.col("p") - F.lag("p").over(w)).withColumn("ticks", F.count(F.lit(1)).over(W.partitionBy("token_id")))
    x = x.withColumn("z", X.z_score(F.col("dp"), w, 20, 5)).where(F.col("ticks") >= LEAST_TICKS)
    return x.where(F.abs("z") > limit).select("token_id", "trade_id", "ts", "z", F.when(F.col("dp") > 0, "up").otherwise("down").alias("direction"))


def around(events, bars, hours: int, horizons: tuple[int, ...]):
    """Mean range in the hours before and after each event, and returns over the horizons, for each asset.

    One as-of join: every event asks for the running sums at the ends of its windows and for
    the closes at its horizons.
    """
    ends = {"pre0": (-hours, True), "pre1": (0, True), "post0": (0, False), "post1": (hours, False), **{f"h{h}": (h, False) for h in horizons}}
    asks = F.array(*[F.struct(F.lit(name).alias("name"), (F.unix_micros("ts") + h * HOUR - (1 if before else 0)).alias("at")) for name, (h, before) in ends.items()])
    probes = events.withColumn("asset", F.explode(F.array(*[F.lit(a) for a in ASSETS]))).withColumn("ask", F.explode(asks)).select("token_id", "trade_id", "asset", "ask.name", "ask.at")
    j = joins.asof_join(probes, bars, "asset", "at", ["total", "n", "close"], span=24 * HOUR)
    g = j.groupBy("token_id", "trade_id", "asset").agg(*[F.max(F.when(F.col("name") == name, F.struct("total", "n", "close"))).alias(name) for name in ends])
    zero = lambda c, f: F.coalesce(F.col(f"{c}.{f}"), F.lit(0))

    def mean(a: str, b: str):
        return F.try_divide(zero(b, "total") - zero(a, "total"), zero(b, "n") - zero(a, "n"))

    base = F.col("post0.close")
    returns = [(F.try_divide(F.col(f"h{h}.close") - base, base) * 100).alias(f"ret_{h}h") for h in horizons]
    return g.select("token_id", "trade_id", "asset", mean("pre0", "pre1").alias("pre"), mean("post0", "post1").alias("post"), *returns)


def market_ticks(spark, sf):
    return A.trades(spark, sf).select(F.col("user_id").alias("token_id"), "trade_id", "ts", F.least(F.col("price") / 500, F.lit(1.0)).alias("p"))


def windows_sql(limit: float, hours: int, horizons: tuple[int, ...]) -> str:
    close = lambda h: f"(SELECT arg_max(close, c.ts) FROM c WHERE c.asset = e.asset AND c.ts <= e.ts + INTERVAL {h} HOUR)"
    returns = ", ".join(f"({close(h)} - {close(0)}) / nullif({close(0)}, 0) * 100 AS ret_{h}h" for h in horizons)
    return f"""c AS MATERIALIZED (SELECT *, (high - low) / nullif(open, 0) * 100 AS range FROM (SELECT symbol AS asset, date_trunc('hour', ts) AS ts, arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, trade_id)) AS close FROM trades WHERE symbol IN {ASSETS} GROUP BY 1, 2)),
    t AS (SELECT user_id AS token_id, trade_id, ts, least(price / 500, 1.0) AS p FROM trades), d AS (SELECT *, p - lag(p) OVER (PARTITION BY token_id ORDER BY ts, trade_id) AS dp, count(*) OVER (PARTITION BY token_id) AS ticks FROM t),
    z AS (SELECT *, CASE WHEN count(dp) OVER w >= 5 THEN (dp - avg(dp) OVER w) / (stddev_samp(dp) OVER w + 1e-9) END AS z FROM d WINDOW w AS (PARTITION BY token_id ORDER BY ts, trade_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    e AS MATERIALIZED (SELECT token_id, trade_id, ts, z, CASE WHEN dp > 0 THEN 'up' ELSE 'down' END AS direction, unnest({list(ASSETS)}) AS asset FROM z WHERE ticks >= {LEAST_TICKS} AND abs(z) > {limit}),
    win AS MATERIALIZED (SELECT e.*, (SELECT avg(range) FROM c WHERE c.asset = e.asset AND c.ts >= e.ts - INTERVAL {hours} HOUR AND c.ts < e.ts) AS pre, (SELECT avg(range) FROM c WHERE c.asset = e.asset AND c.ts > e.ts AND c.ts <= e.ts + INTERVAL {hours} HOUR) AS post, {returns} FROM e)"""


@plan("market_top_events", f"""WITH {windows_sql(2.0, 4, (1, 2, 4))}, r AS (SELECT *, row_number() OVER (PARTITION BY token_id, asset ORDER BY round(abs(z), 6) DESC, trade_id) AS place FROM win)
    SELECT token_id, asset, place, trade_id, direction, round(z, 5) AS z, round(pre, 5) AS pre, round(post, 5) AS post, round(ret_1h, 4) AS ret_1h, round(ret_2h, 4) AS ret_2h, round(ret_4h, 4) AS ret_4h FROM r WHERE place <= 15""")
def market_top_events(spark, sf):
    """The 15 largest jumps of every market with enough ticks, and what both assets did in the four hours around."""
    e = anomalies(market_ticks(spark, sf), 2.0)
    place = F.row_number().over(W.partitionBy("token_id").orderBy(F.round(F.abs("z"), 6).desc(), "trade_id"))
    top = e.withColumn("place", place).where("place <= 15")
    x = around(top, candles(A.trades(spark, sf)), 4, (1, 2, 4)).join(top.select("token_id", "trade_id", "place", "direction", "z"), ["token_id", "trade_id"])
    return x.select("token_id", "asset", "place", "trade_id", "direction", *[F.round(c, 5).alias(c) for c in ("z", "pre", "post")], *[F.round(f"ret_{h}h", 4).alias(f"ret_{h}h") for h in (1, 2, 4)])


@plan("market_zoom_report", f"""WITH {windows_sql(1.5, 8, (8,))}, f AS (SELECT *, ts BETWEEN TIMESTAMP '{ZOOM[0]}' AND TIMESTAMP '{ZOOM[1]}' AS zoom FROM win), base AS (SELECT asset, avg(range) AS baseline FROM c GROUP BY 1)
    SELECT asset, count(*) AS n, count(*) FILTER (direction = 'up') AS n_up, count(*) FILTER (direction = 'down') AS n_down, count(*) FILTER (zoom) AS n_zoom, round(avg(post), 4) AS post, round(any_value(baseline), 4) AS baseline,
      round(avg(ret_8h) FILTER (direction = 'up'), 4) AS up_8h, round(avg(ret_8h) FILTER (direction = 'down'), 4) AS down_8h, round(avg(post) FILTER (zoom), 4) AS zoom_post, round(avg(ret_8h) FILTER (zoom), 4) AS zoom_8h FROM f JOIN base USING (asset) GROUP BY 1""")
def market_zoom_report(spark, sf):
    """All jumps over 1.5 with eight hours around them: by direction, within a closer period, and against all hours."""
    e = anomalies(market_ticks(spark, sf), 1.5)
    bars = candles(A.trades(spark, sf))
    zoom = F.col("ts").between(*[F.expr(f"timestamp'{z}'") for z in ZOOM])
    x = around(e, bars, 8, (8,)).join(e.select("token_id", "trade_id", "direction", zoom.alias("zoom")), ["token_id", "trade_id"])
    base = bars.groupBy("asset").agg(F.avg("range").alias("baseline"))
    up, z = F.col("direction") == "up", F.col("zoom")
    mean = lambda c, when, name: F.round(F.avg(F.when(when, F.col(c))), 4).alias(name)
    g = x.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(up).alias("n_up"), F.count_if(~up).alias("n_down"), F.count_if(z).alias("n_zoom"), F.round(F.avg("post"), 4).alias("post"),
        mean("ret_8h", up, "up_8h"), mean("ret_8h", ~up, "down_8h"), mean("post", z, "zoom_post"), mean("ret_8h", z, "zoom_8h"),
    )
    return g.join(base, "asset").withColumn("baseline", F.round("baseline", 4))


# Signal drivers: one record for every symbol asked for, available or not

ASKED = ("click", "purchase", "signup", "view:USDT", "nothing/USDT:USDT")
NOW = "2024-01-20 12:00:00"


def base_symbol(c):
    """The store's name of a symbol: without the settlement after a colon and the quote after a slash."""
    return F.split_part(F.split_part(c, F.lit(":"), F.lit(1)), F.lit("/"), F.lit(1))


@plan("ob_signal_records", f"""WITH {market.FLOW.replace("date_trunc('day', ts)", f"TIMESTAMP '{NOW}'").replace("FROM trades GROUP BY", f"FROM trades WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{NOW}' GROUP BY")},
    asked AS (SELECT unnest({list(ASKED)}) AS symbol), newest AS (SELECT symbol AS base, max(ts) AS last FROM trades WHERE ts < TIMESTAMP '{NOW}' GROUP BY 1),
    j AS (SELECT a.symbol, coalesce(l.last >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY, false) AS available, f.n, f.x, f.big FROM asked a LEFT JOIN newest l ON l.base = split_part(split_part(a.symbol, ':', 1), '/', 1) LEFT JOIN f ON f.symbol = split_part(split_part(a.symbol, ':', 1), '/', 1))
    SELECT symbol, available AS data_available, coalesce(n, 0) AS trade_count, CASE WHEN n >= 20 AND x > 0.1 THEN 'bullish' WHEN n >= 20 AND x < -0.1 THEN 'bearish' ELSE 'neutral' END AS flow_signal,
      CASE WHEN n >= 20 THEN CASE WHEN abs(x) > 0.1 THEN least(floor(round(300 * abs(x), 6)), 80) ELSE 20 END ELSE 0 END::BIGINT AS flow_confidence FROM j""")
def ob_signal_records(spark, sf):
    """The trade-flow signal of each symbol asked for, over the last day before a time; neutral with 0 where there is no data or too little."""
    now = F.expr(f"timestamp'{NOW}'")
    t = A.trades(spark, sf).where(F.col("ts") < now)
    v, recent = F.col("price") * F.col("amount"), F.col("ts") >= now - F.expr("interval 1 day")
    g = t.groupBy(F.col("symbol").alias("base")).agg(F.max("ts").alias("last"), F.count_if(recent).alias("n"), F.try_divide(F.sum(F.when(recent & (F.col("side") == "buy"), v)), F.sum(F.when(recent, v))).alias("share"))
    asked = spark.createDataFrame([(s,) for s in ASKED], "symbol string").withColumn("base", base_symbol(F.col("symbol")))
    x = asked.join(g, "base", "left").withColumn("x", F.col("share") - 0.5).withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= 20
    signal = F.when(enough, market.three_way("x", 0.1)).otherwise("neutral")
    conf = F.when(enough, F.coalesce(market.bounded_confidence("x", 0.1, 300, 80, 20), F.lit(20))).otherwise(0)
    return x.select("symbol", F.coalesce(F.col("last") >= now - F.expr("interval 1 day"), F.lit(False)).alias("data_available"), F.col("n").alias("trade_count"), signal.alias("flow_signal"), conf.cast("long").alias("flow_confidence"))


@plan("json_ensemble", f"{indicators.SQL['crypto_ensemble']} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1", "")
def json_ensemble(spark, sf):
    """The newest ensemble signal of each symbol from bars in JSON files, as an offline run has them."""
    path = folder(spark)
    A.bars_1d(spark, sf).write.json(path)
    bars = spark.read.schema("symbol string, d date, open double, high double, low double, close double, volume double").json(path)
    x = indicators.technical_signal(indicators.technical_frame(bars), indicators.CRYPTO_WEIGHTS, 63)
    return joins.latest_per_key(x, ["symbol"], [F.desc("d")])


@plan("collector_records", f"""WITH n AS (SELECT symbol, max(ts) AS ts, arg_max(price, (ts, trade_id)) AS last, max(price) FILTER (side = 'buy' AND ts > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS bid, min(price) FILTER (side = 'sell' AND ts > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS ask,
      coalesce(sum(amount) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 1 DAY), 0) AS volume_24h FROM trades WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1),
    c AS (SELECT symbol, ts::DATE AS day, arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, trade_id)) AS close, sum(amount) AS volume FROM trades WHERE ts < TIMESTAMP '{NOW}'::DATE GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1)
    SELECT n.*, day, open, high, low, close, volume FROM n LEFT JOIN c USING (symbol)""")
def collector_records(spark, sf):
    """What a collector stores of each symbol at a time: the ticker (last, best bid and ask of the hour, volume of the day) and the last completed daily candle."""
    now = F.expr(f"timestamp'{NOW}'")
    k, side = F.struct("ts", "trade_id"), F.col("side")
    t = A.trades(spark, sf).where(F.col("ts") <= now)
    hour, day = F.col("ts") > now - F.expr("interval 1 hour"), F.col("ts") > now - F.expr("interval 1 day")
    ticker = t.groupBy("symbol").agg(
        F.max("ts").cast("timestamp_ntz").alias("ts"), F.max_by("price", k).alias("last"), F.max(F.when(hour & (side == "buy"), F.col("price"))).alias("bid"),
        F.min(F.when(hour & (side == "sell"), F.col("price"))).alias("ask"), F.coalesce(F.sum(F.when(day, F.col("amount"))), F.lit(0.0)).alias("volume_24h"),
    )
    done = t.where(F.col("ts") < F.date_trunc("day", now)).groupBy("symbol", F.to_date("ts").alias("day"))
    candles_ = done.agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.sum("amount").alias("volume"))
    return ticker.join(joins.latest_per_key(candles_, ["symbol"], [F.desc("day")]), "symbol", "left")


@plan("workflow_records", f"""WITH RECURSIVE asked AS (SELECT unnest(['AF', 'NO', 'RF:USDT', 'XX/USDT']) AS symbol), t AS ({indicators.SQL['crypto_ensemble']}),
    last AS (SELECT symbol, signal, score FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1), c AS ({market.SQL['onchain_combined']}), chain AS (SELECT asset, signal AS chain_signal, confidence AS chain_confidence FROM c QUALIFY row_number() OVER (PARTITION BY asset ORDER BY d DESC) = 1),
    r AS ({reports.SQL['crypto_risk']}), risk AS (SELECT symbol, size FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1),
    j AS (SELECT a.symbol, l.symbol IS NOT NULL AS data_available, coalesce(signal, 'neutral') AS technical, coalesce(round(abs(score) * 100), 0)::INT AS technical_confidence, coalesce(chain_signal, 'neutral') AS chain, coalesce(chain_confidence, 0) AS chain_confidence, coalesce(size, 0) AS most FROM asked a
      LEFT JOIN last l ON l.symbol = split_part(split_part(a.symbol, ':', 1), '/', 1) LEFT JOIN chain ON asset = split_part(split_part(a.symbol, ':', 1), '/', 1) LEFT JOIN risk k ON k.symbol = split_part(split_part(a.symbol, ':', 1), '/', 1)),
    v AS (SELECT *, (0.6 * technical_confidence * CASE technical WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END + 0.4 * chain_confidence * CASE chain WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END) / 100 AS vote FROM j)
    SELECT symbol, data_available, technical, technical_confidence, chain, chain_confidence, CASE WHEN vote > 0.05 THEN 'buy' WHEN vote < -0.05 THEN 'sell' ELSE 'hold' END AS action, round(abs(vote) * most, 4) AS quantity FROM v""", "")
def workflow_records(spark, sf):
    """One decision for each symbol asked for, from its technical signal, its chain signal and its risk size; what is not there is neutral, 0 and no quantity."""
    newest = lambda df, key, d: joins.latest_per_key(df, [key], [F.desc(d)]).withColumnRenamed(key, "base")
    technical = newest(indicators.crypto(spark, sf), "symbol", "d").select("base", "signal", "score")
    chain = newest(market.onchain(spark, sf), "asset", "d").select("base", F.col("signal").alias("chain_signal"), F.col("confidence").alias("chain_conf"))
    risk = newest(reports.crypto_risk(spark, sf), "symbol", "d").select("base", "size")
    asked = spark.createDataFrame([(s,) for s in ("AF", "NO", "RF:USDT", "XX/USDT")], "symbol string").withColumn("base", base_symbol(F.col("symbol")))
    x = asked.join(technical, "base", "left").join(chain, "base", "left").join(risk, "base", "left")
    zero = F.lit(0)
    x = x.select(
        "symbol", F.col("signal").isNotNull().alias("data_available"), F.coalesce("signal", F.lit("neutral")).alias("technical"), F.coalesce(F.round(F.abs("score") * 100), zero).cast("int").alias("technical_confidence"),
        F.coalesce("chain_signal", F.lit("neutral")).alias("chain"), F.coalesce("chain_conf", zero).alias("chain_confidence"), F.coalesce("size", zero).alias("most"),
    )
    sign = lambda c: F.when(F.col(c) == "bullish", 1).when(F.col(c) == "bearish", -1).otherwise(0)
    x = x.withColumn("vote", (0.6 * F.col("technical_confidence") * sign("technical") + 0.4 * F.col("chain_confidence") * sign("chain")) / 100)
    action = F.when(F.col("vote") > 0.05, "buy").when(F.col("vote") < -0.05, "sell").otherwise("hold")
    return x.select("symbol", "data_available", "technical", "technical_confidence", "chain", "chain_confidence", action.alias("action"), F.round(F.abs("vote") * F.col("most"), 4).alias("quantity"))


# Models as plug-ins

REGISTRY = models.Registry()
AS_OF = dt.date(1996, 6, 28)


@REGISTRY.model("pead", "events", 1.0)
def pead_model(pit):
    """Drift after earnings: the last surprise, if it was filed within 4 days; others have no view. Filings without a surprise do not count."""
    f = pit.table("filings").where("surprise in ('BEAT', 'MISS') and surprise is not null and datediff(filing_date, report_period) between 0 and 44")
    last = f.groupBy("ticker").agg(F.max("filing_date").alias("filed"), F.max_by("surprise", F.struct("filing_date", "report_period", "filing_id")).alias("surprise"))
    fresh = F.date_diff(F.lit(pit.as_of), "filed") <= 4
    return last.select(F.col("ticker").cast("string").alias("ticker"), F.when(fresh, F.when(F.col("surprise") == "BEAT", 1.0).otherwise(-1.0)).alias("value"))


@REGISTRY.model("drift", "trend", 2.0)
def drift_model(pit):
    """The sign and size of the change over the last 20 bars, a tenth being full conviction."""
    n = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("d")))
    b = pit.table("bars").select("symbol", "close", n.alias("n")).where("n <= 21")
    g = b.groupBy("symbol").agg(F.max(F.when(F.col("n") == 1, F.col("close"))).alias("now"), F.max(F.when(F.col("n") == 21, F.col("close"))).alias("then"))
    change = F.try_divide("now", "then") - 1
    return g.select(F.col("symbol").alias("ticker"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), change * 10)).alias("value"))


@REGISTRY.price_source("last_close")
def last_close(pit):
    return pit.table("bars").groupBy(F.col("symbol").alias("ticker")).agg(F.max_by("close", "d").alias("price"))


def known_on(spark, sf, day):
    """The tables that models may ask for, and their dates of becoming known."""
    return models.PointInTime(spark, day, {"bars": (A.bars_1d(spark, sf), "d"), "filings": (A.filings(spark, sf), "filing_date")})


VIEWED = f"""p AS (SELECT ticker::VARCHAR AS ticker, CASE WHEN DATE '{AS_OF}' - max(filing_date) <= 4 THEN CASE arg_max(surprise, (filing_date, report_period, filing_id)) WHEN 'BEAT' THEN 1.0 ELSE -1.0 END END::DOUBLE AS value FROM filings WHERE surprise IN ('BEAT', 'MISS') AND filing_date - report_period BETWEEN 0 AND 44 AND filing_date <= DATE '{AS_OF}' GROUP BY ticker),
    n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS n FROM bars WHERE d <= DATE '{AS_OF}'), t AS (SELECT symbol AS ticker, greatest(-1, least(1, (max(close) FILTER (n = 1) / nullif(max(close) FILTER (n = 21), 0) - 1) * 10)) AS value FROM n GROUP BY 1),
    v AS (SELECT 'events' AS strategy, ticker, value FROM p UNION ALL SELECT 'trend', ticker, value FROM t), w AS (SELECT strategy, ticker, coalesce(value, 0) AS conviction FROM v)"""


@plan("plugin_blend", f"WITH {VIEWED} SELECT strategy, ticker, round(conviction, 6) AS conviction, round(CASE WHEN sum(abs(conviction)) OVER s < 1e-9 THEN 0 ELSE conviction / sum(abs(conviction)) OVER s END, 6) AS weight FROM w WINDOW s AS (PARTITION BY strategy)", "bars filings")
def plugin_blend(spark, sf):
    """Registered models as of a date, blended by strategy."""
    b = portfolio.blend(REGISTRY.views(known_on(spark, sf, AS_OF)))
    return b.select("strategy", "ticker", r6(F.col("conviction"), "conviction"), r6(F.col("weight"), "weight"))


# The memo

ANSWER = """CASE WHEN ticker % 11 = 0 THEN 'no idea' WHEN n < 4 THEN NULL WHEN tax_rate > gross_margin THEN '{"signal": "bearish", "confidence": ' || (ticker % 90 + 5) || '}' WHEN ticker % 7 = 0 THEN '{"signal": "Neutral ", "confidence": 50}' ELSE '{"signal": "bullish", "confidence": ' || (ticker % 120) || '}' END"""


def analyst(misses):
    """Stands for a costly model: answers requests in batches; some answers cannot be read, some do not come."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.ticker % 11 == 0:
                    out.append("no idea")
                elif r.n < 4:
                    out.append(None)
                elif r.tax_rate > r.gross_margin:
                    out.append('{"signal": "bearish", "confidence": %d}' % (r.ticker % 90 + 5))
                else:
                    out.append('{"signal": "Neutral ", "confidence": 50}' if r.ticker % 7 == 0 else '{"signal": "bullish", "confidence": %d}' % (r.ticker % 120))
            yield pd.DataFrame({"key": pdf["key"], "body": out})

    return misses.mapInPandas(run, "key string, body string")


@plan("memo_signals", f"""WITH s AS (SELECT ticker, count(*) AS n, round(avg(gross_margin), 4) AS gross_margin, round(avg(tax_rate), 4) AS tax_rate FROM fundamentals WHERE filing_date <= DATE '1996-06-30' GROUP BY 1),
    a AS (SELECT ticker, {ANSWER} AS body FROM s), p AS (SELECT ticker, CASE WHEN body LIKE '{{%' THEN lower(trim(json_extract_string(body, '$.signal'))) END AS signal, CASE WHEN body LIKE '{{%' THEN TRY_CAST(json_extract_string(body, '$.confidence') AS DOUBLE) END AS c FROM a),
    v AS (SELECT ticker, CASE WHEN c BETWEEN 0 AND 100 THEN CASE signal WHEN 'bullish' THEN c / 100 WHEN 'bearish' THEN -c / 100 WHEN 'neutral' THEN 0 END END AS value FROM p)
    SELECT ticker, round(coalesce(value, 0), 6) AS value, value IS NULL AS abstained, (SELECT count(*) FROM s WHERE n < 4 AND ticker % 11 <> 0) AS asked_again FROM v""", "fundamentals")
def memo_signals(spark, sf):
    """Signals from answers kept in a memo: all requests are asked twice, and the second time only those without an answer are computed."""
    f = A.fundamentals(spark, sf).where("filing_date <= date'1996-06-30'")
    snapshots = f.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gross_margin"), 4).alias("gross_margin"), F.round(F.avg("tax_rate"), 4).alias("tax_rate"))
    kept, columns = memo.Memo(spark, folder(spark)), ["ticker", "n", "gross_margin", "tax_rate"]
    answers = snapshots
    for _ in range(2):
        answers = kept.serve(answers.select(*columns), "outlook", columns, analyst)
    value, abstained = memo.signal_of(F.col("body"))
    return answers.select("ticker", r6(value, "value"), abstained.alias("abstained"), F.lit(kept.asked).cast("long").alias("asked_again"))


# Stored runs


@plan("run_pages", f"{books.GRID_RUN}, kept AS (SELECT md5(symbol || '|' || fast || '|' || slow) AS run_id, symbol, fast, slow, total_return, sharpe, TIMESTAMP '2024-01-01' + to_days(fast) + to_minutes(slow) AS created FROM o WHERE error IS NULL AND slow <> 89)"
      " SELECT run_id, CASE WHEN fast = 8 THEN 'fast ' || symbol ELSE symbol || ' ' || fast || '/' || slow END AS name, created, round(sharpe, 4) AS sharpe, round(total_return, 4) AS total_return FROM kept ORDER BY created DESC, run_id LIMIT 10 OFFSET 2", "bars")
def run_pages(spark, sf):
    """The second page of the stored runs of a grid search: all are saved (twice), some renamed, those with the slowest mean deleted."""
    g = books.grid(spark, sf).where("error is null")
    created = F.expr("timestamp'2024-01-01'") + F.make_dt_interval(F.col("fast"), F.lit(0), F.col("slow"))
    runs_ = g.select(
        F.md5(F.concat_ws("|", "symbol", "fast", "slow")).alias("run_id"), F.format_string("%s %d/%d", "symbol", "fast", "slow").alias("name"), created.alias("created"),
        F.to_json(F.struct("fast", "slow")).alias("params"), F.create_map(F.lit("sharpe"), "sharpe", F.lit("total_return"), "total_return").alias("metrics"), "symbol", "fast", "slow",
    )
    store = runs.RunStore(spark, folder(spark), 4)
    store.save(runs_)
    known = store.all().select("run_id", "name", F.from_json("params", "fast int, slow int").alias("p"))
    store.rename(known.where("p.fast = 8").select("run_id", F.concat(F.lit("fast "), F.split_part("name", F.lit(" "), F.lit(1))).alias("name")))
    store.delete(known.where("p.slow = 89"))
    store.save(runs_)
    p = store.page(2, 10)
    return p.select("run_id", "name", F.col("created").cast("timestamp_ntz").alias("created"), F.round(F.col("metrics")["sharpe"], 4).alias("sharpe"), F.round(F.col("metrics")["total_return"], 4).alias("total_return"))
