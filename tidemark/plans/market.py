"""Plans over stored market data: bars, stores, upserts and micro-structure."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import upsert
from tidemark.sources import adapters as A
from tidemark.sources.adapters import with_views

QUERIES, SQL = {}, {}


def plan(name: str, sql: str, views: str = ""):
    """Register a query and its oracle."""

    def add(fn):
        QUERIES[name] = fn
        SQL[name] = with_views(views, sql) if views else sql
        return fn

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


@plan("bars_daily", "SELECT symbol, d, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, volume FROM bars", "bars")
def bars_daily(spark, sf):
    return A.bars_1d(spark, sf).select("symbol", "d", *[r6(F.col(c), c) for c in ("open", "high", "low", "close")], "volume")


@plan("bars_hourly_ticks", """SELECT symbol, date_trunc('hour', ts) AS h, arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (ts, trade_id)) AS close, count(*) AS n, round(sum(price * amount) / nullif(sum(amount), 0), 6) AS vwap FROM trades GROUP BY 1, 2""", "trades")
def bars_hourly(spark, sf):
    x = A.trades(spark, sf)
    k = F.struct("ts", "trade_id")
    out = x.groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(
        F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.count(F.lit(1)).alias("n"), r6(F.try_divide(F.sum(F.col("price") * F.col("amount")), F.sum("amount")), "vwap")
    )
    return out.withColumn("h", F.col("h").cast("timestamp_ntz"))


@plan("coverage_ratio", """SELECT symbol, count(*) AS n_rows, greatest(1, date_diff('day', min(d), max(d))) AS expected,
    round(count(*) / greatest(1, date_diff('day', min(d), max(d))), 6) AS coverage, count(*) / greatest(1, date_diff('day', min(d), max(d))) < 0.95 AS backfill FROM bars GROUP BY 1""", "bars")
def coverage(spark, sf):
    days = F.greatest(F.lit(1), F.date_diff(F.max("d"), F.min("d"))).cast("long")
    g = A.bars_1d(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), days.alias("expected"))
    ratio = F.col("n_rows") / F.col("expected")
    return g.select("symbol", "n_rows", "expected", r6(ratio, "coverage"), (ratio < 0.95).alias("backfill"))


@plan("high_water_marks", "SELECT symbol, max(ts) AS last_ts, count(*) AS n_rows FROM trades GROUP BY 1", "trades")
def marks(spark, sf):
    return upsert.high_water(A.trades(spark, sf), ["symbol"], "ts").withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@plan("store_inventory", """SELECT 'bars' AS store, count(*) AS n_rows, CAST(max(d) AS VARCHAR) AS newest FROM bars
    UNION ALL SELECT 'trades', count(*), CAST(CAST(max(ts) AS DATE) AS VARCHAR) FROM trades UNION ALL SELECT 'funding', count(*), CAST(CAST(max(ts) AS DATE) AS VARCHAR) FROM funding
    UNION ALL SELECT 'filings', count(*), CAST(max(filing_date) AS VARCHAR) FROM filings""", "bars funding filings")
def inventory(spark, sf):
    parts = [(A.bars_1d, "bars", "d"), (A.trades, "trades", "ts"), (A.funding, "funding", "ts"), (A.filings, "filings", "filing_date")]
    out = [f(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.to_date(F.max(ts)).cast("string").alias("newest")).select(F.lit(n).alias("store"), "n_rows", "newest") for f, n, ts in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@plan("upsert_last_wins", """SELECT symbol, d, round(CASE WHEN d >= DATE '1998-01-01' THEN close * 1.01 ELSE close END, 6) AS close FROM bars""", "bars")
def upsert_last(spark, sf):
    b = A.bars_1d(spark, sf).select("symbol", "d", "close")
    new = b.where("d >= date'1998-01-01'").withColumn("close", F.col("close") * 1.01)
    return upsert.upsert_last(b, new, ["symbol", "d"]).select("symbol", "d", r6(F.col("close"), "close"))


@plan("insert_ignore_first_wins", """SELECT trade_id, symbol, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN price ELSE price + 1 END AS price FROM trades""", "trades")
def insert_ignore(spark, sf):
    """A second delivery of all trades, with other prices, onto a store that ends in the middle of the month."""
    t = A.trades(spark, sf).select("trade_id", "symbol", "price", "ts")
    old, new = t.where("ts < timestamp'2024-01-16'").drop("ts"), t.drop("ts").withColumn("price", F.col("price") + 1)
    return upsert.insert_ignore(old, new, ["trade_id"], [F.col("price")])


@plan("dedupe_tail", """SELECT symbol, d, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS n FROM bars) WHERE n <= 100""", "bars")
def dedupe_tail(spark, sf):
    return upsert.tail(A.bars_1d(spark, sf), ["symbol"], "d", 100).select("symbol", "d", r6(F.col("close"), "close"))


@plan("incremental_backfill", """SELECT trade_id, symbol, ts FROM trades t WHERE ts > (SELECT max(ts) FROM trades o WHERE o.symbol = t.symbol AND o.ts < TIMESTAMP '2024-01-20')""", "trades")
def incremental(spark, sf):
    t = A.trades(spark, sf)
    out = upsert.after_high_water(t, t.where("ts < timestamp'2024-01-20'"), ["symbol"], "ts")
    return out.select("trade_id", "symbol", F.col("ts").cast("timestamp_ntz").alias("ts"))


BOOK = """book AS (SELECT symbol, date_trunc('hour', ts) AS h, CASE WHEN side = 'buy' THEN 'bid' ELSE 'ask' END AS book_side, price, amount, trade_id,
    row_number() OVER (PARTITION BY symbol, date_trunc('hour', ts), side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END, trade_id) - 1 AS level FROM trades)"""


def exploded_book(spark, sf):
    """One row for each level of each side of the hourly books: bids from the highest, asks from the lowest price."""
    t = A.trades(spark, sf).withColumn("h", F.date_trunc("hour", "ts"))
    bid = F.col("side") == "buy"
    w = W.partitionBy("symbol", "h", "side").orderBy(F.when(bid, -F.col("price")).otherwise(F.col("price")), "trade_id")
    return t.select("symbol", "h", F.when(bid, "bid").otherwise("ask").alias("book_side"), (F.row_number().over(w) - 1).cast("long").alias("level"), "price", F.col("amount").alias("size"))


def nested_levels(books):
    """Books with nested levels (symbol, h, bids, asks: arrays of price and size) as one row for each level."""
    parts = [books.select("symbol", "h", F.lit(s).alias("book_side"), F.posexplode(c).alias("level", "l")) for s, c in (("bid", "bids"), ("ask", "asks"))]
    return parts[0].union(parts[1]).select("symbol", "h", "book_side", F.col("level").cast("long").alias("level"), "l.price", "l.size")


@plan("book_explode", f"WITH {BOOK} SELECT symbol, h, book_side, level, price, amount AS size FROM book", "trades")
def book_explode(spark, sf):
    return exploded_book(spark, sf).withColumn("h", F.col("h").cast("timestamp_ntz"))


@plan("book_latest_before", f"""WITH {BOOK}, m AS (SELECT symbol, max(h) AS h FROM book WHERE h < TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT symbol, h, book_side, level, price, amount AS size FROM book JOIN m USING (symbol, h)""", "trades")
def book_latest(spark, sf):
    b = exploded_book(spark, sf).where("h < timestamp'2024-01-15'")
    newest = F.max("h").over(W.partitionBy("symbol"))
    return b.withColumn("n", newest).where("h = n").drop("n").withColumn("h", F.col("h").cast("timestamp_ntz"))


IMB = "CASE WHEN b + a > 0 THEN (b - a) / (b + a) ELSE 0 END"


@plan("book_imbalance", f"""WITH {BOOK}, s AS (SELECT symbol, h, coalesce(sum(price * amount) FILTER (book_side = 'bid'), 0) AS b, coalesce(sum(price * amount) FILTER (book_side = 'ask'), 0) AS a FROM book GROUP BY 1, 2)
    SELECT symbol, h, round({IMB}, 6) AS imbalance, CASE WHEN {IMB} > 0.2 THEN 'bullish' WHEN {IMB} < -0.2 THEN 'bearish' ELSE 'neutral' END AS signal,
    CASE WHEN abs({IMB}) > 0.2 THEN least(CAST(floor(round(150 * abs({IMB}), 6)) AS BIGINT), 80) ELSE 20 END AS confidence FROM s""", "trades")
def imbalance(spark, sf):
    return imbalances(spark, sf).select("symbol", "h", r6(F.col("i"), "imbalance"), three_way("i", 0.2).alias("signal"), bounded_confidence("i", 0.2, 150, 80, 20).alias("confidence"))


def imbalances(spark, sf):
    """Imbalance of the notional of bids and asks of each symbol and hour."""
    v = F.col("price") * F.col("amount")
    g = A.trades(spark, sf).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"))
    g = g.agg(F.sum(F.when(F.col("side") == "buy", v).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("side") == "buy", 0.0).otherwise(v)).alias("a"))
    return g.select("symbol", "h", F.when(F.col("b") + F.col("a") > 0, (F.col("b") - F.col("a")) / (F.col("b") + F.col("a"))).otherwise(0.0).alias("i"))


def three_way(c: str, limit: float):
    return F.when(F.col(c) > limit, "bullish").when(F.col(c) < -limit, "bearish").otherwise("neutral")


def bounded_confidence(c: str, limit: float, factor: float, most: int, calm: int):
    grown = F.floor(F.round(factor * F.abs(F.col(c)), 6)).cast("long")
    return F.when(F.abs(F.col(c)) > limit, F.least(grown, F.lit(most))).otherwise(calm)


FLOW = """f AS (SELECT symbol, date_trunc('day', ts) AS day, count(*) AS n, sum(price * amount) FILTER (side = 'buy') / sum(price * amount) - 0.5 AS x,
    (coalesce(sum(price * amount) FILTER (side = 'buy' AND price * amount >= 500), 0) - coalesce(sum(price * amount) FILTER (side = 'sell' AND price * amount >= 500), 0))
      / nullif(sum(price * amount) FILTER (price * amount >= 500), 0) AS big FROM trades GROUP BY 1, 2)"""


def flow(spark, sf):
    """Daily trade flow of each symbol: share of buys less one half, and the bias of large orders (notional >= 500)."""
    t = A.trades(spark, sf).withColumn("v", F.col("price") * F.col("amount"))
    buy, large = F.col("side") == "buy", F.col("v") >= 500
    lb, ls = F.sum(F.when(buy & large, F.col("v")).otherwise(0.0)), F.sum(F.when(~buy & large, F.col("v")).otherwise(0.0))
    return t.groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.when(buy, F.col("v"))) / F.sum("v") - 0.5).alias("x"), F.when(F.sum(large.cast("int")) > 0, (lb - ls) / (lb + ls)).alias("big")
    )


@plan("trade_flow", f"WITH {FLOW} SELECT symbol, day, n, round(x + 0.5, 6) AS buy_fraction, CASE WHEN x > 0.1 THEN 'bullish' WHEN x < -0.1 THEN 'bearish' ELSE 'neutral' END AS signal, CASE WHEN abs(x) > 0.1 THEN least(CAST(floor(round(300 * abs(x), 6)) AS BIGINT), 80) ELSE 20 END AS confidence FROM f", "trades")
def trade_flow(spark, sf):
    return flow(spark, sf).select("symbol", "day", "n", r6(F.col("x") + 0.5, "buy_fraction"), three_way("x", 0.1).alias("signal"), F.coalesce(bounded_confidence("x", 0.1, 300, 80, 20), F.lit(20)).alias("confidence"))


@plan("large_order_bias", f"WITH {FLOW} SELECT symbol, day, round(big, 6) AS bias, CASE WHEN big > 0.3 THEN 'bullish' WHEN big < -0.3 THEN 'bearish' ELSE 'neutral' END AS signal, CASE WHEN abs(big) > 0.3 THEN least(CAST(floor(round(100 * abs(big), 6)) AS BIGINT), 70) ELSE 15 END AS confidence FROM f", "trades")
def large_orders(spark, sf):
    return flow(spark, sf).select("symbol", "day", r6(F.col("big"), "bias"), three_way("big", 0.3).alias("signal"), bounded_confidence("big", 0.3, 100, 70, 15).alias("confidence"))


MICRO = """i AS (SELECT symbol, date_trunc('day', h) AS day, arg_max(CASE WHEN b + a > 0 THEN (b - a) / (b + a) ELSE 0 END, h) AS x FROM (SELECT symbol, date_trunc('hour', ts) AS h,
      sum(CASE WHEN side = 'buy' THEN price * amount ELSE 0 END) AS b, sum(CASE WHEN side = 'buy' THEN 0 ELSE price * amount END) AS a FROM trades GROUP BY 1, 2) GROUP BY 1, 2),
    u AS (SELECT f.symbol, f.day, n, CASE WHEN i.x > 0.2 THEN 1 WHEN i.x < -0.2 THEN -1 ELSE 0 END AS s1, CASE WHEN abs(i.x) > 0.2 THEN least(floor(round(150 * abs(i.x), 6)), 80) ELSE 20 END AS c1,
      CASE WHEN f.x > 0.1 THEN 1 WHEN f.x < -0.1 THEN -1 ELSE 0 END AS s2, CASE WHEN n < 20 THEN 0 WHEN abs(f.x) > 0.1 THEN least(floor(round(300 * abs(f.x), 6)), 80) ELSE 20 END AS c2,
      CASE WHEN big > 0.3 THEN 1 WHEN big < -0.3 THEN -1 ELSE 0 END AS s3, CASE WHEN big IS NULL THEN 0 WHEN abs(big) > 0.3 THEN least(floor(round(100 * abs(big), 6)), 70) ELSE 15 END AS c3 FROM f JOIN i ON i.symbol = f.symbol AND i.day = f.day),
    w AS (SELECT *, CASE WHEN c1 > 0 THEN 0.4 ELSE 0 END::DOUBLE AS w1, CASE WHEN c2 > 0 THEN 0.4 ELSE 0 END::DOUBLE AS w2, CASE WHEN c3 > 0 THEN 0.2 ELSE 0 END::DOUBLE AS w3 FROM u),
    v AS (SELECT symbol, day, n, round((s1 * w1 + s2 * w2 + s3 * w3) / nullif(w1 + w2 + w3, 0), 9) AS score, (c1 * w1 + c2 * w2 + c3 * w3) / nullif(w1 + w2 + w3, 0) AS conf FROM w)"""


@plan("ob_combined", f"""WITH {FLOW}, {MICRO} SELECT symbol, day, round(score, 6) AS score, CASE WHEN score > 0.25 THEN 'bullish' WHEN score < -0.25 THEN 'bearish' ELSE 'neutral' END AS signal, coalesce(floor(round(conf, 6)), 0)::BIGINT AS confidence FROM v""", "trades")
def ob_combined(spark, sf):
    """Each day's last book, its trade flow and its large orders as one signal; too few trades leave the flow out."""
    from tidemark.operators import signals

    i = imbalances(spark, sf).groupBy("symbol", F.date_trunc("day", "h").alias("day")).agg(F.max_by("i", "h").alias("i"))
    x = flow(spark, sf).join(i, ["symbol", "day"])
    sign = lambda c, limit: F.when(F.col(c) > limit, 1).when(F.col(c) < -limit, -1).otherwise(0)
    parts = {
        "imbalance": (sign("i", 0.2), bounded_confidence("i", 0.2, 150, 80, 20)),
        "flow": (sign("x", 0.1), F.when(F.col("n") < 20, 0).otherwise(bounded_confidence("x", 0.1, 300, 80, 20))),
        "large": (sign("big", 0.3), F.when(F.col("big").isNull(), 0).otherwise(bounded_confidence("big", 0.3, 100, 70, 15))),
    }
    signal, confidence, score = signals.weighted_votes(parts, {"imbalance": 0.4, "flow": 0.4, "large": 0.2}, 0.25)
    return x.select("symbol", "day", r6(score, "score"), signal.alias("signal"), confidence.alias("confidence"))


@plan("eav_pivot", "SELECT asset, ts_ms, round(max(value) FILTER (metric = 'price'), 6) AS price, round(max(value) FILTER (metric = 'volume'), 6) AS volume, round(max(value) FILTER (metric = 'mcap'), 0) AS mcap FROM eav GROUP BY 1, 2", "eav")
def eav_pivot(spark, sf):
    p = A.metrics_eav(spark, sf).groupBy("asset", "ts_ms").pivot("metric", ["price", "volume", "mcap"]).agg(F.first("value"))
    return p.select("asset", "ts_ms", r6(F.col("price"), "price"), r6(F.col("volume"), "volume"), F.round("mcap", 0).alias("mcap"))


NVT = """w AS (SELECT symbol AS asset, d, mcap / avg(volume * close) OVER (PARTITION BY symbol ORDER BY d RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS nvt FROM capped)"""


def nvt(spark, sf):
    """Network value to transactions: capitalisation over the mean traded value of the last 90 days."""
    e = A.metrics_eav(spark, sf).groupBy("asset", "ts_ms").pivot("metric", ["price", "volume", "mcap"]).agg(F.first("value"))
    w = W.partitionBy("asset").orderBy("ts_ms").rangeBetween(-90 * 86_400_000, 0)
    day = F.to_date(F.timestamp_millis("ts_ms"))
    return e.select("asset", day.alias("d"), (F.col("mcap") / F.avg(F.col("volume") * F.col("price")).over(w)).alias("nvt"))


@plan("nvt_range_90d", f"WITH {NVT} SELECT asset, d, round(nvt, 6) AS nvt FROM w", "eav")
def nvt_range(spark, sf):
    return nvt(spark, sf).select("asset", "d", r6(F.col("nvt"), "nvt"))


CHAIN = f"""{NVT}, r AS (SELECT symbol AS asset, d, close / (sum(close * volume) OVER w / sum(volume) OVER w) AS mvrv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
    l AS (SELECT w.asset, w.d, CASE WHEN nvt > 150 THEN 'bearish' WHEN nvt < 40 THEN 'bullish' ELSE 'neutral' END AS signal,
      CASE WHEN nvt > 150 THEN least(CAST(floor(round((nvt - 150) / 150 * 50, 6)) AS BIGINT), 40) WHEN nvt < 40 THEN least(CAST(floor(round((40 - nvt) / 40 * 50, 6)) AS BIGINT), 40) ELSE 15 END AS confidence,
      CASE WHEN mvrv > 3.5 THEN 'bearish' WHEN mvrv < 1 THEN 'bullish' ELSE 'neutral' END AS mvrv_signal,
      CASE WHEN mvrv > 3.5 THEN least(CAST(floor(round((mvrv - 3.5) / 3.5 * 100, 6)) AS BIGINT), 90) WHEN mvrv < 1 THEN least(CAST(floor(round((1 - mvrv) * 100, 6)) AS BIGINT), 90) ELSE 30 END AS mvrv_confidence
      FROM w JOIN r USING (asset, d))"""


def chain(spark, sf):
    """NVT proxy and MVRV of each asset and day; the realised price is the volume-weighted mean close so far."""
    w = W.partitionBy("symbol").orderBy("d")
    b = A.bars_1d(spark, sf)
    mvrv = F.col("close") / (F.sum(F.col("close") * F.col("volume")).over(w) / F.sum("volume").over(w))
    return nvt(spark, sf).join(b.select(F.col("symbol").alias("asset"), "d", mvrv.alias("mvrv")), ["asset", "d"])


@plan("mvrv_nvt_ladder", f"WITH {CHAIN} SELECT * FROM l", "eav")
def ladder(spark, sf):
    from tidemark.operators.signals import mvrv, nvt_proxy

    s, c = mvrv(F.col("mvrv"))
    return chain(spark, sf).select("asset", "d", *nvt_proxy(F.col("nvt")), s.alias("mvrv_signal"), c.alias("mvrv_confidence"))


@plan("onchain_combined", f"""WITH {CHAIN}, v AS (SELECT asset, d, (CASE signal WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * (confidence > 0)::INT + CASE mvrv_signal WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * (mvrv_confidence > 0)::INT) / nullif((confidence > 0)::INT + (mvrv_confidence > 0)::INT, 0) AS score,
    (confidence + mvrv_confidence) / nullif((confidence > 0)::INT + (mvrv_confidence > 0)::INT, 0) AS conf FROM l)
    SELECT asset, d, CASE WHEN score > 0.3 THEN 'bullish' WHEN score < -0.3 THEN 'bearish' ELSE 'neutral' END AS signal, coalesce(floor(conf), 0)::BIGINT AS confidence, conf IS NOT NULL AS data_available FROM v""", "eav")
def onchain(spark, sf):
    """Majority of the chain signals that have a confidence; without any the record is unavailable."""
    from tidemark.operators import signals

    x = ladder(spark, sf)
    sign = lambda c: F.when(F.col(c) == "bullish", 1).when(F.col(c) == "bearish", -1).otherwise(0)
    parts = {"nvt": (sign("signal"), F.col("confidence")), "mvrv": (sign("mvrv_signal"), F.col("mvrv_confidence"))}
    signal, confidence, score = signals.weighted_votes(parts, {"nvt": 1.0, "mvrv": 1.0}, 0.3)
    return x.select("asset", "d", signal.alias("signal"), confidence.alias("confidence"), score.isNotNull().alias("data_available"))
