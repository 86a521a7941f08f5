"""Plans over files: stored tables are written in a format of the trade and read back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.stream import folder
from tidemark.sources import adapters as A
from tidemark.sources import files
from tidemark.sources.adapters import with_views
from tidemark.sources.tables import table

QUERIES, SQL = {}, {}


def plan(name: str, sql: str, views: str = ""):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = with_views(views, sql) if views else sql
        return fn

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


@plan("ohlcv_json_bars", "SELECT symbol, d, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars", "bars")
def ohlcv_json_bars(spark, sf):
    """Bars written as JSON twice, the second time with what was collected later, and read back."""
    path = folder(spark)
    b = A.bars_1d(spark, sf).select(F.col("d").cast("string").alias("date"), "symbol", "open", "high", "low", "close", "volume")
    early, late = b.withColumn("close", F.col("close") + 1).withColumn("collected_at", F.lit("2024-01-01T00:00:00")), b.withColumn("collected_at", F.lit("2024-01-02T00:00:00"))
    early.union(late.select(*early.columns)).write.json(path)
    return files.ohlcv_json(spark, path, array=False).select("symbol", "d", *[r6(F.col(c), c) for c in ("open", "high", "low", "close")], "volume")


@plan("candles_csv_derived", """WITH h AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, trade_id)) AS close, count(*)::DOUBLE AS volume FROM trades GROUP BY 1, 2)
    SELECT symbol, ts, round(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 6) AS ret, round((high - low) / nullif(open, 0), 6) AS intrabar_vol FROM h""", "trades")
def candles_csv_derived(spark, sf):
    """Hourly candles written as CSV and read back with their returns and ranges."""
    path, k = folder(spark), F.struct("ts", "trade_id")
    h = A.trades(spark, sf).groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    h.select("symbol", F.col("h").alias("ts"), "open", "high", "low", "close", "volume").write.option("header", True).csv(path)
    return files.candles_csv(spark, path).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), r6(F.col("ret"), "ret"), r6(F.col("intrabar_vol"), "intrabar_vol"))


@plan("funding_csv_units", "SELECT symbol, epoch_ms(ts) AS ts_ms, rate FROM funding", "funding")
def funding_csv_units(spark, sf):
    """Funding rates written in seconds, milliseconds and microseconds, with empty rows, and read back."""
    path = folder(spark)
    f = A.funding(spark, sf)
    ms, kind = F.unix_millis("ts"), F.pmod(F.xxhash64("symbol", "ts"), F.lit(3))
    rows = f.select("symbol", F.when(kind == 0, F.floor(ms / 1000)).when(kind == 1, ms).otherwise(ms * 1000).cast("long").alias("time"), "rate")
    empty = f.select("symbol", F.lit(None).cast("long").alias("time"), "rate").union(f.select("symbol", F.unix_millis("ts"), F.lit(None).cast("double")))
    rows.union(empty).write.option("header", True).csv(path)
    return files.funding_csv(spark, path)


@plan("probability_history", "SELECT token_id::VARCHAR AS token_id, floor(epoch(ts))::BIGINT AS ts, round(max(p), 6) AS p FROM prob GROUP BY 1, 2", "prob")
def probability_history(spark, sf):
    """Ticks written as loose JSON records of two shapes and read back."""
    path = folder(spark)
    x = A.prob_ticks(spark, sf).groupBy(F.col("token_id").cast("string").alias("token_id"), F.unix_seconds("ts").alias("s")).agg(F.max("p").alias("p"))
    odd = F.pmod(F.xxhash64("token_id", "s"), F.lit(2)) == 0
    x.select("token_id", F.when(odd, F.col("s")).alias("t"), F.when(~odd, F.col("s") * 1000).alias("timestamp"), F.when(odd, F.col("p")).alias("p"), F.when(~odd, F.col("p")).alias("price")).write.json(path)
    return files.probabilities_json(spark, path).select("token_id", "ts", r6(F.col("p"), "p"))


@plan("market_tokens", "SELECT c_custkey::VARCHAR AS id, c_name AS question, 'yes' || c_custkey AS token, c_acctbal AS volume FROM customer WHERE c_acctbal >= 1000 AND contains(lower(c_name || ' ' || c_mktsegment), 'auto')")
def market_tokens(spark, sf):
    """Market records, twice each, whose tokens are an array, an array as a string or a plain token."""
    path, kind = folder(spark), F.col("c_custkey") % 3
    yes = F.concat(F.lit("yes"), F.col("c_custkey").cast("string"))
    tokens = F.when(kind == 0, F.concat(F.lit('["'), yes, F.lit('","no"]'))).when(kind == 1, F.concat(F.lit('[{"token_id":"'), yes, F.lit('"}]'))).otherwise(yes)
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("question"), F.col("c_mktsegment").alias("description"), tokens.alias("clobTokenIds"), F.col("c_acctbal").cast("string").alias("volume"))
    c.union(c).write.json(path)
    return files.markets_json(spark, path, 1000, ["auto"])


@plan("macro_series", "SELECT 'M' || symbol AS symbol, d::TIMESTAMP + INTERVAL 5 HOUR AS ts, round(close, 6) AS close, CASE WHEN volume >= 100 THEN volume END AS volume FROM bars", "bars")
def macro_series(spark, sf):
    """Bars as local times of a zone five hours behind, with NaN for small volumes, read back in UTC."""
    path = folder(spark)
    b = A.bars_1d(spark, sf)
    volume = F.when(F.col("volume") >= 100, F.col("volume")).otherwise(F.lit(float("nan")))
    b.select(F.concat(F.lit("M"), "symbol").alias("symbol"), F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", volume.alias("volume")).write.option("header", True).csv(path)
    x = files.macro_csv(spark, path, "GMT-05:00")
    return x.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), r6(F.col("close"), "close"), "volume")


@plan("chain_backfill", """SELECT asset, metric, ts_ms, round(CASE WHEN metric = 'price' AND (ts_ms // 86400000) % 3 = 0 THEN value + 1 ELSE value END, 5) AS value FROM eav
    UNION ALL SELECT asset, 'mvrv', ts_ms, round(value / 97, 5) FROM eav WHERE metric = 'price'""", "eav")
def chain_backfill(spark, sf):
    """Metrics of two providers, as charts in milliseconds and records in seconds, that overlap in part: the first one's values stay."""
    path, e = folder(spark), A.metrics_eav(spark, sf)
    day = F.floor(F.col("ts_ms") / 86_400_000)
    first = F.when((F.col("metric") == "price") & (day % 3 == 0), F.col("value") + 1).otherwise(F.col("value"))
    points = lambda m: F.collect_list(F.when(F.col("metric") == m, F.array(F.col("ts_ms").cast("double"), first)))
    charts = e.groupBy("asset", F.floor(day / 90).alias("q")).agg(*[points(m).alias(c) for c, m in files.CHART.items()])
    charts.drop("q").write.json(f"{path}/chart")
    seconds = F.floor(F.col("ts_ms") / 1000).alias("t")
    price = e.where("metric = 'price'")
    price.select("asset", "metric", seconds, F.col("value").alias("v")).union(price.select("asset", F.lit("mvrv"), seconds, F.col("value") / 97)).write.json(f"{path}/node")
    return files.chain_metrics(spark, {"chart": f"{path}/chart", "node": f"{path}/node"}).select("asset", "metric", "ts_ms", F.round("value", 5).alias("value"))
