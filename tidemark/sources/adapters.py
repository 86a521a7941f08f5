"""The engine's logical tables as views over the stored tables.

Every adapter is a pure DataFrame expression: filters and columns that a query uses
reach the Parquet scan. Times are cast explicitly; all sessions run in UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def bars_1d(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars (symbol, d, open, high, low, close, volume): first and last price by a total order of lines."""
    x = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.to_date("l_shipdate").alias("d"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"),
    )
    return x.groupBy("symbol", "d").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume")
    )


def bench_1d(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark series (d, close): mean order price by day, to the cent."""
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.round(F.avg("o_totalprice"), 2).alias("close"))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trade ticks (trade_id, ts, symbol, price, amount, side, user_id)."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("trade_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("price"),
        F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(1.0)).alias("amount"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        "user_id",
    )


#: What a recorded event means for an order.
ORDER_KINDS = {"signup": "submit", "view": "accept", "click": "fill", "purchase": "fill", "error": "cancel"}


def order_log(events: DataFrame) -> DataFrame:
    """Recorded order events (account, seq, ts, kind, order_id, side, qty, price) of a stored or streamed event table.

    A user is an account with eight order ids, chosen by the recorded number; an order is for
    that number of shares and one, a fill for a part of it.
    """
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    kind = F.create_map(*[F.lit(x) for pair in ORDER_KINDS.items() for x in pair])[F.col("event_type")]
    qty = F.when(F.col("event_type") == "signup", k + 1).otherwise(1 + F.floor(k / 4)).cast("double")
    return events.select(
        F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
        F.concat_ws("-", "user_id", k % 8).alias("order_id"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), qty.alias("qty"), F.col("value").alias("price"),
    )


def prob_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Probability ticks of prediction markets (token_id, ts, p)."""
    return trades(spark, sf).select(F.col("user_id").alias("token_id"), "ts", F.least(F.col("price") / 500, F.lit(1.0)).alias("p"))


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """Earnings filings (filing_id, ticker, report_period, filing_date, source_type, surprise), point in time."""
    li = table(spark, sf, "lineitem")
    od = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("report_period"))
    x = li.join(od, li.l_orderkey == od.o_orderkey)
    kind = F.when(F.col("l_returnflag") == "N", "8-K").when(F.col("l_returnflag") == "R", "10-Q").otherwise("10-K")
    surprise = F.when(F.col("l_discount") > 0.06, "BEAT").when(F.col("l_discount") < 0.04, "MISS").otherwise("MEET")
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("filing_id"),
        F.col("l_suppkey").alias("ticker"), "report_period", F.to_date("l_shipdate").alias("filing_date"), kind.alias("source_type"), surprise.alias("surprise"),
    )


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly fundamentals (ticker, report_period, filing_date, gross_margin, tax_rate, bvps)."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("ticker"), F.trunc(F.to_date("l_shipdate"), "quarter").alias("report_period")).agg(
        F.to_date(F.max("l_shipdate")).alias("filing_date"),
        F.round(F.avg("l_discount"), 8).alias("gross_margin"),
        F.round(F.avg("l_tax"), 8).alias("tax_rate"),
        F.round(F.sum("l_quantity") / F.lit(10), 4).alias("bvps"),
    )


def funding(spark: SparkSession, sf: str) -> DataFrame:
    """Eight-hourly funding rates (symbol, ts, rate)."""
    x = trades(spark, sf)
    return x.groupBy("symbol", F.window("ts", "8 hours").start.alias("ts")).agg(F.round((F.avg("price") - 50) / 100000, 8).alias("rate"))


def metrics_eav(spark: SparkSession, sf: str) -> DataFrame:
    """Tidy metrics (asset, metric, ts_ms, value): price, volume and market capitalisation by day."""
    from pyspark.sql import Window as W

    b = bars_1d(spark, sf)
    b = b.withColumn("mcap", F.col("close") * F.sum("volume").over(W.partitionBy("symbol").orderBy("d")))
    ms = F.unix_millis(F.col("d").cast("timestamp"))
    stacked = b.select(F.col("symbol").alias("asset"), ms.alias("ts_ms"), F.expr("stack(3, 'price', close, 'volume', volume, 'mcap', mcap) as (metric, value)"))
    return stacked.select("asset", "metric", "ts_ms", "value")


def model_views(spark: SparkSession, sf: str) -> DataFrame:
    """Views (strategy, model, ticker, d, value in [-1, 1], abstained) of three models on month ends."""
    b = bars_1d(spark, sf).groupBy(F.col("symbol").alias("ticker"), F.trunc("d", "month").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    models = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(m).alias("model"), F.lit(float(w)).alias("weight")) for s, m, w in MODELS])).alias("m")
    x = b.select("ticker", "d", models).select("m.*", "ticker", "d")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "model", "ticker", F.col("d").cast("string"))), 1, 6), 16, 10).cast("long")
    return x.select("strategy", "model", "weight", "ticker", "d", ((h % 2001 - 1000) / F.lit(1000.0)).alias("value"), (h % 7 == 0).alias("abstained"))


#: (strategy, model, weight in its strategy) of the example mandate, and the strategies' slices.
MODELS = (("s1", "trend", 3), ("s1", "value", 1), ("s2", "drift", 1))
SLICES = {"s1": 3.0, "s2": 1.0}

# The same views in DuckDB SQL, for oracles.
SQL = {
    "bars": """bars AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS d,
        arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open,
        max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close,
        sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)""",
    "bench": "bench AS (SELECT CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice), 2) AS close FROM orders GROUP BY 1)",
    "trades": """trades AS (SELECT event_id AS trade_id, ts, event_type AS symbol, value AS price,
        coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 1.0) AS amount, CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, user_id FROM events)""",
    "order_log": """order_log AS (SELECT user_id AS account, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'accept' WHEN 'error' THEN 'cancel' ELSE 'fill' END AS kind,
        user_id || '-' || (k % 8) AS order_id, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN event_type = 'signup' THEN k + 1 ELSE 1 + k // 4 END::DOUBLE AS qty, value AS price
        FROM (SELECT *, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events))""",
    "prob": "prob AS (SELECT user_id AS token_id, ts, least(price / 500, 1.0) AS p FROM trades)",
    "filings": """filings AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS filing_id, l_suppkey AS ticker,
        CAST(o_orderdate AS DATE) AS report_period, CAST(l_shipdate AS DATE) AS filing_date,
        CASE l_returnflag WHEN 'N' THEN '8-K' WHEN 'R' THEN '10-Q' ELSE '10-K' END AS source_type,
        CASE WHEN l_discount > 0.06 THEN 'BEAT' WHEN l_discount < 0.04 THEN 'MISS' ELSE 'MEET' END AS surprise
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "fundamentals": """fundamentals AS (SELECT l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS report_period, CAST(max(l_shipdate) AS DATE) AS filing_date,
        round(avg(l_discount), 8) AS gross_margin, round(avg(l_tax), 8) AS tax_rate, round(sum(l_quantity) / 10, 4) AS bvps FROM lineitem GROUP BY 1, 2)""",
    "funding": "funding AS (SELECT symbol, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, round((avg(price) - 50) / 100000, 8) AS rate FROM trades GROUP BY 1, 2)",
    "eav": """capped AS (SELECT *, close * sum(volume) OVER (PARTITION BY symbol ORDER BY d) AS mcap FROM bars),
        eav AS (SELECT symbol AS asset, 'price' AS metric, epoch_ms(d::TIMESTAMP) AS ts_ms, close AS value FROM capped
          UNION ALL SELECT symbol, 'volume', epoch_ms(d::TIMESTAMP), volume FROM capped UNION ALL SELECT symbol, 'mcap', epoch_ms(d::TIMESTAMP), mcap FROM capped)""",
    "views": """views AS (SELECT strategy, model, weight, ticker, d, (h % 2001 - 1000) / 1000.0::DOUBLE AS value, h % 7 = 0 AS abstained FROM (
        SELECT m.*, t.*, ('0x' || substr(md5(model || '|' || ticker || '|' || CAST(d AS VARCHAR)), 1, 6))::BIGINT AS h
        FROM (SELECT DISTINCT symbol AS ticker, CAST(date_trunc('month', d) AS DATE) AS d FROM bars) t
        CROSS JOIN (VALUES ('s1', 'trend', 3.0::DOUBLE), ('s1', 'value', 1.0::DOUBLE), ('s2', 'drift', 1.0::DOUBLE)) m(strategy, model, weight)))""",
}
NEEDS = {"prob": ["trades"], "funding": ["trades"], "eav": ["bars"], "views": ["bars"]}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views in front, and those they need."""
    order: list[str] = []
    for n in names.split():
        for need in [*NEEDS.get(n, []), n]:
            if need not in order:
                order.append(need)
    parts = [SQL[n] for n in order]
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body.lstrip()[len("WITH RECURSIVE") :]
    return ("WITH " + ", ".join(parts) + ", " + body.lstrip()[4:]) if body.lstrip().upper().startswith("WITH") else "WITH " + ", ".join(parts) + " " + body
