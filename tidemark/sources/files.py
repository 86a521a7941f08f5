"""Readers of the file formats in which market data comes: JSON arrays, CSV, zipped CSV and loose JSON records.

All read through Spark's readers (any path that Spark can read), with a declared schema; a
file that cannot be parsed gives null rows or fails there, never on the driver. Times become
UTC; numbers that are NaN become null; of repeated rows of a key the last one in the order
given stays.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import latest_per_key

OHLCV = "date string, symbol string, open double, high double, low double, close double, volume double, collected_at string"
KLINE = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, n_trades long, taker_base double, taker_quote double, unused string"
#: What a time in microseconds may be: the years 2020 to 2030.
FIRST_MICROS, LAST_MICROS = 1_577_836_800_000_000, 1_893_456_000_000_000


def finite(c: str) -> Column:
    """The number, or null where it is NaN."""
    return F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c)


def to_millis(c: Column) -> Column:
    """Epoch milliseconds of seconds, milliseconds or microseconds, told apart by their size."""
    return F.when(c < 10**12, c * 1000).when(c < 10**15, c).otherwise(F.floor(c / 1000)).cast("long")


def ohlcv_json(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """Daily bars from JSON arrays of records (or one record a line); of several records of a day the one collected last stays."""
    raw = spark.read.schema(OHLCV).option("multiLine", array).json(path)
    numbers = [finite(c) for c in ("open", "high", "low", "close", "volume")]
    rows = raw.where("date is not null").select("symbol", F.to_date("date").alias("d"), *numbers, "collected_at")
    return latest_per_key(rows, ["symbol", "d"], [F.col("collected_at").desc_nulls_last()]).drop("collected_at")


def candles_csv(spark: SparkSession, path: str, by: str = "symbol") -> DataFrame:
    """Hourly candles from CSV with a header, with the return within a symbol and the range within the bar."""
    from pyspark.sql import Window as W

    raw = spark.read.schema(f"{by} string, ts timestamp, open double, high double, low double, close double, volume double").option("header", True).csv(path)
    w = W.partitionBy(by).orderBy("ts")
    return raw.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).withColumn("intrabar_vol", F.try_divide(F.col("high") - F.col("low"), F.col("open")))


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of all members of ZIP files: a file is one row, unpacked in a task."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as f:
                            lines = io.TextIOWrapper(f, "utf-8").read().splitlines()
                        yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(lines), pa.string()), "line": pa.array(lines, pa.string())})

    return raw.mapInArrow(unpack, "file string, line string")


def klines_zip(spark: SparkSession, path: str) -> DataFrame:
    """One-minute candles of 12 columns from zipped CSV files: headers and times out of range are left out."""
    lines = zipped_lines(spark, path).where(F.col("line").rlike("^[0-9]"))
    k = lines.select(F.from_csv("line", F.lit(KLINE)).alias("k")).select("k.*")
    micros = to_millis(F.col("open_time")) * 1000
    rows = k.where(micros.between(FIRST_MICROS, LAST_MICROS)).select(F.timestamp_micros(micros).alias("ts"), "open", "high", "low", "close", "volume", "n_trades", F.try_divide("taker_base", "volume").alias("taker_ratio"))
    return latest_per_key(rows, ["ts"], [F.col("volume").desc()])


def funding_csv(spark: SparkSession, path: str) -> DataFrame:
    """Funding rates (symbol, ts_ms, rate) from CSV; rows without time or rate are left out."""
    raw = spark.read.schema("symbol string, time long, rate double").option("header", True).csv(path)
    return raw.where("time is not null and rate is not null and not isnan(rate)").select("symbol", to_millis(F.col("time")).alias("ts_ms"), "rate")


def probabilities_json(spark: SparkSession, path: str) -> DataFrame:
    """Probability history (token_id, ts, p) from JSON lines whose time is ``t`` or ``timestamp`` and whose value is ``p`` or ``price``."""
    raw = spark.read.schema("token_id string, t long, timestamp long, p double, price double").json(path)
    ts = F.floor(to_millis(F.coalesce("t", "timestamp")) / 1000).cast("long")
    rows = raw.select("token_id", ts.alias("ts"), F.coalesce("p", "price").alias("p"), F.monotonically_increasing_id().alias("n")).where("ts is not null and p is not null")
    return latest_per_key(rows, ["token_id", "ts"], [F.col("n").desc()]).drop("n")


def yes_token(tokens: Column) -> Column:
    """The first token of a field that holds a JSON array, the same array as a JSON string, or a plain token."""
    inner = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), tokens, F.lit("}")), "$.v"), tokens)
    first = F.coalesce(F.get_json_object(inner, "$[0].token_id"), F.get_json_object(inner, "$[0]"))
    return F.coalesce(first, F.when(~inner.startswith("["), inner))


def markets_json(spark: SparkSession, path: str, least_volume: float = 0.0, words: list[str] = ()) -> DataFrame:
    """(id, question, token, volume) of markets with enough volume and one of the words (any, if none are given); an id comes once."""
    raw = spark.read.schema("id string, question string, description string, clobTokenIds string, volume string").json(path)
    text = F.lower(F.concat_ws(" ", "question", "description"))
    hit = F.lit(not words)
    for w in words:
        hit = hit | text.contains(w.lower())
    volume = F.coalesce(F.expr("try_cast(volume as double)"), F.lit(0.0))
    rows = raw.where(hit).select("id", "question", yes_token(F.col("clobTokenIds")).alias("token"), volume.alias("volume"), F.monotonically_increasing_id().alias("n"))
    return latest_per_key(rows.where(F.col("volume") >= least_volume), ["id"], [F.col("n")]).drop("n")


#: Names of a chart's arrays and of the metrics that they are.
CHART = {"prices": "price", "total_volumes": "volume", "market_caps": "mcap"}


def chart_json(spark: SparkSession, path: str) -> DataFrame:
    """(asset, metric, ts_ms, value) of market charts: records with arrays of [milliseconds, value] by metric."""
    arrays = ", ".join(f"{c} array<array<double>>" for c in CHART)
    raw = spark.read.schema(f"asset string, {arrays}").json(path)
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("points")) for c, m in CHART.items()])).alias("m")
    x = raw.select("asset", named).select("asset", "m.metric", F.explode("m.points").alias("point"))
    return x.select("asset", "metric", F.try_element_at("point", F.lit(1)).cast("long").alias("ts_ms"), F.try_element_at("point", F.lit(2)).alias("value"))


def node_json(spark: SparkSession, path: str) -> DataFrame:
    """(asset, metric, ts_ms, value) of records (asset, metric, t in seconds, v)."""
    raw = spark.read.schema("asset string, metric string, t long, v double").json(path)
    return raw.select("asset", "metric", to_millis(F.col("t")).alias("ts_ms"), F.col("v").alias("value"))


#: Reader of each provider of chain metrics.
CHAIN = {"chart": chart_json, "node": node_json}


def chain_metrics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Chain metrics of several providers in one table; of a (asset, metric, ts_ms) the provider named first has the word.

    Rows without time or value, or with NaN, are left out.
    """
    parts = [CHAIN[kind](spark, path).withColumn("rank", F.lit(rank)) for rank, (kind, path) in enumerate(paths.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fine = every.where("asset is not null and metric is not null and ts_ms is not null and value is not null and not isnan(value)")
    return latest_per_key(fine, ["asset", "metric", "ts_ms"], [F.col("rank"), F.col("value")]).drop("rank")


def macro_csv(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Macro series from CSV: (symbol, ts in UTC, OHLCV) with NaN as null."""
    raw = spark.read.schema("symbol string, ts string, open double, high double, low double, close double, volume double").option("header", True).option("nanValue", "NaN").csv(path)
    return raw.select("symbol", F.to_utc_timestamp(F.to_timestamp_ntz("ts").cast("timestamp"), zone).alias("ts"), *[finite(c) for c in ("open", "high", "low", "close", "volume")])
