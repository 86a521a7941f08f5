"""Structured Streaming forms of the engine's event operators.

The functions take a streaming (or batch) DataFrame and return one, so that a stream
and a batch share the code; :func:`drain` runs a stream to its end for replays.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def stored(spark: SparkSession, sf: str, files: int = 1) -> DataFrame:
    """The stored event files as a stream, so many at a time."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def event_stream(spark: SparkSession, sf: str, files: int = 1) -> DataFrame:
    """Trade ticks as a stream of the stored event files."""
    raw = stored(spark, sf, files)
    return raw.select(F.col("event_id").alias("trade_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "user_id", F.col("value").alias("price"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"), "props")


def ohlc(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of event time; ticks later than the watermark are dropped."""
    k = F.struct("ts", "trade_id")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width))
    return g.agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.count(F.lit(1)).alias("n")).select("symbol", F.col("window.start").alias("h"), "open", "high", "low", "close", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events with pauses below the gap."""
    g = ticks.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_trades(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each trade once, within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trade_id"])


class Throttle(StatefulProcessor):
    """The time of the last snapshot that was kept, in microseconds."""

    def __init__(self, seconds: int) -> None:
        self.wait = seconds * 1_000_000

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = last = self.last.get()[0] if self.last.exists() else None
        # Times and prices only; the rows that are kept are cut out of these arrays.
        parts = [(f["at"].to_numpy(), f["price"].to_numpy()) for f in rows]
        at, price = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, keep = np.lexsort((price, at)), []
        at, price = at[order], price[order]
        i = 0 if last is None else int(np.searchsorted(at, last + self.wait))
        while i < len(at):
            keep.append(i)
            last = int(at[i])
            i = max(i + 1, int(np.searchsorted(at, last + self.wait)))
        if last != before:
            self.last.update((last,))
        yield pd.DataFrame({"symbol": [key[0]] * len(keep), "ts": pd.to_datetime(at[keep], unit="us"), "price": price[keep]})

    def close(self) -> None:
        pass


def throttle(ticks: DataFrame, seconds: int = 5) -> DataFrame:
    """Of each symbol's snapshots those at least ``seconds`` after the last one kept.

    The state is a time. A micro-batch is searched from one kept snapshot to the next.
    """
    x = ticks.select("symbol", F.unix_micros("ts").alias("at"), "price")
    return x.groupBy("symbol").transformWithStateInPandas(Throttle(seconds), "symbol string, ts timestamp, price double", "Append", "None")


def vwap(ticks: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Volume-weighted mean price of sliding windows of event time; null where nothing was traded."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, step))
    volume = F.sum("amount")
    return g.agg(F.try_divide(F.sum(F.col("price") * F.col("amount")), volume).alias("vwap"), volume.alias("volume"), F.count(F.lit(1)).alias("n")).select("symbol", F.col("window.start").alias("start"), "vwap", "volume", "n")


@contextmanager
def disk_state(spark: SparkSession):
    """Keep the state of streams that start here on disk (RocksDB), as keyed state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into Parquet below ``path`` and read it back."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
