"""Event study: snap events to trading days, fit a market model, sum abnormal returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.joins import range_join

WINDOWS = {"car_0_1": 1, "car_0_5": 5, "car_0_20": 20}


def aligned_returns(stock: DataFrame, market: DataFrame) -> DataFrame:
    """(ticker, d, i, r, m) on the days that both have; returns are taken after the join."""
    x = stock.join(market.select("d", F.col("close").alias("mc")), "d")
    w = W.partitionBy("ticker").orderBy("d")
    return x.select("ticker", "d", F.row_number().over(w).alias("i"), (F.col("close") / F.lag("close").over(w) - 1).alias("r"), (F.col("mc") / F.lag("mc").over(w) - 1).alias("m"))


def snap(events: DataFrame, days: DataFrame, within: int = 4) -> DataFrame:
    """Each event with the first trading day (d, i) at most ``within`` days after it; others drop out."""
    e = events.withColumn("lo", F.unix_date("event_date").cast("long")).withColumn("hi", F.col("lo") + within)
    q = days.select("ticker", "d", "i", F.unix_date("d").cast("long").alias("day"))
    near = range_join(e, q, "ticker", "day", "lo", "hi", 16)
    return near.groupBy("ticker", "event_id", "source_type", "event_date").agg(F.min(F.struct("d", "i")).alias("s")).select("ticker", "event_id", "source_type", "event_date", F.col("s.d").alias("d"), F.col("s.i").cast("long").alias("i"))


def fitted_days(returns: DataFrame, estimate: tuple[int, int]) -> DataFrame:
    """For each day of each ticker the market model of the estimation window before it, and the sums of its event windows.

    Running sums of r, m, r m and m m give every window by a difference, so that a day
    costs the same whatever the length of its window, and an event is one row to look up.
    """
    w = W.partitionBy("ticker").orderBy("i")
    r, m = F.col("r"), F.when(F.col("r").isNotNull(), F.col("m"))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    parts = {"n": F.when(r.isNotNull(), 1.0), "r": r, "m": m, "rm": r * m, "mm": m * m}
    x = returns.withColumns({f"s_{k}": F.coalesce(F.sum(v).over(run), F.lit(0.0)) for k, v in parts.items()})
    first, last = estimate

    def at(k: str, days: int):
        """The running sum so many days away; before the first day it is 0, behind the last one the last."""
        if days <= 0:
            return F.lag(f"s_{k}", -days, 0.0).over(w)
        return F.coalesce(F.lead(f"s_{k}", days).over(w), F.last(f"s_{k}").over(w.rowsBetween(0, W.unboundedFollowing)))

    est = {k: (at(k, last) - at(k, first - 1)).alias(f"e_{k}") for k in parts}
    sums = [(at(k, days) - at(k, -1)).alias(f"{k}_{name}") for name, days in WINDOWS.items() for k in ("n", "r", "m")]
    x = x.select("ticker", "i", *est.values(), *sums)
    beta = F.try_divide(F.col("e_rm") - F.col("e_r") * F.col("e_m") / F.col("e_n"), F.col("e_mm") - F.col("e_m") * F.col("e_m") / F.col("e_n"))
    x = x.where("e_n > 0").withColumn("beta", beta)
    return x.withColumn("alpha", (F.col("e_r") - F.col("beta") * F.col("e_m")) / F.col("e_n")).withColumn("n_est", F.col("e_n").cast("long"))


def study(events: DataFrame, returns: DataFrame, estimate: tuple[int, int] = (-250, -11), least: int = 200) -> DataFrame:
    """Alpha, beta and the sums of abnormal returns per event; a sum is null unless its whole window is there."""
    e = snap(events, returns)
    days = fitted_days(returns, estimate).where(F.col("n_est") >= least)
    x = e.join(days.withColumnRenamed("ticker", "of").withColumnRenamed("i", "at_i"), (F.col("ticker") == F.col("of")) & (F.col("i") == F.col("at_i")))
    cars = [F.when(F.col(f"n_{n}") == k + 1, F.col(f"r_{n}") - (k + 1) * F.col("alpha") - F.col("beta") * F.col(f"m_{n}")).alias(n) for n, k in WINDOWS.items()]
    return x.select("ticker", "event_id", "source_type", "event_date", "i", "n_est", "alpha", "beta", *cars)


def paths(studied: DataFrame, returns: DataFrame) -> DataFrame:
    """(ticker, event_id, source_type, day, ar): the abnormal return of every day of the longest window of each event."""
    last = max(WINDOWS.values())
    e = studied.select("ticker", "event_id", "source_type", "event_date", "alpha", "beta", "i", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("day"))
    r = returns.select(F.col("ticker").alias("of"), F.col("i").alias("at_i"), "r", "m")
    x = e.join(r, (F.col("ticker") == F.col("of")) & (F.col("i") + F.col("day") == F.col("at_i")))
    return x.select("ticker", "event_id", "source_type", "event_date", "day", (F.col("r") - F.col("alpha") - F.col("beta") * F.col("m")).alias("ar"))
