"""Performance metrics of equity curves and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RISK_FREE = 0.0434


def curve(values: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Values with their return and drawdown."""
    w = W.partitionBy(by).orderBy(order)
    return values.withColumn("ret", F.col(value) / F.lag(value).over(w) - 1).withColumn("dd", F.col(value) / F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)


def sharpe(ret: Column, periods: float, risk_free: float = 0.0) -> Column:
    """Mean excess return over its standard deviation, annualised; null without spread."""
    sd = F.stddev_samp(ret)
    return F.when(sd > 1e-12, (F.avg(ret) - risk_free / periods) / sd * F.sqrt(F.lit(float(periods))))


def sortino(ret: Column, periods: float, risk_free: float = RISK_FREE) -> Column:
    excess = ret - risk_free / periods
    down = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2)))
    return F.when(down > 1e-12, F.avg(excess) / down * F.sqrt(F.lit(float(periods))))


def calmar(first: Column, last: Column, days: Column, worst: Column) -> Column:
    """Annualised return (365 days) over the largest drawdown; null without a drawdown."""
    annual = F.pow(last / first, F.lit(365.0) / days) - 1
    return F.when(F.abs(worst) > 1e-9, annual / F.abs(worst))
