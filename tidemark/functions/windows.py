"""Rolling functions of a time series, as column expressions over one window order.

Windows give null until they hold ``least`` values that are not null. All take
columns of a series partitioned by symbol and ordered by time, so that any number of
them share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def time_bucket(df: DataFrame, on: str, span: int | None = None) -> Column:
    """Number of the stretch of time that a row lies in.

    ``span`` is in days for dates (default 64), in seconds for timestamps (default one day)
    and in units of a whole number (default 86,400).
    """
    kind = df.schema[on].dataType.typeName()
    number = F.unix_date(F.col(on)) if kind == "date" else F.col(on) if kind in ("integer", "long") else F.unix_seconds(F.col(on).cast("timestamp"))
    return F.floor(number / (span or (64 if kind == "date" else 86_400)))


def series(by: str = "symbol", order: str = "d") -> WindowSpec:
    return W.partitionBy(by).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def roll(fn, x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """``fn`` over the last n rows, null while fewer than ``least`` (n) of them have a value."""
    frame = last_rows(w, n)
    return F.when(F.count(x).over(frame) >= (least or n), fn(x).over(frame))


def change(x: Column, w: WindowSpec) -> Column:
    """Simple return against the row before."""
    before = F.lag(x).over(w)
    return x / before - 1


def rsi(delta: Column, w: WindowSpec, n: int) -> Column:
    """Relative strength from mean gains and losses; ``delta`` is the difference to the row before (first: 0)."""
    gain = roll(F.avg, F.greatest(delta, F.lit(0.0)), w, n)
    loss = roll(F.avg, F.greatest(-delta, F.lit(0.0)), w, n)
    return F.when(loss == 0, F.when(gain > 0, F.lit(100.0))).otherwise(100 - 100 / (1 + gain / loss))


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    before = F.lag(close).over(w)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def skew_unbiased(x: Column, w: WindowSpec, n: int) -> Column:
    """Sample skewness with the small-sample correction."""
    factor = F.sqrt(F.lit(float(n * (n - 1)))) / (n - 2)
    return roll(F.skewness, x, w, n) * factor


def kurt_unbiased(x: Column, w: WindowSpec, n: int) -> Column:
    """Sample excess kurtosis with the small-sample correction."""
    return ((n + 1) * roll(F.kurtosis, x, w, n) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def z_score(x: Column, w: WindowSpec, n: int, least: int, floor: float = 1e-9) -> Column:
    """Distance from the rolling mean in rolling standard deviations."""
    return (x - roll(F.avg, x, w, n, least)) / (roll(F.stddev_samp, x, w, n, least) + floor)


def drawdown(x: Column, w: WindowSpec) -> Column:
    """Loss against the highest value so far (0 or negative)."""
    return x / F.max(x).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1


def crossover(fast: Column, slow: Column, w: WindowSpec) -> Column:
    """buy where fast rises above slow, sell where it falls below, else hold."""
    f, s = F.lag(fast).over(w), F.lag(slow).over(w)
    return F.when((f <= s) & (fast > slow), "buy").when((f >= s) & (fast < slow), "sell").otherwise("hold")
