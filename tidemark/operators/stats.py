"""Statistics without a statistics package: Student t, rank sums and the bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Coarse bins of values for ranks, and fine ones within each.
BINS = 16


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * (f - 1)


def t_p_value(t: float | None, df: int) -> float | None:
    """Two-sided p-value of Student's t."""
    if t is None or math.isnan(t) or df < 1:
        return None
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(a, int(b)) for a, b in zip(t, df, strict=True)], dtype="float64")


#: Cumulative probabilities of Poisson(1) as parts of 2 ** 64; beyond twelve it is as good as never.
POISSON = np.array([min(2**64 - 1, int(2**64 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))) for k in range(12)], np.uint64)


def draws(keys: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (rows x resamples): functions of the row's key, the resample and the seed only."""
    with np.errstate(over="ignore"):
        x = keys[:, None] ^ (np.arange(first, last, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(POISSON, x, side="right").astype(np.float64)


def bootstrap_ci(df: DataFrame, by: list[str], value: str, key: str, resamples: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile bootstrap interval of each group's mean, by Poisson weights.

    Every row draws its weight in each resample from a hash of its ``key`` (unique in its
    group), so that results do not depend on partitions. Tasks add up weights and weighted
    values of their rows; only these sums are shuffled, and a group of any size is spread
    over all tasks. The quantiles of a group are taken from its ``resamples`` means.
    """
    kinds = dict(df.dtypes)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"), F.xxhash64(key).alias("__k"))
    block = 500

    def run(frames):
        for pdf in frames:
            for group, part in pdf.groupby(by, dropna=False, sort=True):
                x, keys = part["__v"].to_numpy(), part["__k"].to_numpy().view(np.uint64)
                for first in range(0, resamples, block):
                    w, s = np.zeros(block), np.zeros(block)
                    for i in range(0, len(x), 2_000):
                        weights = draws(keys[i : i + 2_000], first, first + block, seed)
                        w += weights.sum(axis=0)
                        s += x[i : i + 2_000] @ weights
                    n = min(block, resamples - first)
                    yield pd.DataFrame({**{b: [g] * n for b, g in zip(by, group, strict=True)}, "r": np.arange(first, first + n), "w": w[:n], "s": s[:n]})

    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", r long, w double, s double"
    means = rows.mapInPandas(run, schema).groupBy(*by, "r").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    ends = means.groupBy(*by).agg(F.percentile(F.try_divide("s", "w"), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    plain = rows.groupBy(*by).agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"))
    same = [plain[b].eqNullSafe(ends[b]) for b in by]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return plain.join(ends, on).select(*[plain[b] for b in by], "n", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def quantile_bins(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``values`` with ``bin``, one of about 256 of near equal numbers of rows in each group, whatever the values are.

    The edges come from the mergeable quantile sketch of ``percentile_approx``; they need not
    be exact, as a bin only says which rows are compared.
    """
    n = BINS * BINS
    edges = values.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], 4 * n).alias("__edges"))
    x = values.join(edges, by)
    v = F.col(value)
    coarse = F.filter(F.col("__edges"), lambda e, i: (i % BINS == BINS - 1) & (e < v))
    fine = F.filter(F.slice("__edges", F.col("__coarse") * BINS + 1, F.lit(BINS - 1)), lambda e: e < v)
    x = x.withColumn("__coarse", F.size(coarse))
    return x.withColumn("bin", F.col("__coarse") * BINS + F.size(fine)).drop("__edges", "__coarse")


def value_ranks(counts: DataFrame, by: list[str], value: str, k: str) -> DataFrame:
    """Distinct values with their counts ``k`` get ``below``: the rows of their group with a smaller value.

    Counts of bins are added up over one row for each bin; only the values of one bin are one
    window. Null groups have no rank.
    """
    binned = quantile_bins(counts, by, value)
    sizes = binned.groupBy(*by, "bin").agg(F.sum(k).alias("size"))
    lower = F.sum("size").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*by, "bin", F.coalesce(lower, F.lit(0)).alias("lower"))
    before = W.partitionBy(*by, "bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    x = binned.join(sizes, [*by, "bin"])
    return x.withColumn("below", F.col("lower") + F.coalesce(F.sum(k).over(before), F.lit(0))).drop("lower", "bin")


def percentile_rank(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Rows with the share of their group's values, in percent, that lie strictly below their own.

    Equal values are one row while ranks are formed. Rows without a value or group have null.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__k"))
    total = counts.groupBy(by).agg(F.sum("__k").alias("__total"))
    ranks = value_ranks(counts, [by], value, "__k").join(total, by)
    ranks = ranks.select(F.col(by).alias("__by"), F.col(value).alias("__value"), (F.col("below") / F.col("__total") * 100).alias(name))
    return df.join(ranks, (F.col(by) == F.col("__by")) & (F.col(value) == F.col("__value")), "left").drop("__by", "__value")


def mann_whitney(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """One-sided U test that group 1 lies above group 0: U, z with tie and continuity correction, and p.

    Average ranks come from value counts, so that no sort of all rows in one task is needed:
    equal values are added up before ranks are formed.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum((F.col(group) == 1).cast("long")).alias("k1"), F.count(F.lit(1)).alias("k"))
    r = value_ranks(counts, by, value, "k").withColumn("rank", F.col("below") + (F.col("k") + 1) / 2)
    g = r.groupBy(*by).agg(F.sum("k1").alias("n1"), F.sum(F.col("k") - F.col("k1")).alias("n0"), F.sum(F.col("rank") * F.col("k1")).alias("r1"), F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).alias("ties"))
    n = F.col("n1") + F.col("n0")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(u - F.col("n1") * F.col("n0") / 2 - 0.5, sd)

    @F.pandas_udf(T.DoubleType())
    def upper(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2)))

    return g.where("n1 >= 3 and n0 >= 3").select(*by, "n1", "n0", u.alias("u"), z.alias("z"), upper(z).alias("p"))
