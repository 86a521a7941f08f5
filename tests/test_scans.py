"""Scans and ranks over long series against pandas and plain sorting."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ewm import ewm
from tidemark.operators import stats

SPECS = {"e3": ("x", 3, False), "e55": ("x", 55, False), "e200": ("x", 200, False), "a14": ("x", 14, True), "a14y": ("y", 14, True), "a2": ("y", 2, True)}


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_long_series_equals_the_recursion(spark):
    n = 1_000_000
    x = F.sin(F.col("t") / 100) * 50 + 100 + F.pmod(F.xxhash64("t"), F.lit(1000)) / 100
    s = spark.range(n).select(F.lit("one").alias("symbol"), F.col("id").alias("t")).withColumn("x", x)
    s = s.withColumn("y", F.when(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(7)) > 1, F.col("x") - 100)).repartition(8)
    out = ewm(s, SPECS, order="t", span=500)
    plan = executed(out)
    assert "Python" not in plan and "Pandas" not in plan
    got = out.toPandas().sort_values("t").reset_index(drop=True)
    assert len(got) == n
    for name, (column, span, adjust) in SPECS.items():
        want = got[column].ewm(span=span, adjust=adjust).mean()
        assert got[name].isna().equals(want.isna())
        assert np.nanmax(np.abs(got[name] - want) / np.maximum(1, np.abs(want))) < 1e-9, name


def test_many_series_with_holes_and_rare_rows(spark):
    rng = random.Random(2)
    rows = []
    for symbol in ["a", "b", "c", None]:
        at = dt.date(2020, 1, 1)
        for i in range(rng.choice([1, 5, 150])):
            at += dt.timedelta(rng.choice([1, 1, 2, 200]))
            rows.append((symbol, at, None if i < 2 and symbol == "b" else rng.uniform(-5, 5), rng.choice([None, 1.5, -2.0])))
    s = spark.createDataFrame(rows, "symbol string, d date, x double, y double")
    got = ewm(s, SPECS).toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("symbol", dropna=False):
        part = part.sort_values("d")
        for name, (column, span, adjust) in SPECS.items():
            x = part[column].astype(float)
            want = x.ewm(span=span, adjust=adjust).mean()
            assert part[name].isna().equals(want.isna())
            assert np.allclose(part[name].astype(float), want, rtol=1e-9, atol=1e-9, equal_nan=True), name


def test_without_adjustment_rows_without_a_value_keep_the_mean(spark):
    rows = [("a", i, x) for i, x in enumerate([None, 2.0, None, None, 6.0, None])]
    got = ewm(spark.createDataFrame(rows, "symbol string, d long, x double"), {"e": ("x", 3, False)}).orderBy("d")
    assert [r.e for r in got.collect()] == [None, 2.0, 2.0, 2.0, 4.0, 4.0]
    assert ewm(spark.createDataFrame([], "symbol string, d long, x double"), {"e": ("x", 3, True)}).count() == 0


def ranked_rows(kind, n=4_000):
    rng = random.Random(kind)
    value = {"outlier": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randrange(5)), "skew": lambda: rng.paretovariate(0.3)}[kind]
    rows = [(rng.choice("aab"), rng.randrange(2), value()) for _ in range(n)]
    return rows + [("a", 1, 1e9), ("b", 0, -1e9), ("a", 0, None)]


@pytest.mark.parametrize("kind", ["outlier", "ties", "skew"])
def test_ranks_equal_sorting(spark, kind):
    rows = ranked_rows(kind)
    df = spark.createDataFrame(rows, "g string, side int, v double")
    table = pd.DataFrame(rows, columns=["g", "side", "v"]).dropna()
    for r in stats.percentile_rank(df, "g", "v", "pct").dropDuplicates().collect():
        if r.v is None:
            assert r.pct is None
        else:
            mine = table[table.g == r.g].v
            assert r.pct == pytest.approx((mine < r.v).sum() / len(mine) * 100)
    got = {r.g: r.u for r in stats.mann_whitney(df, ["g"], "side", "v").collect()}
    for g, part in table.groupby("g"):
        one = part.v.rank()[part.side == 1]
        assert got[g] == pytest.approx(one.sum() - len(one) * (len(one) + 1) / 2)


@pytest.mark.parametrize("kind", ["outlier", "skew"])
def test_no_bin_holds_many_rows(spark, kind):
    df = spark.createDataFrame([(g, v) for g, _, v in ranked_rows(kind) if v is not None], "g string, v double")
    bins = stats.quantile_bins(df, ["g"], "v").groupBy("g", "bin").count()
    assert max(r["count"] for r in bins.collect()) < 0.02 * df.count()


def test_the_mean_of_one_value_is_that_value(spark):
    """Means of different spans start out equal to the last bit, so that no crossing is lost or made up there."""
    rng = random.Random(3)
    first = {f"s{i}": rng.uniform(900, 1100) for i in range(200)}
    rows = [(s, d, None if d == 0 and s < "s5" else x) for s, x in first.items() for d in (0, 1)] + [(s, 2, 1.0) for s in first]
    specs = {"f": ("x", 8, False), "s": ("x", 21, False), "a": ("x", 14, True)}
    got = ewm(spark.createDataFrame(rows, "symbol string, d long, x double"), specs, span=1).where("d = 0 or d = 1 and symbol < 's5'").where("f is not null").collect()
    assert len(got) == 200 and all(r.f == r.s == r.a == first[r.symbol] for r in got)
