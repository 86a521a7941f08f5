"""Plans of rolling indicators over daily bars."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.functions.ewm import ewm
from tidemark.operators import stats
from tidemark.operators.signals import CRYPTO_WEIGHTS, TECHNICAL_WEIGHTS, ensemble
from tidemark.sources import adapters as A
from tidemark.sources.adapters import with_views

QUERIES, SQL = {}, {}


def plan(name: str, sql: str | None, views: str = "bars"):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_views(views, sql)
        return fn

    return add


def r6(c, name):
    return F.round(c, 6).alias(name)


def priced(spark, sf):
    """Daily bars with the return, the difference to the day before and the true range."""
    return with_changes(A.bars_1d(spark, sf))


def with_changes(b):
    w = X.series()
    c = F.col("close")
    return b.withColumns({"ret": X.change(c, w), "delta": F.coalesce(c - F.lag(c).over(w), F.lit(0.0)), "tr": X.true_range(F.col("high"), F.col("low"), c, w)})


P = """p AS (SELECT *, close / lag(close) OVER w - 1 AS ret, coalesce(close - lag(close) OVER w, 0) AS delta,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))"""


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(expr: str, n: int, x: str) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {n} THEN {expr} {over(n)} END"


@plan("mean_reversion_bars", f"""WITH {P}, z AS (SELECT symbol, d, (close - {full('avg(close)', 50, 'close')}) / {full('stddev_samp(close)', 50, 'close')} AS z,
    {full('avg(close)', 20, 'close')} AS m, {full('stddev_samp(close)', 20, 'close')} AS s, close FROM p),
    q AS (SELECT symbol, d, z, (close - (m - 2 * s)) / (4 * s) AS b FROM z)
    SELECT symbol, d, round(z, 6) AS z, round(b, 6) AS pct_b, CASE WHEN z < -2 AND b < 0.2 THEN 'bullish' WHEN z > 2 AND b > 0.8 THEN 'bearish' ELSE 'neutral' END AS signal FROM q""")
def mean_reversion(spark, sf):
    w = X.series()
    c = F.col("close")
    m, s = X.roll(F.avg, c, w, 20), X.roll(F.stddev_samp, c, w, 20)
    z = F.try_divide(c - X.roll(F.avg, c, w, 50), X.roll(F.stddev_samp, c, w, 50))
    x = A.bars_1d(spark, sf).select("symbol", "d", z.alias("z"), F.try_divide(c - (m - 2 * s), 4 * s).alias("b"))
    signal = F.when((F.col("z") < -2) & (F.col("b") < 0.2), "bullish").when((F.col("z") > 2) & (F.col("b") > 0.8), "bearish").otherwise("neutral")
    return x.select("symbol", "d", r6(F.col("z"), "z"), r6(F.col("b"), "pct_b"), signal.alias("signal"))


@plan("ret_sum_momentum", f"""WITH {P} SELECT symbol, d, round(0.4 * {full('sum(ret)', 21, 'ret')} + 0.3 * {full('sum(ret)', 63, 'ret')} + 0.3 * {full('sum(ret)', 126, 'ret')}, 6) AS momentum,
    round(volume / {full('avg(volume)', 21, 'volume')}, 6) AS volume_ratio FROM p""")
def momentum(spark, sf):
    w = X.series()
    r = F.col("ret")
    score = 0.4 * X.roll(F.sum, r, w, 21) + 0.3 * X.roll(F.sum, r, w, 63) + 0.3 * X.roll(F.sum, r, w, 126)
    return priced(spark, sf).select("symbol", "d", r6(score, "momentum"), r6(F.col("volume") / X.roll(F.avg, F.col("volume"), w, 21), "volume_ratio"))


def ema_sql(name: str, span: int) -> str:
    a = 2 / (span + 1)
    return f"""{name} AS (SELECT symbol, i, d, close AS e FROM n WHERE i = 1 UNION ALL
        SELECT n.symbol, n.i, n.d, {a!r} * n.close + (1 - {a!r}) * {name}.e FROM {name} JOIN n ON n.symbol = {name}.symbol AND n.i = {name}.i + 1)"""


N = "n AS MATERIALIZED (SELECT symbol, d, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM bars)"


def with_emas(spark, sf):
    return ewm(A.bars_1d(spark, sf).select("symbol", "d", "close"), {f"ema{n}": ("close", n, False) for n in (8, 21, 55)})


@plan("ema", f"WITH RECURSIVE {N}, {ema_sql('e8', 8)}, {ema_sql('e21', 21)} SELECT e8.symbol, e8.d, round(e8.e, 6) AS ema8, round(e21.e, 6) AS ema21 FROM e8 JOIN e21 USING (symbol, i)")
def ema(spark, sf):
    return with_emas(spark, sf).select("symbol", "d", r6(F.col("ema8"), "ema8"), r6(F.col("ema21"), "ema21"))


CROSS = f"""WITH RECURSIVE {N}, {ema_sql('e8', 8)}, {ema_sql('e21', 21)}, j AS (SELECT e8.symbol, e8.d, e8.e AS f, e21.e AS s FROM e8 JOIN e21 USING (symbol, i)),
    l AS (SELECT *, lag(f) OVER (PARTITION BY symbol ORDER BY d) AS pf, lag(s) OVER (PARTITION BY symbol ORDER BY d) AS ps FROM j),
    x AS (SELECT symbol, d, CASE WHEN pf <= ps AND f > s THEN 'buy' WHEN pf >= ps AND f < s THEN 'sell' ELSE 'hold' END AS action FROM l)"""


@plan("ema_cross", f"{CROSS} SELECT * FROM x")
def ema_cross(spark, sf):
    w = X.series()
    return with_emas(spark, sf).select("symbol", "d", X.crossover(F.col("ema8"), F.col("ema21"), w).alias("action"))


@plan("ewm_adjusted", f"""WITH RECURSIVE {N}, e AS (SELECT symbol, i, d, close AS num, 1.0::DOUBLE AS den FROM n WHERE i = 1 UNION ALL
    SELECT n.symbol, n.i, n.d, n.close + {1 - 2 / 15!r} * e.num, 1 + {1 - 2 / 15!r} * e.den FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
    SELECT symbol, d, round(num / den, 6) AS ewm FROM e""")
def ewm_adjusted(spark, sf):
    return ewm(A.bars_1d(spark, sf).select("symbol", "d", "close"), {"e": ("close", 14, True)}).select("symbol", "d", r6(F.col("e"), "ewm"))


def rsi_sql(n: int) -> str:
    g, l = full("avg(greatest(delta, 0))", n, "delta"), full("avg(greatest(-delta, 0))", n, "delta")
    return f"CASE WHEN {l} = 0 THEN CASE WHEN {g} > 0 THEN 100.0 END ELSE 100 - 100 / (1 + {g} / {l}) END"


@plan("rsi", f"WITH {P} SELECT symbol, d, round({rsi_sql(14)}, 6) AS rsi14, round({rsi_sql(28)}, 6) AS rsi28 FROM p")
def rsi(spark, sf):
    w = X.series()
    d = F.col("delta")
    return priced(spark, sf).select("symbol", "d", r6(X.rsi(d, w, 14), "rsi14"), r6(X.rsi(d, w, 28), "rsi28"))


@plan("bollinger", f"WITH b AS (SELECT symbol, d, {full('avg(close)', 20, 'close')} AS m, {full('stddev_samp(close)', 20, 'close')} AS s FROM bars) SELECT symbol, d, round(m + 2 * s, 6) AS upper, round(m, 6) AS middle, round(m - 2 * s, 6) AS lower FROM b")
def bollinger(spark, sf):
    w = X.series()
    m, s = X.roll(F.avg, F.col("close"), w, 20), X.roll(F.stddev_samp, F.col("close"), w, 20)
    return A.bars_1d(spark, sf).select("symbol", "d", r6(m + 2 * s, "upper"), r6(m, "middle"), r6(m - 2 * s, "lower"))


@plan("atr", f"WITH {P} SELECT symbol, d, round(tr, 5) AS tr, round({full("avg(tr)", 14, "tr")}, 5) AS atr FROM p")
def atr(spark, sf):
    w = X.series()
    return priced(spark, sf).select("symbol", "d", F.round("tr", 5).alias("tr"), F.round(X.roll(F.avg, F.col("tr"), w, 14), 5).alias("atr"))


def adx_frame(spark, sf):
    """+DI, -DI and ADX from adjusted exponential means; the first DX is null where both DI are 0."""
    w = X.series()
    b = priced(spark, sf)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    b = b.withColumns({"up": F.when((up > down) & (up > 0), up).otherwise(0.0), "down": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    e = ewm(b.select("symbol", "d", "close", "tr", "up", "down"), {"etr": ("tr", 14, True), "eup": ("up", 14, True), "edown": ("down", 14, True)})
    e = e.withColumns({"plus_di": 100 * F.try_divide("eup", "etr"), "minus_di": 100 * F.try_divide("edown", "etr")})
    e = e.withColumn("dx", 100 * F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return ewm(e, {"adx": ("dx", 14, True)})


K = 1 - 2 / 15


@plan("adx", f"""WITH RECURSIVE {P}, m AS (SELECT symbol, d, i, tr, high - lag(high) OVER w AS u, lag(low) OVER w - low AS v FROM p WINDOW w AS (PARTITION BY symbol ORDER BY d)),
    q AS MATERIALIZED (SELECT symbol, d, i, tr, CASE WHEN u > v AND u > 0 THEN u ELSE 0.0 END AS up, CASE WHEN v > u AND v > 0 THEN v ELSE 0.0 END AS dn FROM m),
    e AS (SELECT symbol, i, d, tr AS t, up AS a, dn AS b, 1.0::DOUBLE AS den FROM q WHERE i = 1 UNION ALL
      SELECT q.symbol, q.i, q.d, q.tr + {K!r} * e.t, q.up + {K!r} * e.a, q.dn + {K!r} * e.b, 1 + {K!r} * e.den FROM e JOIN q ON q.symbol = e.symbol AND q.i = e.i + 1),
    x AS MATERIALIZED (SELECT symbol, i, d, 100 * a / t AS pdi, 100 * b / t AS mdi, CASE WHEN a + b > 0 THEN 100 * abs(a / t - b / t) / (a / t + b / t) END AS dx FROM e),
    f AS (SELECT symbol, i, d, coalesce(dx, 0) AS num, CASE WHEN dx IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS den FROM x WHERE i = 1 UNION ALL
      SELECT x.symbol, x.i, x.d, coalesce(x.dx, 0) + {K!r} * f.num, CASE WHEN x.dx IS NULL THEN 0.0 ELSE 1.0 END + {K!r} * f.den FROM f JOIN x ON x.symbol = f.symbol AND x.i = f.i + 1)
    SELECT x.symbol, x.d, round(pdi, 5) AS plus_di, round(mdi, 5) AS minus_di, round(CASE WHEN f.den > 0 THEN num / f.den END, 5) AS adx FROM x JOIN f USING (symbol, i)""")
def adx(spark, sf):
    return adx_frame(spark, sf).select("symbol", "d", F.round("plus_di", 5).alias("plus_di"), F.round("minus_di", 5).alias("minus_di"), F.round("adx", 5).alias("adx"))


@plan("vol_regime", f"""WITH {P}, h AS (SELECT symbol, d, {full('stddev_samp(ret)', 21, 'ret')} * sqrt(252) AS hv FROM p),
    g AS (SELECT symbol, d, hv, hv / {full('avg(hv)', 63, 'hv')} AS regime, (hv - {full('avg(hv)', 63, 'hv')}) / {full('stddev_samp(hv)', 63, 'hv')} AS vz FROM h)
    SELECT symbol, d, round(hv, 6) AS hv, round(regime, 6) AS regime, round(vz, 6) AS vol_z, CASE WHEN regime < 0.8 AND vz < -1 THEN 'bullish' WHEN regime > 1.2 AND vz > 1 THEN 'bearish' ELSE 'neutral' END AS signal FROM g""")
def vol_regime(spark, sf):
    w = X.series()
    h = priced(spark, sf).select("symbol", "d", (X.roll(F.stddev_samp, F.col("ret"), w, 21) * F.sqrt(F.lit(252.0))).alias("hv"))
    m, s = X.roll(F.avg, F.col("hv"), w, 63), X.roll(F.stddev_samp, F.col("hv"), w, 63)
    g = h.select("symbol", "d", "hv", (F.col("hv") / m).alias("regime"), ((F.col("hv") - m) / s).alias("vz"))
    signal = F.when((F.col("regime") < 0.8) & (F.col("vz") < -1), "bullish").when((F.col("regime") > 1.2) & (F.col("vz") > 1), "bearish").otherwise("neutral")
    return g.select("symbol", "d", r6(F.col("hv"), "hv"), r6(F.col("regime"), "regime"), r6(F.col("vz"), "vol_z"), signal.alias("signal"))


@plan("rolling_skew_kurt", f"WITH {P} SELECT symbol, d, round({full('skewness(ret)', 63, 'ret')}, 4) AS skew, round({full('kurtosis(ret)', 63, 'ret')}, 4) AS kurt FROM p")
def skew_kurt(spark, sf):
    w = X.series()
    r = F.col("ret")
    return priced(spark, sf).select("symbol", "d", F.round(X.skew_unbiased(r, w, 63), 4).alias("skew"), F.round(X.kurt_unbiased(r, w, 63), 4).alias("kurt"))


LAGS = range(2, 20)


@plan("hurst", f"""WITH {P}, t AS (SELECT symbol, k, sqrt(stddev_pop(x)) AS tau FROM (SELECT symbol, k, close - lag(close, k) OVER (PARTITION BY symbol, k ORDER BY d) AS x FROM bars CROSS JOIN range(2, 20) r(k)) GROUP BY 1, 2)
    SELECT symbol, round(regr_slope(ln(greatest(1e-8, tau)), ln(k)), 6) AS hurst FROM t GROUP BY 1""")
def hurst(spark, sf):
    w = X.series()
    b = A.bars_1d(spark, sf)
    x = b.select("symbol", *[(F.col("close") - F.lag("close", k).over(w)).alias(f"x{k}") for k in LAGS])
    t = x.groupBy("symbol").agg(*[F.sqrt(F.stddev_pop(f"x{k}")).alias(f"t{k}") for k in LAGS])
    long = t.select("symbol", F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"t{k}").alias("tau")) for k in LAGS])).alias("p"))
    return long.groupBy("symbol").agg(r6(F.regr_slope(F.ln(F.greatest(F.lit(1e-8), F.col("p.tau"))), F.ln("p.k")), "hurst"))


def slope_weights():
    """Weights that give the least-squares slope of values at ln(2), ..., ln(19)."""
    import math

    k = [math.log(lag) for lag in LAGS]
    mean = sum(k) / len(k)
    spread = sum((x - mean) ** 2 for x in k)
    return {lag: (x - mean) / spread for lag, x in zip(LAGS, k, strict=True)}


def technical_frame(bars):
    """Everything the sub-signals need, for every bar, from what was known then: one frame, two passes of exponential means."""
    w = X.series()
    c, r = F.col("close"), F.col("ret")
    b = with_changes(bars)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    hv = X.roll(F.stddev_samp, r, w, 21) * F.sqrt(F.lit(252.0))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumns({f"x{k}": c - F.lag("close", k).over(w) for k in LAGS})
    tau = {k: F.ln(F.greatest(F.lit(1e-8), F.sqrt(F.stddev_pop(f"x{k}").over(upto)))) for k in LAGS}
    b = b.withColumns({
        "up": F.when((up > down) & (up > 0), up).otherwise(0.0), "down": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "i": F.row_number().over(w), "z": F.try_divide(c - X.roll(F.avg, c, w, 50), X.roll(F.stddev_samp, c, w, 50)),
        "pb": F.try_divide(c - (X.roll(F.avg, c, w, 20) - 2 * X.roll(F.stddev_samp, c, w, 20)), 4 * X.roll(F.stddev_samp, c, w, 20)),
        "mom": 0.4 * X.roll(F.sum, r, w, 21) + 0.3 * X.roll(F.sum, r, w, 63) + 0.3 * X.roll(F.sum, r, w, 126),
        "vr": F.col("volume") / X.roll(F.avg, F.col("volume"), w, 21), "hv": hv, "skew": X.skew_unbiased(r, w, 63),
        "hurst": sum((tau[k] * v for k, v in slope_weights().items()), F.lit(0.0)),
    }).drop(*[f"x{k}" for k in LAGS])
    m, s = X.roll(F.avg, F.col("hv"), w, 63), X.roll(F.stddev_samp, F.col("hv"), w, 63)
    b = b.withColumns({"regime": F.try_divide(F.col("hv"), m), "vz": F.try_divide(F.col("hv") - m, s)})
    e = ewm(b, {"etr": ("tr", 14, True), "eup": ("up", 14, True), "edown": ("down", 14, True), **{f"ema{n}": ("close", n, False) for n in (8, 21, 55)}})
    p, q = 100 * F.try_divide("eup", "etr"), 100 * F.try_divide("edown", "etr")
    return ewm(e.withColumn("dx", 100 * F.try_divide(F.abs(p - q), p + q)), {"adx": ("dx", 14, True)})


def technical_signal(x, weights, ready: int):
    """The five sub-signals and their ensemble; a trend needs ``ready`` bars."""

    def part(up, down, conf, ready=None):
        """(sign, confidence): +1, -1 or a neutral 0 with 0.5; 0 and 0 before the series is long enough."""
        sign = F.when(up, 1).when(down, -1).otherwise(0)
        conf = F.when(up | down, conf).otherwise(0.5)
        return (F.when(ready, sign).otherwise(0), F.when(ready, conf).otherwise(0.0)) if ready is not None else (sign, conf)

    fast, slow = F.col("ema8") > F.col("ema21"), F.col("ema21") > F.col("ema55")
    none = F.lit(False)
    parts = {
        "trend": part(fast & slow, ~fast & ~slow, F.col("adx") / 100, F.col("i") >= ready),
        "mean_reversion": part((F.col("z") < -2) & (F.col("pb") < 0.2), (F.col("z") > 2) & (F.col("pb") > 0.8), F.least(F.abs("z") / 4, F.lit(1.0))),
        "momentum": part((F.col("mom") > 0.05) & (F.col("vr") > 1), (F.col("mom") < -0.05) & (F.col("vr") > 1), F.least(5 * F.abs("mom"), F.lit(1.0))),
        "volatility": part((F.col("regime") < 0.8) & (F.col("vz") < -1), (F.col("regime") > 1.2) & (F.col("vz") > 1), F.least(F.abs("vz") / 3, F.lit(1.0))),
        "stat_arb": part(F.coalesce((F.col("hurst") < 0.4) & (F.col("skew") > 1), none), F.coalesce((F.col("hurst") < 0.4) & (F.col("skew") < -1), none), 2 * (0.5 - F.col("hurst"))),
    }
    parts = {k: (s, F.coalesce(c, F.lit(0.5))) for k, (s, c) in parts.items()}
    signal, score = ensemble(parts, weights)
    return x.select("symbol", "d", *[s.alias(f"{k}_sign") for k, (s, _) in parts.items()], signal.alias("signal"), F.round(score, 4).alias("score"))


def technical_sql(weights: dict[str, float], ready: int) -> str:
    """The same in SQL: windows, and recursive exponential means."""
    tau = ", ".join(f"ln(greatest(1e-8, sqrt(stddev_pop(x{k}) OVER u))) AS t{k}" for k in LAGS)
    lags = ", ".join(f"close - lag(close, {k}) OVER w AS x{k}" for k in LAGS)
    slope = " + ".join(f"t{k} * ({v!r})" for k, v in slope_weights().items())
    rolled = {"m50": ("avg(close)", 50, "close"), "s50": ("stddev_samp(close)", 50, "close"), "m20": ("avg(close)", 20, "close"), "s20": ("stddev_samp(close)", 20, "close"), "r21": ("sum(ret)", 21, "ret"), "r63": ("sum(ret)", 63, "ret"), "r126": ("sum(ret)", 126, "ret"), "v21": ("avg(volume)", 21, "volume"), "sd21": ("stddev_samp(ret)", 21, "ret"), "skew": ("skewness(ret)", 63, "ret")}
    rolled = ", ".join(f"{full(e, n, c)} AS {k}" for k, (e, n, c) in rolled.items())
    ema = lambda n: f"{2 / (n + 1)!r} * q.close + (1 - {2 / (n + 1)!r}) * e.e{n}"
    names = list(weights)
    parts = {
        "trend": (f"CASE WHEN i < {ready} THEN 0 WHEN e8 > e21 AND e21 > e55 THEN 1 WHEN e8 <= e21 AND e21 <= e55 THEN -1 ELSE 0 END", f"CASE WHEN i < {ready} THEN 0 WHEN e8 > e21 AND e21 > e55 OR e8 <= e21 AND e21 <= e55 THEN coalesce(adx / 100, 0.5) ELSE 0.5 END"),
        "mean_reversion": ("CASE WHEN z < -2 AND pb < 0.2 THEN 1 WHEN z > 2 AND pb > 0.8 THEN -1 ELSE 0 END", "CASE WHEN z < -2 AND pb < 0.2 OR z > 2 AND pb > 0.8 THEN least(abs(z) / 4, 1) ELSE 0.5 END"),
        "momentum": ("CASE WHEN mom > 0.05 AND vr > 1 THEN 1 WHEN mom < -0.05 AND vr > 1 THEN -1 ELSE 0 END", "CASE WHEN (mom > 0.05 OR mom < -0.05) AND vr > 1 THEN least(5 * abs(mom), 1) ELSE 0.5 END"),
        "volatility": ("CASE WHEN regime < 0.8 AND vz < -1 THEN 1 WHEN regime > 1.2 AND vz > 1 THEN -1 ELSE 0 END", "CASE WHEN regime < 0.8 AND vz < -1 OR regime > 1.2 AND vz > 1 THEN least(abs(vz) / 3, 1) ELSE 0.5 END"),
        "stat_arb": ("CASE WHEN hurst < 0.4 AND skew > 1 THEN 1 WHEN hurst < 0.4 AND skew < -1 THEN -1 ELSE 0 END", "CASE WHEN hurst < 0.4 AND (skew > 1 OR skew < -1) THEN 2 * (0.5 - hurst) ELSE 0.5 END"),
    }
    signs = ", ".join(f"{parts[k][0]} AS {k}_sign, ({parts[k][1]})::DOUBLE AS c_{k}" for k in names)
    top, base = " + ".join(f"{k}_sign * {weights[k]} * c_{k}" for k in names), " + ".join(f"{weights[k]} * c_{k}" for k in names)
    return f"""WITH RECURSIVE {P}, l AS (SELECT *, {lags}, high - lag(high) OVER w AS hu, lag(low) OVER w - low AS ld, {rolled} FROM p WINDOW w AS (PARTITION BY symbol ORDER BY d)),
    h AS (SELECT *, {tau}, sd21 * sqrt(252) AS hv FROM l WINDOW u AS (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING)),
    q AS MATERIALIZED (SELECT symbol, d, i, close, tr, CASE WHEN hu > ld AND hu > 0 THEN hu ELSE 0.0 END AS up, CASE WHEN ld > hu AND ld > 0 THEN ld ELSE 0.0 END AS dn, (close - m50) / nullif(s50, 0) AS z, (close - (m20 - 2 * s20)) / nullif(4 * s20, 0) AS pb,
      0.4 * r21 + 0.3 * r63 + 0.3 * r126 AS mom, volume / v21 AS vr, skew, {slope} AS hurst, hv / nullif({full('avg(hv)', 63, 'hv')}, 0) AS regime, (hv - {full('avg(hv)', 63, 'hv')}) / nullif({full('stddev_samp(hv)', 63, 'hv')}, 0) AS vz FROM h),
    e AS (SELECT symbol, i, tr AS t, up AS a, dn AS b, close AS e8, close AS e21, close AS e55, 0.0::DOUBLE AS num, 0.0::DOUBLE AS den FROM q WHERE i = 1
      UNION ALL SELECT symbol, i, t, a, b, e8, e21, e55, coalesce(dx, 0) + {K!r} * num, CASE WHEN dx IS NULL THEN 0.0 ELSE 1.0 END + {K!r} * den
      FROM (SELECT *, CASE WHEN a + b > 0 THEN 100 * abs(a / t - b / t) / (a / t + b / t) END AS dx FROM (SELECT q.symbol, q.i, q.tr + {K!r} * e.t AS t, q.up + {K!r} * e.a AS a, q.dn + {K!r} * e.b AS b, {ema(8)} AS e8, {ema(21)} AS e21, {ema(55)} AS e55, e.num, e.den FROM e JOIN q ON q.symbol = e.symbol AND q.i = e.i + 1))),
    y AS (SELECT q.symbol, q.d, {signs} FROM (SELECT q.*, e8, e21, e55, CASE WHEN den > 0 THEN num / den END AS adx FROM q JOIN e ON e.symbol = q.symbol AND e.i = q.i) q),
    o AS (SELECT *, CASE WHEN {base} > 0 THEN ({top}) / ({base}) ELSE 0 END AS score FROM y)
    SELECT symbol, d, {", ".join(f"{k}_sign" for k in names)}, CASE WHEN score > 0.2 THEN 'bullish' WHEN score < -0.2 THEN 'bearish' ELSE 'neutral' END AS signal, round(score, 4) AS score FROM o"""


@plan("technical_ensemble", technical_sql(TECHNICAL_WEIGHTS, 55))
def technical(spark, sf):
    """The five sub-signals and their ensemble for every bar."""
    return technical_signal(technical_frame(A.bars_1d(spark, sf)), TECHNICAL_WEIGHTS, 55)


@plan("crypto_ensemble", technical_sql(CRYPTO_WEIGHTS, 63))
def crypto(spark, sf):
    """The ensemble with the weights for crypto assets."""
    return technical_signal(technical_frame(A.bars_1d(spark, sf)), CRYPTO_WEIGHTS, 63)


@plan("drawdown", "SELECT symbol, d, round(close / max(close) OVER (PARTITION BY symbol ORDER BY d) - 1, 6) AS drawdown FROM bars")
def drawdown(spark, sf):
    w = X.series()
    return A.bars_1d(spark, sf).select("symbol", "d", r6(X.drawdown(F.col("close"), w), "drawdown"))


@plan("percentile_rank", "SELECT symbol, d, round((rank() OVER (PARTITION BY symbol ORDER BY close) - 1) / count(*) OVER (PARTITION BY symbol) * 100, 6) AS pct FROM bars")
def percentile(spark, sf):
    """Share of the symbol's closes below each, ranked by bins of a quantile sketch and exactly within them."""
    return stats.percentile_rank(A.bars_1d(spark, sf), "symbol", "close", "pct").select("symbol", "d", r6(F.col("pct"), "pct"))


@plan("prob_anomaly_z", """WITH x AS (SELECT token_id, ts, p, p - lag(p) OVER (PARTITION BY token_id ORDER BY ts) AS dp FROM prob),
    z AS (SELECT *, CASE WHEN count(dp) OVER w >= 5 THEN (dp - avg(dp) OVER w) / (stddev_samp(dp) OVER w + 1e-9) END AS z FROM x WINDOW w AS (PARTITION BY token_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT token_id, ts, round(z, 5) AS z, coalesce(abs(z) > 2, false) AS anomaly, CASE WHEN dp > 0 THEN 'up' ELSE 'down' END AS direction FROM z""", "prob")
def prob_anomaly(spark, sf):
    v = W.partitionBy("token_id").orderBy("ts")
    x = A.prob_ticks(spark, sf).withColumn("dp", F.col("p") - F.lag("p").over(v))
    x = x.withColumn("z", X.z_score(F.col("dp"), v, 20, 5))
    return x.select("token_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("z", 5).alias("z"), F.coalesce(F.abs("z") > 2, F.lit(False)).alias("anomaly"), F.when(F.col("dp") > 0, "up").otherwise("down").alias("direction"))


@plan("kline_anomaly", f"""WITH z AS (SELECT symbol, d, CASE WHEN count(*) OVER w >= 10 THEN (volume - avg(volume) OVER w) / (stddev_samp(volume) OVER w + 1e-9) END AS vz,
    (open - low) / open * 100 AS drop_pct FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT symbol, d, round(vz, 5) AS vol_z, round(drop_pct, 6) AS drop_pct, CASE WHEN vz > 3 OR drop_pct > 1.5 THEN 'severe' WHEN abs(vz) > 3 OR drop_pct > 1 THEN 'anomaly' ELSE 'normal' END AS label FROM z""")
def kline(spark, sf):
    w = X.series()
    x = A.bars_1d(spark, sf).select("symbol", "d", X.z_score(F.col("volume"), w, 60, 10).alias("vz"), ((F.col("open") - F.col("low")) / F.col("open") * 100).alias("p"))
    label = F.when((F.col("vz") > 3) | (F.col("p") > 1.5), "severe").when((F.abs("vz") > 3) | (F.col("p") > 1), "anomaly").otherwise("normal")
    return x.select("symbol", "d", F.round("vz", 5).alias("vol_z"), r6(F.col("p"), "drop_pct"), label.alias("label"))
